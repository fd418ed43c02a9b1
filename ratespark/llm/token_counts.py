"""Token counts of whole texts by overlap resynchronisation.

A text is encoded in chunks that overlap. In each overlap the two encodings are spliced at a boundary that both of them have
and that is proven stable: no piece of the vocabulary holds its left character directly followed by its right one. Pieces
only ever grow by merging neighbours into a piece of the vocabulary, so nothing can merge across such a boundary, and the
text's encoding is the left side's followed by the right side's. What a chunk's own ends spoil (the blank that the library
puts before a text, a word cut in two) lies outside the splices. An overlap without such a boundary is widened to the right,
twice as far each time, at worst to the end of the text: then that stretch is one chunk, as without chunks.

Defined cases: a null text counts as empty; an empty text has no tokens; white space and characters outside the vocabulary
(byte pieces) are encoded as the library encodes the whole text; strings of special tokens are ordinary text. A text of one
chunk and one of very many take the same path, and a task holds one batch of texts and one chunk's pieces. A stretch without
a stable boundary has to fit into a task, as does any text. Null and repeated ids keep a row each; repeated rows and ties
give equal rows; an empty table gives none. Only the id and text columns are read, so names of other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: Characters a chunk advances, and characters it shares with the next one at first.
CHUNK, OVERLAP = 16_384, 128
#: More tokens than this are over the limit.
TOKEN_LIMIT = 4096
_BLANK = ord("▁")  # stands for a blank inside pieces


class ChunkedEncoder:
    """Encodes texts of any length with a sentence-piece model, chunk by chunk."""

    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        if not 2 <= overlap <= chunk:
            raise ValueError("An overlap has at least two characters and no more than a chunk.")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.joined = self._joined_characters()

    def _joined_characters(self) -> np.ndarray:
        """Sorted codes of all pairs of characters that stand side by side in some piece."""
        pairs = set()
        for i in range(self.processor.get_piece_size()):
            if not self.processor.is_control(i) and not self.processor.is_byte(i):
                piece = self.processor.id_to_piece(i)
                pairs.update((ord(a) << 21) | ord(b) for a, b in zip(piece, piece[1:]))
        return np.array(sorted(pairs), np.int64)

    def stable(self, text: str) -> np.ndarray:
        """Positions of ``text`` that no piece can span."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[codes == 32] = _BLANK
        pairs = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), max(len(self.joined) - 1, 0))
        return np.flatnonzero(self.joined[at] != pairs) + 1 if len(self.joined) else np.arange(1, len(codes))

    def parts(self, text: str) -> Iterator[list[int]]:
        """The tokens of ``text``, as lists that follow one another."""
        size, start, splice = len(text), 0, 0  # where the chunk begins, and from where on its tokens count
        end = min(size, self.chunk + self.overlap)
        ids, begins = self._encoded(text, start, end)
        while end < size:
            following, reach, cut = end - self.overlap, self.overlap, None
            while cut is None and end < size:
                stop = min(size, end + self.chunk)
                next_ids, next_begins = self._encoded(text, following, stop)
                cut = self._common(text, following, end, begins, next_begins)
                if cut is None:
                    reach *= 2
                    end = min(size, following + reach)
                    ids, begins = self._encoded(text, start, end)
            if cut is None:
                break
            yield ids[bisect_left(begins, splice) : bisect_left(begins, cut)]
            ids, begins, start, splice, end = next_ids, next_begins, following, cut, stop
        yield ids[bisect_left(begins, splice) :]

    def _encoded(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Tokens of text[start:end] and where in ``text`` each begins."""
        if start == 0 and end == len(text):  # the last stretch of its text: nothing follows to be spliced
            ids = self.processor.encode(text)
            return ids, [0] * len(ids)
        found = self.processor.encode(text[start:end], return_type="offset_mapping")
        return found["ids"], [start + begin for begin, _ in found["offsets"]]

    def _common(self, text: str, low: int, high: int, left: list[int], right: list[int]) -> int | None:
        """The last stable position between ``low`` and ``high`` at which both encodings begin a token."""
        for position in reversed((self.stable(text[low:high]) + low).tolist()):
            if _begins(left, position) and _begins(right, position):
                return position
        return None


def _begins(begins: list[int], position: int) -> bool:
    at = bisect_left(begins, position)
    return at < len(begins) and begins[at] == position


@lru_cache(maxsize=4)
def _encoder(model_file: str | None, chunk: int, overlap: int) -> ChunkedEncoder:
    """One encoder per Python worker. Without a file, the installed vocabulary is taken where the task runs."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(MODEL)
    return ChunkedEncoder(model_file, chunk, overlap)


def token_ids(docs: DataFrame, model_file: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, part, ids): the tokens of every text in parts that follow one another from 0; an empty text has an empty part.

    ``model_file`` is a path that every executor can open.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file, chunk, overlap)
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                parts = list(encoder.parts(text.as_py() or ""))
                yield pa.record_batch({
                    "doc_id": pa.array([doc_id.as_py()] * len(parts), batch.schema.field(0).type),
                    "part": pa.array(range(len(parts)), pa.int32()),
                    "ids": pa.array(parts, pa.list_(pa.int32())),
                })

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(encoded, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, part int, ids array<int>")


def token_counts(
    docs: DataFrame, limit: int = TOKEN_LIMIT, model_file: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): size in UTF-8 and tokens of every whole text; no row moves."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file, chunk, overlap)
        for batch in batches:
            tokens = [sum(map(len, encoder.parts(text.as_py() or ""))) for text in batch.column(1)]
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(tokens, pa.int64()),
            })

    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
