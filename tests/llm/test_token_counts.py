"""Chunked encodings against the library's encoding of the whole text."""

import public_tokenizers
import pytest
import sentencepiece

from llm_helpers import prose
from ratespark.llm.token_counts import MODEL, ChunkedEncoder, token_counts, token_ids

PATH = public_tokenizers.path(MODEL)
WHOLE = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "\n\n  \t", "one", " ".join(prose(1, 4_000)), "a" * 3_000, "ab" * 2_000, " " * 2_500, "\n" * 2_000,
    "naïve façade 中文字符測試" * 150, "\U0001fae0\U0001f600é" * 400, "<s> </s> <unk> <0x41> " * 120, "x\x00y\x01 " * 300,
    "http://example.org/" + "a1b2c3d4" * 500 + " end", "▁▁ ▁a ▁" * 200, "ein Wort. " * 500 + "b" * 900 + " tail words here",
    "0123456789" * 300 + "==" * 500, "\r\n".join(prose(5, 900)), "कखगघ" * 300,
]


@pytest.mark.parametrize("chunk,overlap", [(2, 2), (7, 3), (50, 8), (333, 16), (1000, 100), (10_000, 64)])
def test_splices_give_the_whole_encoding(chunk, overlap):
    encoder = ChunkedEncoder(PATH, chunk, overlap)
    for text in TEXTS if chunk >= 50 else [t[:400] for t in TEXTS]:
        assert [i for part in encoder.parts(text) for i in part] == WHOLE.encode(text)


def test_long_prose_is_really_cut():
    parts = list(ChunkedEncoder(PATH, 500, 64).parts(" ".join(prose(2, 3_000))))
    assert len(parts) > 20 and max(map(len, parts)) < 700


def test_a_stretch_without_a_stable_boundary_stays_whole():
    assert len(list(ChunkedEncoder(PATH, 100, 8).parts("a" * 5_000))) == 1


def test_no_stable_position_lies_inside_a_piece():
    encoder = ChunkedEncoder(PATH)
    for text in TEXTS:
        found = WHOLE.encode(text, return_type="offset_mapping")["offsets"]
        assert set(encoder.stable(text).tolist() if len(text) > 1 else []) <= {begin for begin, _ in found}


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError):
        ChunkedEncoder(PATH, 10, 1)
    with pytest.raises(ValueError):
        ChunkedEncoder(PATH, 5, 6)


def test_counts_of_odd_rows(make_docs, odd_rows):
    rows = token_counts(make_docs(odd_rows), limit=50, chunk=1000, overlap=32).collect()
    wanted = sorted(
        (r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(WHOLE.encode(r[1] or "")), len(WHOLE.encode(r[1] or "")) > 50)
        for r in odd_rows
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == wanted
    assert token_counts(make_docs([])).collect() == []


def test_ids_in_parts(make_docs):
    docs = make_docs([(1, TEXTS[4]), (2, None), (3, "a b")])
    found = {}
    for row in token_ids(docs, chunk=700, overlap=40).orderBy("doc_id", "part").collect():
        found.setdefault(row.doc_id, []).extend(row.ids)
    assert found == {1: WHOLE.encode(TEXTS[4]), 2: [], 3: WHOLE.encode("a b")}
