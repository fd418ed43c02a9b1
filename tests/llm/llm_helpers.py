"""Brute-force word rules and made-up prose for the tests of the text operators."""

from __future__ import annotations

import re

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return PLAIN.findall(text or "")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, repeat=7919):
    """``n`` words that hardly repeat, the same for the same seed."""
    return [f"w{(seed * 1_000_003 + i * repeat) % 99_991}x{i % 13}" for i in range(n)]
