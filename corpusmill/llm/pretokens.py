"""Splitting of texts into the pre-tokens of byte-level BPE, chunk by chunk.

No match of the pattern crosses a space that precedes a character other than white
space, so a text falls into chunks at these spaces, and equal chunks give equal
pre-tokens. A worker keeps what it has worked out for chunks in a bounded cache.
"""

from __future__ import annotations

import re

import regex

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

find_pretokens = regex.compile(PATTERN).findall
_odd_space = re.compile(r" \s|\s\Z").search

CACHE_CHUNKS, CACHE_CHARS = 250_000, 40


def chunks_of(text: str) -> list[str] | None:
    """The chunks at single spaces (all but the first lack their space), or None if white space runs forbid that."""
    return None if _odd_space(text) else text.split(" ")


class Slots(dict):
    """chunk -> number of its slot; a new chunk waits in ``new`` until its owner has worked it out."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.used = 0

    def __missing__(self, chunk: str) -> int:
        slot = self[chunk] = self.used
        self.used += 1
        self.new.append(chunk)
        return slot
