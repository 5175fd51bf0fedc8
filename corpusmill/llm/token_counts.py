"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch lie end to end in one numpy array of symbols with
sequence starts beside it. Each round looks up the ranks of all neighbouring pairs,
takes each sequence's lowest rank, merges every place that has it, and drops the
sequences that have no mergeable pair left; what survives is counted.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import kept_in_worker, map_slices
from corpusmill.llm.int_table import IntTable
from corpusmill.llm.pretokens import CACHE_CHARS, CACHE_CHUNKS, Slots, chunks_of, find_pretokens

_NONE = np.int64(1) << 40


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Merge rules by left * 2**20 + right, with rank and merged symbol."""

    def __init__(self, first: np.ndarray, pairs: np.ndarray, merged: np.ndarray):
        self.first = first  # symbol of each byte
        self.rules, self.merged = IntTable((pairs[:, 0] << 20) + pairs[:, 1], np.arange(len(pairs))), merged

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, chars = model["vocab"], byte_chars()
        first = np.zeros(256, np.int64)
        for char, byte in chars.items():
            first[byte] = vocab[char]
        split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in split], np.int64).reshape(-1, 2)
        return cls(first, pairs, np.array([vocab[a + b] for a, b in split], np.int64))

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each pre-token when no rule applies any more."""
        result = np.zeros(len(pretokens), np.int64)
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        symbol = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), size)
        while len(symbol):
            inner = owner[1:] == owner[:-1]
            key = (symbol[:-1] << 20) + symbol[1:]
            rank = self.rules.get(key)
            rank = np.append(np.where(inner & (rank >= 0), rank, _NONE), _NONE)  # a pair stands at its left symbol
            starts = np.flatnonzero(np.append(True, ~inner))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths := np.diff(np.append(starts, len(symbol))))
            active = lowest < _NONE
            ended = starts[~active[starts]]
            result[owner[ended]] = lengths[~active[starts]]
            if not active.any():
                break
            place = np.flatnonzero(active & (rank == lowest))
            if len(place) > 1:  # of overlapping places (a a a) every second one, from the left
                fresh = np.append(True, np.diff(place) > 1)
                place = place[(place - place[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            symbol[place] = self.merged[rank[place]]
            active[place + 1] = False
            symbol, owner = symbol[active], owner[active]
        return result


@kept_in_worker
def _table(path: str) -> MergeTable:
    return MergeTable.from_json(path)


class TokenCounter:
    def __init__(self, merges: MergeTable, special: tuple[str, ...] = ()):
        self.merges, self.special = merges, special
        self.slots, self.count = Slots(), np.zeros(0, np.int64)

    def _settle(self) -> None:
        """Works out the chunks that are new."""
        new, self.slots.new = self.slots.new, []
        if not new:
            return
        words = [find_pretokens(" " + chunk) for chunk in new]
        flat = [w.encode() for ws in words for w in ws]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        each = self.merges.counts(list(number))[[number[w] for w in flat]] if flat else np.zeros(0, np.int64)
        ends = np.cumsum([len(ws) for ws in words])
        sums = np.append(0, np.cumsum(each))
        self.count = np.append(self.count, sums[ends] - sums[np.append(0, ends[:-1])])

    def __call__(self, texts: list[str | None]) -> list[int]:
        if self.slots.used > CACHE_CHUNKS:
            self.slots, self.count = Slots(), np.zeros(0, np.int64)
        found, loose, owner, sizes = [], [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text or ""]
            for mark in self.special:  # each is one token wherever it stands
                parts = [p for x in parts for p in x.split(mark)]
            sizes[i] += len(parts) - 1
            for part in filter(None, parts):
                chunks = chunks_of(part)
                if chunks is None or len(max(chunks, key=len)) > CACHE_CHARS:
                    pieces = find_pretokens(part)
                else:
                    pieces = find_pretokens(chunks[0])
                    found.append((i, np.fromiter(map(self.slots.__getitem__, chunks[1:]), np.int64, len(chunks) - 1)))
                loose += pieces
                owner += [i] * len(pieces)
        self._settle()
        for i, slots in found:
            sizes[i] += self.count[slots].sum()
        if loose:
            number = {w: k for k, w in enumerate(dict.fromkeys(loose))}
            np.add.at(sizes, owner, self.merges.counts([w.encode() for w in number])[[number[w] for w in loose]])
        return sizes.tolist()


@kept_in_worker
def _counter(path: str) -> TokenCounter:
    with open(path, encoding="utf-8") as file:
        special = tuple(x["content"] for x in json.load(file)["added_tokens"])
    return TokenCounter(_table(path), special)


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, by the byte-level vocabulary at ``path``.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows
    give repeated results; other columns are left out; an empty table gives none. The
    vocabulary's added tokens count one each where their strings stand in a text.
    """

    def make():
        counter = _counter(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n = counter(texts)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    return map_slices(documents.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
