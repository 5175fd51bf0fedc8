"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of a byte string's prefix ends in exactly one token, and that token is the
only one that is compatible with the last token of what precedes it: two tokens are
compatible if encoding their bytes together gives just these two. So one number for each
prefix, the last token, holds the encodings of all prefixes. Bytes are appended by
going on from the last prefix; after an edit only the prefixes behind it are redone, until they agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import kept_in_worker, map_slices
from corpusmill.llm.int_table import IntTable
from corpusmill.llm.pretokens import CACHE_CHARS, CACHE_CHUNKS, Slots, chunks_of, find_pretokens

_PAIRS_KEPT = 1_000_000
_NEVER = 1 << 60


class PrefixTables:
    """Ranks of a vocabulary and which pairs of its tokens are compatible."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.endings = ahocorasick.Automaton()  # finds all tokens that end at a byte
        for data, token in ranks.items():
            self.endings.add_word(data.decode("latin-1"), (token, len(data)))
        self.endings.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> PrefixTables:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())})

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Encoding of a few bytes by the merge rule itself, stopped at ``least`` tokens."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.split:
            data = self.bytes_of[token]
            self.split[token] = tuple(self.merged(data, 2)) if len(data) > 1 else None
        return self.split[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are beside each other; left -1: whether right, alone, is its own encoding.

        Undoes the merges of both, latest first. A pair that would have merged across the
        boundary before one of its sides went into a larger token speaks against them.
        """
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > _PAIRS_KEPT:
                self.compatible.clear()
            known = self.compatible[left, right] = self.judge(left, right)
        return known

    def judge(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[right]) == [right] if left < 0 else self._apart(left, right)

    def _apart(self, a: int, b: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        until_a = until_b = _NEVER
        while True:
            rank = ranks.get(bytes_of[a] + bytes_of[b], _NEVER)
            if rank < until_a and rank <= until_b and rank != _NEVER:  # of equal ranks the left place merges first
                return False
            split_a, split_b = self.halves(a), self.halves(b)
            if split_a and (not split_b or a > b):
                until_a, a = a, split_a[1]
            elif split_b:
                until_b, b = b, split_b[0]
            else:
                return True


class PrefixEncoding:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, tables: PrefixTables, data: bytes = b""):
        self.tables, self.data, self.last = tables, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self._extend(more)

    def _extend(self, more: bytes, old: list[int] | None = None, edited: int = 0, shift: int = 0) -> int:
        """Works out the last tokens of the prefixes that ``more`` adds; returns how many were worked out.

        ``old`` are the last tokens before an edit that ends at ``edited`` and moved what follows by ``shift``. A prefix's last token depends on those
        of the prefixes within a longest token before it; once that many in a row behind the edit are as they were, so are all others.
        """
        t = self.tables
        data = self.data = self.data + more
        last, known, fit = self.last, t.compatible.get, t.fit
        first = done = len(last) - 1  # prefixes up to this length have their last token
        begin, same = max(0, done + 1 - t.longest), 0
        for at, (token, length) in t.endings.iter(data[begin:].decode("latin-1")):
            end = begin + at + 1
            if end > done:
                before = last[end - length]
                fits = known((before, token))
                if fits or fits is None and fit(before, token):
                    last.append(token)
                    done = end
                    if old is not None and end >= edited:
                        same = same + 1 if old[end - shift] == token else 0
                        if same >= t.longest:
                            last.extend(old[end - shift + 1 :])
                            break
        return done - first

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of data[start:stop]; prefixes up to ``start`` are kept, and those that the edit doesn't reach. Returns how many were redone."""
        old, rest = self.last[:], new + self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        return self._extend(rest, old, start + len(new), start + len(new) - stop)

    def tokens(self) -> list[int]:
        end, out = len(self.data), []
        while end:
            out.append(self.last[end])
            end -= len(self.tables.bytes_of[self.last[end]])
        return out[::-1]


class BatchEncoder:
    """The last tokens of all prefixes of many byte strings at once, as columns of a matrix.

    A trie, walked from every position together, finds the tokens that start there; then
    prefix by prefix the longest token that fits the one before it is taken.
    """

    def __init__(self, tables: PrefixTables):
        self.tables = tables
        nodes: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for data, token in tables.ranks.items():
            node = 0
            for byte in data:
                node = nodes.setdefault((node, byte), len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = token
        self.edges = IntTable([n * 256 + b for n, b in nodes], list(nodes.values()))
        self.token_at = np.array(token_at, np.int64)
        self.size_of = np.zeros(max(tables.bytes_of) + 1, np.int64)
        for token, data in tables.bytes_of.items():
            self.size_of[token] = len(data)
        self.pairs = IntTable()

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = ((left + 1) << 20) | right
        known = self.pairs.get(key)
        if (unknown := known < 0).any():
            if self.pairs.used > _PAIRS_KEPT:
                self.pairs = IntTable()
                unknown[:] = True
            new = np.unique(key[unknown])
            self.pairs.insert(new, np.array([self.tables.judge((x >> 20) - 1, x & 0xFFFFF) for x in new.tolist()], np.int64))
            known = self.pairs.get(key)
        return known == 1

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each (1 to ROW_BYTES bytes), little-endian 32 bits each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size, width = size[order], int(size.max())
        rows = np.zeros((len(words), width), np.uint8)
        rows[np.arange(width) < size[:, None]] = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        at = np.flatnonzero(np.arange(width) < size[:, None])
        flat, node, tokens = rows.ravel(), np.zeros(len(at), np.int64), []
        room = size[at // width] - at % width
        while len(tokens) < width and len(at):
            inside = room > len(tokens)
            at, node, room = at[inside], node[inside], room[inside]
            node = self.edges.get(node * 256 + flat[at + len(tokens)])
            at, node, room = at[on := node >= 0], node[on], room[on]
            tokens.append(np.full(rows.shape, -1, np.int32))
            tokens[-1].ravel()[at] = self.token_at[node]
        last = np.full((len(words), width + 1), -1, np.int32)
        reach = np.searchsorted(-size, -np.arange(width + 1), side="right")  # rows of at least so many bytes
        for end in range(1, width + 1):
            open_rows = np.arange(reach[end])
            for length in range(min(end, len(tokens)), 0, -1):
                token = tokens[length - 1][open_rows, end - length]
                some = token >= 0
                if some.any():
                    tried, right = open_rows[some], token[some].astype(np.int64)
                    good = self._fit(last[tried, end - length].astype(np.int64), right)
                    last[tried[good], end] = right[good]
                    open_rows = open_rows[last[open_rows, end] < 0]
                    if not len(open_rows):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        ids, end, row, n = np.zeros((len(words), width), "<u4"), size.copy(), np.arange(len(words)), np.zeros(len(words), np.int64)
        while len(row):
            token = last[row, end]
            n[row] += 1
            ids[row, width - n[row]] = token
            end = end - self.size_of[token]
            row, end = row[end > 0], end[end > 0]
        out: list[bytes] = [b""] * len(words)
        for i, row, k in zip(order.tolist(), ids, (width - n).tolist(), strict=True):
            out[i] = row[k:].tobytes()
        return out


#: Longer pre-tokens are encoded one by one.
ROW_BYTES = 32


class Codec:
    """Encodes texts match by match of the split pattern to little-endian 32-bit ids, and decodes these."""

    def __init__(self, tables: PrefixTables):
        self.tables, self.batch = tables, BatchEncoder(tables)
        self.vocabulary = [tables.bytes_of.get(i, b"") for i in range(max(tables.bytes_of) + 1)]
        self.words: dict[str, bytes] = {}
        self.slots, self.ids = Slots(), []

    def _learn(self, pretokens: list[list[str]]) -> None:
        new = list(set().union(*pretokens).difference(self.words))
        data = [w.encode() for w in new]
        short = [i for i, w in enumerate(data) if len(w) <= ROW_BYTES]
        for i in set(range(len(new))).difference(short):
            self.words[new[i]] = np.array(PrefixEncoding(self.tables, data[i]).tokens(), "<u4").tobytes()
        if short:
            self.words.update(zip([new[i] for i in short], self.batch([data[i] for i in short]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.slots.used > CACHE_CHUNKS or len(self.words) > CACHE_CHUNKS:
            self.words, self.slots, self.ids = {}, Slots(), []
        parts: list[tuple[list[str], list[int]]] = []
        for text in texts:
            chunks = chunks_of(text)
            if chunks is None or len(max(chunks, key=len)) > CACHE_CHARS:
                parts.append((find_pretokens(text), []))
            else:
                parts.append((find_pretokens(chunks[0]), list(map(self.slots.__getitem__, chunks[1:]))))
        new, self.slots.new = [find_pretokens(" " + c) for c in self.slots.new], []
        self._learn([*new, *(head for head, _ in parts)])
        word = self.words.__getitem__
        self.ids += [b"".join(map(word, w)) for w in new]
        return [b"".join(map(word, head)) + b"".join(map(self.ids.__getitem__, slots)) for head, slots in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept_in_worker
def _codec(path: str) -> Codec:
    return Codec(PrefixTables.from_file(path))


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids (binary, little-endian 32 bits each) of every whole text, by the ranks at ``path``.

    A null text counts as empty and has no ids. A null doc_id stays null, repeated rows give
    repeated results, other columns are left out, an empty table gives none.
    """

    def make():
        codec = _codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

        return work

    return map_slices(documents.select("doc_id", "text"), make, "doc_id long, text string, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data (binary): the bytes that the column ids stands for; null ids count as none."""

    def make():
        codec = _codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

        return work

    return map_slices(encoded.select("doc_id", "ids"), make, "doc_id long, data binary")


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text where it lies, and keeps digests.

    Nulls, repeated rows and empty tables as in ``encode_documents``.
    """

    def make():
        codec = _codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return map_slices(documents.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
