"""Packing of tokenised documents into sequences of bounded length.

First-fit decreasing: pieces go, longest first, into the first open bin with room. A
tournament tree whose leaves are the bins and whose inner nodes hold the larger of two
capacities finds that bin in logarithmic time. Documents are dealt out at random to groups
of bounded expected size, and each group is packed by itself.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import kept_in_worker, map_slices
from corpusmill.llm.pretokens import CACHE_CHARS, CACHE_CHUNKS, Slots
from corpusmill.llm.token_counts import byte_chars

#: Fixed value: the split pattern of the vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Control characters that Python's split takes for white space and the vocabulary's rules don't.
_separators = re.compile("[\x1c-\x1f]").search
_find_words = regex.compile(WORD_PATTERN).findall


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are packed as native unsigned integers, which must be little-endian 32-bit here")


class WordEncoder:
    """Ids of texts under a BPE vocabulary with word ends, lower case and white space dropped.

    No match crosses white space, so a text falls into chunks there, and a bounded cache keeps
    chunks' ids. Words of ASCII and Latin-1 letters are merged by tiktoken's core: their last
    byte, which carries the word end, gets a byte value of its own. All others, and texts with
    strings of added tokens, go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        plain = [b for b in range(33, 127) if not 65 <= b <= 90] + [*range(0x9F, 0xC0)]
        code = {(b, end): i for i, (b, end) in enumerate([(b, e) for e in (False, True) for b in plain] + [(0xC3, False)])}
        self.inner = bytes(code.get((b, False), 255) for b in range(256))
        self.end = bytes(code.get((b, True), 255) for b in range(256))
        chars, ranks = byte_chars(), {}
        for token, number in spec["model"]["vocab"].items():
            ends = token.endswith("</w>")
            data = [chars[c] for c in (token[:-4] if ends else token)]
            if all((b, ends and i == len(data) - 1) in code for i, b in enumerate(data)):
                ranks[bytes(code[b, ends and i == len(data) - 1] for i, b in enumerate(data))] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.slots, self.ids = Slots(), []

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in (chunk,) if chunk.isalpha() else _find_words(chunk):
            data = word.encode()
            coded = data[:-1].translate(self.inner) + data[-1:].translate(self.end)
            if 255 in coded:
                return self._library([chunk])[0]
            ids += self.merge(coded)
        return array("I", ids).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.slots.used > CACHE_CHUNKS:
            self.slots, self.ids = Slots(), []
        out: list[bytes | list[int]] = []
        for text in texts:
            if "<|" in text and any(x in text for x in self.special) or _separators(text):
                out.append(self._library([text])[0])
                continue
            try:
                text.encode("latin-1")
                chunks = text.lower().split()
            except UnicodeEncodeError:  # other letters are lowered by the library
                chunks = [x.lower() if max(x) < "Ā" else x for x in text.split()]
            if chunks and len(max(chunks, key=len)) > CACHE_CHARS:
                out.append(b"".join(map(self._chunk, chunks)))
            else:
                out.append(list(map(self.slots.__getitem__, chunks)))
        new, self.slots.new = self.slots.new, []
        self.ids += map(self._chunk, new)
        of = self.ids.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(of, x)) for x in out]


@kept_in_worker
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class FirstFit:
    """Tournament tree over the free room of bins, all empty at first."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.capacity = capacity
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for the piece, and the piece's offset there."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        room = free[node]
        left = free[node] = room - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            left = max(free[2 * node], free[2 * node + 1])
            if free[node] == left:
                break
            free[node] = left
        return bin_, self.capacity - room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece of 1 to ``capacity`` tokens; ties keep their order."""
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    tree = FirstFit(len(sizes), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        places[i] = tree.put(sizes[i])
    return places


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(documents: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, doc_tokens (with the end id) and the CRC-32 of each piece: all but the last are as long as a sequence."""

    def make():
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
            crcs = [[zlib.crc32(x[i : i + 4 * capacity]) for i in range(0, len(x), 4 * capacity)] for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

        return work

    return map_slices(documents.select("doc_id", "text"), make, "doc_id long, doc_tokens long, crcs array<long>")


def pack(documents: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, group_rows: int = 4096, seed: int = 1) -> DataFrame:
    """Pieces of documents and their places in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document longer than a sequence is cut into full sequences and a rest. A null text is
    empty and consists of the end id alone; a null doc_id stays null; repeated rows are packed
    each for itself, and dealt to groups by place, not by content, so that a third of equal rows does
    no harm; an empty table gives none. Other columns are left out.
    """
    groups = max(1, -(-documents.count() // group_rows))

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        ids, tokens, crcs = (table.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "crcs"))
        full = [n // capacity for n in tokens]
        rest = [i for i, n in enumerate(tokens) if n % capacity]
        where = dict(zip(rest, first_fit_decreasing([tokens[i] % capacity for i in rest], capacity), strict=True))
        rows, sequence, base = [], group << 32, (group << 32) + sum(full)
        for i, n in enumerate(tokens):
            for k in range(full[i]):
                rows.append((ids[i], k * capacity, capacity, crcs[i][k], n, sequence, 0))
                sequence += 1
            if i in where:
                bin_, offset = where[i]
                rows.append((ids[i], full[i] * capacity, n % capacity, crcs[i][-1], n, base + bin_, offset))
        names = [f.split()[0] for f in _PIECES.split(", ")]
        return pa.table({k: pa.array(list(v), pa.int64()) for k, v in zip(names, zip(*rows, strict=True), strict=True)})

    dealt = tokenized(documents, path, end_id, capacity).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, _PIECES)
