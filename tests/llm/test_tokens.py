"""Token counts, BPE and packing against the public libraries, on odd texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import bpe, packing, token_counts
from corpusmill.llm.int_table import IntTable

ODD = ["", " ", "a", "  a  b\n\n c ", "it's don't I'LL 'S", "aaa aaaaaaaaa bbbb", "日本語テキスト 漢字", "<|endoftext|>x<|endoftext|>", "é́ à b\u00a0c", "x\t y\r\n  z", "12345 67 ²³ ½", "😀😀", "a" * 3000, "\x00\x01 \x7f", " lead", "trail ", "a\x1cb c\x85d", "ΣΑΣ İx", "ÀÉÑÜ ß µ ª", "don’t — “q” …", "word " * 3000]
SCHEMA = "doc_id long, text string, n_tokens string, ids string"


def documents(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(None, "null id", None, None), (500, None, None, None), (0, "", "repeat", ""), (0, "", "repeat", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_int_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    t = IntTable(keys[:100], np.arange(100))
    t.insert(keys[100:], np.arange(100, len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_counts(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(documents(spark), path, 512).collect()
    assert len(got) == len(ODD) + 4
    for r in got:
        text = "null id" if r.doc_id is None else "" if r.doc_id == 500 else ODD[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 512)
    assert token_counts.count_tokens(documents(spark).limit(0), path).count() == 0


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    library, path = reference(), P.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip_digests(documents(spark), path).collect()
    assert len(got) == len(ODD) + 4
    for r in got:
        text = "null id" if r.doc_id is None else "" if r.doc_id == 500 else ODD[r.doc_id]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    kept = bpe.encode_documents(documents(spark), path)
    assert {bytes(r.data) for r in bpe.decode_ids(kept, path).collect()} == {t.encode() for t in ODD + ["null id"]}
    assert bpe.round_trip_digests(documents(spark).limit(0), path).count() == 0


_tables = bpe.PrefixTables.from_file(P.path("byte_bpe_50k.tiktoken"))
_merge = reference()._core_bpe.encode_single_piece


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=10), st.integers(0, 60), st.integers(0, 60))
def test_prefixes_append_and_replace(data, more, a, b):
    e = bpe.PrefixEncoding(_tables, data)
    assert e.tokens() == _merge(data)
    e.append(more)
    assert e.tokens() == _merge(data + more)
    a, b = sorted((min(a, len(e.data)), min(b, len(e.data))))
    e.replace(a, b, more)
    whole = (data + more)[:a] + more + (data + more)[b:]
    assert e.data == whole and e.tokens() == (_merge(whole) if whole else [])


def test_an_edit_of_a_long_text_redoes_little():
    data = (" ".join(f"word{i} and some more" for i in range(3000))).encode()
    e = bpe.PrefixEncoding(_tables, data)
    for start, stop, new in ((100, 104, b"xy"), (30_000, 30_000, b"inserted"), (50_000, 50_007, b"")):
        assert e.replace(start, stop, new) < 10 * _tables.longest
        data = data[:start] + new + data[stop:]
        assert e.data == data and e.tokens() == _merge(data)


def test_first_fit_tree():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 300).tolist()
    free, want = [], [None] * 300
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(documents(spark), path, end_id=2, capacity=256, group_rows=8).toPandas()
    want = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")[i : i + 256].tobytes()) for t in [*ODD, "null id", "", "", ""] for i in range(0, len(library.encode(t, add_special_tokens=False).ids) + 1, 256))
    assert sorted(got.ids_crc32) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 256
    one = got[got.doc_id == 20].sort_values("start")
    assert (one.start == one.length.cumsum() - one.length).all() and one.length.sum() == one.doc_tokens.iloc[0]
    assert packing.pack(documents(spark).limit(0), path).count() == 0
