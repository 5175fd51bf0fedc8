"""Language ID, toxicity, Jaccard join and fingerprints on small fixtures."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, fingerprints, jaccard_join, langid, packing, toxicity
from corpusmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, score string, key string"
WORDS = {"en": "the of and house with water from under stone light never", "fr": "le des maison avec eau sous pierre lumière jamais être où", "de": "der und das haus mit wasser unter stein licht niemals für"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split(), n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, lang, 40), lang, "s", "x", "x") for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 120))]
    rows += [(200, None, "en", None, None, None), (201, "", "en", None, None, None), (202, "½ ² 3 Ⅷ ①", "fr", None, None, None), (203, prose(rng, "de", 40), None, None, None, None), (None, prose(rng, "fr", 40), "fr", None, None, None), (3, rows[3][1], "en", "s", "x", "x"), (204, prose(rng, "en", 20000), None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language(languages):
    got = langid.identify(languages).collect()
    assert len(got) == 127
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        want = "fr" if r.doc_id is None else {200: "und", 201: "und", 202: "und", 203: "de", 204: "en"}.get(r.doc_id) or list(WORDS)[r.doc_id % 3]
        assert r.lang_pred == want
    kept = langid.predict(languages, langid.learn(languages), keep_columns=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "key", "lang_pred", "score"] and kept.count() == 127
    assert langid.identify(languages.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(languages.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_scores_of_a_dense_kernel_ridge(spark):
    """With all training rows as landmarks, the Nystroem form is the kernel ridge regression itself."""
    rng = np.random.default_rng(9)
    spectrum = langid.Spectrum()
    texts, names = zip(*((prose(rng, lang, 8), lang) for lang in WORDS for _ in range(25)), strict=True)
    x = spectrum.presence(list(texts)).astype(float)
    model = langid.fit(np.packbits(x.astype(np.uint8), axis=1), list(names), spectrum, landmarks_each=25, ridge=1.0)
    size = np.sqrt(x.sum(1))
    k = x @ x.T / np.outer(size, size)
    target = np.where(np.array(names)[:, None] == np.array(sorted(WORDS)), 1.0, -1.0)
    alpha = np.linalg.solve(k + 1.0 * len(texts) / 100 * np.eye(len(texts)), target)
    new = [prose(rng, lang, 5) for lang in WORDS for _ in range(10)] + ["der house le", "water"]
    y = spectrum.presence(new).astype(float)
    f = (y @ x.T / np.outer(np.sqrt(y.sum(1)), size)) @ alpha
    p = np.exp(4 * f) / np.exp(4 * f).sum(1, keepdims=True)
    got = model.scorer()(new)
    assert [g for g, _ in got] == [sorted(WORDS)[i] for i in f.argmax(1)] and np.allclose([s for _, s in got], p.max(1), atol=1e-3)


def test_held_out_rows_teach_nothing(languages):
    changed = languages.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.identify(changed).collect()} <= {"en", "fr", "de", "und"}


def test_folding_and_exceptions():
    assert toxicity.fold("An 1D10T, іdіоt i$!") == " an idiot  idiot i   "
    m = toxicity.Model(tuple((t, 5.0) for t in toxicity.SEED_TERMS), (-3.0, 3.0, 0.5, 1.0))
    m = m.scorer()
    assert m.score("you stup1d fool") > 0.5 > m.score("put it into the trash can") and m.score(None) == m.score("") < 0.5
    assert m.score("what trash") > 0.5 and m.score("trashy") < 0.5


def test_matches_of_a_plain_search():
    rng = np.random.default_rng(7)
    terms = tuple((t, float(w)) for w, t in enumerate(("bad", "badly ", "ill ", "illness", "scum ", "trash ", "fire"), 1))
    words = ["bad", "badly", "badness", "ill", "illness", "trash", "can", "pond", "scum", "fire", "retard", "line", "x"]
    scorer = toxicity.Model(terms, (0.0, 1, 1, 1)).scorer()
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(words, 12)))
        spared = [range(i, i + len(p) + 1) for p in toxicity.EXCEPTIONS for i in range(len(folded)) if folded.startswith(f" {p}", i)]
        want = {}
        for i in range(len(folded)):
            at = max(((len(t) + 1, w) for t, w in terms if folded.startswith(f" {t}", i)), default=None)
            if at and not any(i in s for s in spared):
                want[i] = (at[1], at[0])
        assert scorer.hits(folded) == want
    assert scorer.features("bad " * 50_000)[2] == pytest.approx(np.log1p(1))


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = prose(rng, "en", 60).split()
        if bad:
            words[rng.integers(60)] = "zorgblatt" + "abcdefghij"[i % 10]
        rows.append((i, " ".join(words), "en", "s", "x", "x"))
        labels.append((i, 1, int(bad)))
    rows += [(400, None, None, None, None, None), (401, "", None, None, None, None), (None, "zorgblatty", None, None, None, None), (402, "such an idiot", None, None, None, None), (0, rows[0][1], "en", "s", "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (299, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, lab).collect()
    assert len(got) == 305
    for r in got:
        bad = r.doc_id in (None, 402) or r.doc_id < 300 and r.doc_id % 5 == 0
        assert (r.predicted, r.predicted) == (int(bad), int(r.score >= 0.5)) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    assert toxicity.judge(docs.limit(0), lab).count() == 0 and toxicity.judge(docs, lab.limit(0)).where("predicted = 1").count() == 1
    assert toxicity.score(docs, toxicity.Model((), (0.0, 0, 0, 0)), keep_columns=True).columns == [*docs.columns, "toxicity"]


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute_components(ids, texts, n, percent):
    s = sets_of(texts, n)
    label = list(range(len(s)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a, b in itertools.combinations(range(len(s)), 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            label[find(b)] = find(a)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [d if not s[i] else least.get(find(i)) for i, d in enumerate(ids)], [len(x) for x in s]


def near_copies():
    rng = np.random.default_rng(2)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "two words", "x\u00a0y z", "É É é"]
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(1, 9)):  # edits on both sides of the threshold
            copy = list(base)
            for p in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[p] = f"e{rng.integers(9)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {prose(rng, 'en', int(k))}" for k in rng.integers(1, 60, 12)] + ["same same same same"] * 20 + [prose(rng, "fr", 9000)]
    return texts


def test_jaccard_join_against_brute_force(spark):
    texts = near_copies()
    ids = [None if i % 17 == 5 else (i * 37) % 1000 for i in range(len(texts))]
    docs = spark.createDataFrame([(d, t, "en", "s", "x", "x") for d, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    want, sizes = brute_components(ids, texts, 3, 90)
    got = jaccard_join.linked(docs, 3, 90).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(zip(ids, sizes, want, strict=True), key=key)


def test_one_of_near_copies_stays(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "x") for i, t in enumerate(texts)] + [(30, texts[30], "en", "s", "x", "x")], SCHEMA)
    want, _ = brute_components(list(range(len(texts))), texts, 5, 80)
    kept = jaccard_join.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want})


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.linked(docs).count() == 0 and jaccard_join.without_near_copies(docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {5} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {k: v for k, v in label.items() if k is not None and k not in alone and any(k in e for e in edges if None not in e and e[0] != e[1])} and len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    sets = lambda t: {tuple(x) for x in sets_of([t], 5)[0]}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = sets(t.lower()), sets(other.lower())
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < (1e-9 if len(a | b) <= 128 and len(a) < 128 and len(b) < 128 else 0.2)
    assert got[6].fingerprint == got[5].fingerprint and got[0].fingerprint == got[1].fingerprint == ""
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    single = fingerprints.fingerprints(docs.where("doc_id = 20")).first()
    assert single.near_next == 1.0
    odd = spark.createDataFrame([(1, "a b", None, None, None, None), (1, "c d", None, None, None, None), (None, "e f", None, None, None, None), (1, "a b", None, None, None, None)], SCHEMA)
    assert fingerprints.fingerprints(odd).count() == 4


def test_sketches_merge_and_estimate(spark):
    a, b = (" ".join(f"t{i}" for i in range(x, x + 3000)) for x in (0, 1500))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    sa, sb = (fingerprints.sketch(fingerprints.shingle_hashes(F.col(c), 1), 256) for c in "ab")
    both = fingerprints.sketch(F.array_union(fingerprints.shingle_hashes(F.col("a"), 1), fingerprints.shingle_hashes(F.col("b"), 1)), 256)
    r = df.select((fingerprints.merge(sa, sb, 256) == both).alias("m"), fingerprints.resemblance(sa, sb, 256).alias("j"), fingerprints.containment(sa, sb, 256).alias("c"), fingerprints.distinct_count(sa, 256).alias("n"), (fingerprints.decoded(fingerprints.encoded(sa)) == sa).alias("d")).first()
    assert r.m and r.d and abs(r.j - 1 / 3) < 0.12 and abs(r.c - 0.5) < 0.15 and abs(r.n - 3000) < 700


def test_a_worker_drops_what_another_operator_kept_there():
    class Here:
        """Runs what would be a task in this process."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], ["doc_id", "text"])
    packing._encoder.cache_clear()
    for _ in range(2):
        assert sum(b.num_rows for b in packing.tokenized(Here(), path, 2, 4096)([texts])) == 2
    assert packing._encoder.cache_info()[:2] == (1, 1)
    assert [b.num_rows for b in common.map_slices(Here(), lambda: lambda batch: batch, "")([texts])] == [2]
    assert packing._encoder.cache_info().currsize == 0
