"""Searches over several channels: what they shuffle, and their lexical channel against the plain operator."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval as R
from corpusmill.operators import search as X

N, QUERIES = 600, 60
DOC = "doc_id long, w array<string>, dl int, lane string, authority_class string, jurisdiction string, vector array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of common words, every fifth a copy of one text, with queries of 20 words each."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    same = [words[i] for i in rng.integers(0, 120, 60)]
    rows = []
    for i in range(N):
        w = same if i % 5 == 0 else [words[j] for j in rng.integers(0, 120, int(rng.integers(0, 90)))]
        rows.append((i, w, len(w), "legislation" if i % 3 else "other", None, ("UK", "EU", "Scotland")[i % 3], [float(x) for x in rng.normal(size=8)]))
    d = spark.createDataFrame(rows, DOC).repartition(3).localCheckpoint()
    terms = spark.createDataFrame([(q, words[j]) for q in range(QUERIES) for j in rng.choice(120, 20, replace=False)], "query_id long, term string").localCheckpoint()
    vectors = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=8)]) for q in range(QUERIES)], "query_id long, vector array<float>").localCheckpoint()
    edges = d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("REFERENCES").alias("relation"), (F.col("doc_id") + 7).cast("string").alias("target_id"), (0.5 + F.col("doc_id") % 10 / 20.0).alias("confidence"))
    none = F.lit(None).cast("string")
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), none.alias("parent_node_id"), none.alias("document_id"), none.alias("legal_regime"), "jurisdiction")
    return X.Corpus(d.select("doc_id", "w", "dl"), d.select("doc_id", "vector", "lane"), d.select("doc_id", "lane", "authority_class", "jurisdiction"), edges, chunks), terms, vectors


def shuffled(spark, run):
    """What run() returns, and the bytes that were shuffled meanwhile."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    before = written()
    out = run()
    return out, written() - before


def plainly(c, terms, k, by):
    """The k best by the plain operator."""
    return {tuple(r) for r in R.top(R.bm25(c.tokens, terms).join(c.meta, "doc_id"), by, "bm25", k).select("query_id", "doc_id").collect()}


def test_arm_e_shuffles_no_scores_of_all_documents(spark, corpus):
    c, terms, vectors = corpus
    rows, moved = shuffled(spark, lambda: X.searched(c, terms, vectors, **X.ARMS["E"]).collect())
    assert len(rows) == 10 * QUERIES and moved < 1_500_000, moved


def test_arm_f_is_the_same_in_batches_of_queries(spark, corpus, monkeypatch):
    from corpusmill.operators import lexical as L

    c, terms, vectors = corpus
    rows, moved = shuffled(spark, lambda: X.searched(c, terms, vectors, **X.ARMS["F"]).collect())
    assert len(rows) == 10 * QUERIES and moved < 1_500_000, moved
    monkeypatch.setattr(L, "BATCH_TERMS", 700)
    again = L.Lexical(c.tokens, terms)
    assert len(again.batches) == 2 and {(r.query_id, r.doc_id) for r in R.top(again.best(c.meta, 40), ["query_id"], "bm25", 40).collect()} == plainly(c, terms, 40, ["query_id"])


def test_lanes_take_the_plain_operators_best_and_phrases_add_up(spark, corpus):
    from corpusmill.operators import lexical as L

    c, terms, _ = corpus
    by = ["query_id", "lane"]
    assert {(r.query_id, r.doc_id) for r in R.top(L.Lexical(c.tokens, terms).best(c.meta, 30, True), by, "bm25", 30).collect()} == plainly(c, terms, 30, by)
    phrases = spark.createDataFrame([(1, "~a", "w1", 0.9), (1, "~a", "w2", 0.5), (1, "w3", "w3", 1.0), (2, "w2", "w2", 1.0)], "query_id long, phrase string, term string, weight double")
    want = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25(c.tokens, phrases).collect()}
    pairs = spark.range(N).crossJoin(spark.range(1, 4).toDF("query_id")).select("query_id", F.col("id").alias("doc_id"))
    assert {(r.query_id, r.doc_id): r.bm25 for r in L.Lexical(c.tokens, phrases).scores(pairs).collect()} == pytest.approx(want)


def test_only_the_rows_found_stay_in_the_shared_folder(spark, corpus, monkeypatch, tmp_path):
    from corpusmill.sources import files

    c, terms, vectors = corpus
    monkeypatch.setattr(files, "shared_root", lambda spark: str(tmp_path))
    found = X.searched(c, terms, vectors, **X.ARMS["F"])
    assert [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["found"]
    assert found.count() == 10 * QUERIES
