"""Lexical and dense retrieval, score normalisation, fusion and ranking over batches of queries.

Everything is keyed by query_id, so that one plan answers all queries. ``candidates`` frames have
query_id, doc_id, lane and raw scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as C

#: Query vectors that one pass over the documents' vectors holds in a task.
DENSE_BATCH = 4096


def tokenized(docs: DataFrame, words: Column) -> DataFrame:
    """docs with w (words) and dl (their number)."""
    return docs.withColumn("w", words).withColumn("dl", F.size("w"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n documents and their average length."""
    return tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """term and the number of documents that have it."""
    return tokens.select("doc_id", F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, dl, tf for the given terms only; the filter comes before the counts, so rare terms shuffle little."""
    rows = tokens.select("doc_id", "dl", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def bm25(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, bm25 for queries (query_id, term[, weight]); statistics are those of the whole corpus.

    Queries may map several vocabulary terms to one query term (column ``phrase``): their counts are added up
    before the score, and a document counts once, as for prefixes.
    """
    if "phrase" not in queries.columns:
        queries = queries.withColumn("phrase", F.col("term"))
    if "weight" not in queries.columns:
        queries = queries.withColumn("weight", F.lit(1.0))
    found = queries.join(postings(tokens, queries), "term").groupBy("query_id", "phrase", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"), F.max("weight").alias("weight"))
    n_t = found.groupBy("query_id", "phrase").agg(F.count("*").alias("n_t"))
    scored = found.join(n_t, ["query_id", "phrase"]).crossJoin(F.broadcast(corpus_stats(tokens)))  # the statistics are one row
    idf = F.greatest(F.log((F.col("n") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5)), F.lit(C.IDF_FLOOR))
    part = idf * F.col("tf") * (C.K1 + 1) / (F.col("tf") + C.K1 * (1 - C.B + C.B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * part).alias("bm25"))


def top(df: DataFrame, by: list[str], score: str, k: int, rank: str = "rank", tie: str = "doc_id") -> DataFrame:
    """The k best of each group with their rank; scores that agree to 9 decimals tie, and ties go by id."""
    w = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), tie)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, by_lane: bool = False) -> DataFrame:
    """query_id, doc_id[, lane], dense, rank: the k largest cosines of each query (and lane).

    vectors: doc_id, vector[, lane]; queries: query_id, vector. Query vectors go to the tasks in batches of bounded size, each
    with a pass over the documents' vectors; a task keeps k rows a query and lane of each of its Arrow batches.
    """
    spark = vectors.sparkSession
    found, batch, n = None, [], 0

    def one(held: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in held])
        q = np.array([r["vector"] for r in held], float)
        shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches):
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                doc, lanes = b.column(0).to_numpy(), np.array(b.column(2).to_pylist()) if by_lane else np.zeros(b.num_rows, int)
                rows = []
                for lane in np.unique(lanes):
                    of = np.flatnonzero(lanes == lane)
                    if len(of) > 2 * k:
                        edge = np.partition(s[:, of], len(of) - k, axis=1)[:, len(of) - k]
                        i, j = np.nonzero(s[:, of] >= edge[:, None] - 1e-9)
                    else:
                        i, j = (a.ravel() for a in np.indices((len(q), len(of))))
                    rows.append((ids[i], doc[of[j]], s[i, of[j]], np.repeat(lane, len(i))))
                cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cols if by_lane else cols[:3])], ["query_id", "doc_id", "dense", "lane"][: 4 if by_lane else 3])

        columns = ["doc_id", "vector"] + ["lane"] * by_lane
        near = vectors.select(*columns).mapInArrow(run, "query_id long, doc_id long, dense double" + ", lane string" * by_lane)
        return top(near, ["query_id"] + ["lane"] * by_lane, "dense", k)

    for row in queries.select("query_id", "vector").toLocalIterator():
        batch.append(row)
        if len(batch) == DENSE_BATCH:
            found, batch, n = one(batch) if found is None else found.unionByName(one(batch)), [], n + 1
    if batch or found is None:
        if not batch:
            return vectors.select(F.lit(None).cast("long").alias("query_id"), "doc_id", *(["lane"] if by_lane else []), F.lit(0.0).alias("dense"), F.lit(0).alias("rank")).limit(0)
        found = one(batch) if found is None else found.unionByName(one(batch))
    return found


def normalised(raw: Column | str, by: list[str], core: Column | None = None) -> Column:
    """(tanh of the z-score + 1) / 2 within the group; ``core`` marks rows whose mean and deviation hold for all. No deviation counts as 1."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    basis = raw if core is None else F.when(core, raw)
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(basis).over(w)
    z = (raw - F.avg(basis).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 1.0).otherwise(sd)
    return (F.tanh(z) + 1) / 2


def fused(pool: DataFrame, by: list[str], alpha: float = C.ALPHA_DEFAULT, beta: float = C.BM25_WEIGHT, juris: bool = True, core: Column | None = None) -> DataFrame:
    """Adds bm25_norm, dense_norm, fusion_score, authority_norm and final_score; needs bm25, dense, authority and jurisdiction weights."""
    pool = pool.withColumns({"bm25_norm": normalised("bm25", by, core), "dense_norm": normalised("dense", by, core), "authority_norm": normalised("authority_weight", by)})
    pool = pool.withColumn("fusion_score", beta * F.col("bm25_norm") + (1 - beta) * F.col("dense_norm"))
    final = F.col("fusion_score") * (1 - alpha) + F.col("authority_norm") * alpha
    return pool.withColumn("final_score", final * F.col("jurisdiction_weight") if juris else final)


def promoted(ranked: DataFrame, by: list[str], rank: str = "rank", top_n: int = 3) -> DataFrame:
    """Moves each group's best legislation row to rank 1 if none is among the first ``top_n``; the rest keep their order."""
    w = Window.partitionBy(*by)
    is_leg = F.col("lane") == "legislation"
    best = F.min(F.when(is_leg, F.col(rank))).over(w)
    move = best > top_n
    key = F.when(move & (F.col(rank) == best), 0).otherwise(F.col(rank))
    return ranked.withColumn("promoted_key", key).withColumn("promoted_rank", F.row_number().over(Window.partitionBy(*by).orderBy("promoted_key"))).drop("promoted_key")


def rrf(ranked: list[DataFrame], k: int = C.RRF_K) -> DataFrame:
    """query_id, doc_id, rrf: sums of 1 / (k + rank) over rankings (query_id, doc_id, rank)."""
    rows = ranked[0].select("query_id", "doc_id", "rank")
    for r in ranked[1:]:
        rows = rows.unionByName(r.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def min_max(c: str, by: list[str], inside: Column) -> Column:
    """Scaled to 0..1 over the rows ``inside``; a constant gives 0.5."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(F.when(inside, F.col(c))).over(w), F.max(F.when(inside, F.col(c))).over(w)
    return F.when(hi - lo < 1e-12, 0.5).otherwise((F.col(c) - lo) / (hi - lo))


def reranked(ranked: DataFrame, by: list[str], ce: str = "ce_score", lam: float | None = None, depth: int = 75, rank: str = "rank") -> DataFrame:
    """post_rank: rows with a reranker score within ``depth`` first, by score (or its blend with final_score), the rest in their old order."""
    head = F.col(ce).isNotNull() & (F.col(rank) <= depth)
    score = F.col(ce) if lam is None or lam >= 1 else lam * min_max(ce, by, head) + (1 - lam) * min_max("final_score", by, head)
    w = Window.partitionBy(*by).orderBy((~head).cast("int"), F.when(head, F.round(score, 9)).desc_nulls_last(), rank)
    return ranked.withColumn("post_rank", F.row_number().over(w))


def scored_against_pool(pool: DataFrame, extra: DataFrame, by: list[str], alpha: float = C.ALPHA_DEFAULT, beta: float = C.BM25_WEIGHT) -> DataFrame:
    """by, doc_id, final_score and rank_if_inserted of extra rows, scored with the pool's own statistics, which they don't change.

    Both need bm25, dense, authority_weight and jurisdiction_weight. The authority scale covers pool and extra rows.
    """
    rows = pool.select(*by, "doc_id", "bm25", "dense", "authority_weight", "jurisdiction_weight").withColumn("core", F.lit(True))
    rows = rows.unionByName(extra.select(*by, "doc_id", "bm25", "dense", "authority_weight", "jurisdiction_weight").withColumn("core", F.lit(False)))
    scored = fused(rows, by, alpha, beta, core=F.col("core"))
    better = F.count(F.when(F.col("core"), 1)).over(Window.partitionBy(*by).orderBy(F.desc("final_score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count(F.when(F.col("core"), 1)).over(Window.partitionBy(*by, "final_score"))
    return scored.withColumn("rank_if_inserted", better + 1).where(~F.col("core")).select(*by, "doc_id", "final_score", "rank_if_inserted")


def category_boosted(ranked: DataFrame, predicted: Column, factor: float, ce: str = "ce_score") -> DataFrame:
    """Multiplies the reranker's score where the document's authority class is among the query's predicted ones."""
    return ranked.withColumn(ce, F.when(F.array_contains(predicted, F.col("authority_class")), F.col(ce) * factor).otherwise(F.col(ce)))
