"""Queries on retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.operators import retrieval as R
from corpusmill.plans import corpus as K

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(f"WITH {K.SQL_TOKENS} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok) GROUP BY term")
def vocab_df(spark: SparkSession, sf: str) -> DataFrame:
    return R.vocabulary(K.tokens(spark, sf))


@query(f"WITH {K.SQL_TOKENS} SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM tok")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.corpus_stats(K.tokens(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


_BM25 = ", ".join((K.SQL_DOCS, K.SQL_TOKENS, K.SQL_QUERY, K.SQL_BM25))


@query(f"WITH {_BM25}, r AS (SELECT query_id, doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS INTEGER) AS rank FROM lex) SELECT * FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(R.bm25(K.tokens(spark, sf), K.query_terms(spark, sf)), ["query_id"], "bm25", 10).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"""WITH {_BM25}, s AS (SELECT query_id, lane, doc_id, bm25, {K.sql_norm('bm25', 'query_id, lane')} AS norm FROM lex JOIN d USING (doc_id)),
    r AS (SELECT query_id, lane, doc_id, round(bm25, 6) AS bm25, round(norm, 6) AS bm25_norm, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY round(bm25, 9) DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def bm25_two_lane_topk(spark: SparkSession, sf: str) -> DataFrame:
    by = ["query_id", "lane"]
    scored = R.bm25(K.tokens(spark, sf), K.query_terms(spark, sf)).join(K.docs(spark, sf).select("doc_id", "lane"), "doc_id").withColumn("bm25_norm", R.normalised("bm25", by))
    return R.top(scored, by, "bm25", 10).select("query_id", "lane", "doc_id", F.round("bm25", 6).alias("bm25"), F.round("bm25_norm", 6).alias("bm25_norm"), "rank")


_SPARSE = ", ".join((K.SQL_TOKENS, K.SQL_QUERY))


@query(f"""WITH {_SPARSE}, voc AS (SELECT term AS v, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok) GROUP BY term),
    ex AS (SELECT query_id, q.term AS phrase, voc.v AS term FROM q LEFT JOIN voc own ON own.v = q.term JOIN voc ON voc.v = q.term OR (coalesce(own.df, 0) < {C.SPARSE_DOCS} AND starts_with(voc.v, q.term)))
    , r0 AS (SELECT * FROM ex),
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    post AS (SELECT t AS term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM tok) WHERE t IN (SELECT term FROM ex) GROUP BY ALL),
    f AS (SELECT query_id, phrase, doc_id, sum(tf) AS tf, max(dl) AS dl FROM ex JOIN post USING (term) GROUP BY ALL),
    nt AS (SELECT query_id, phrase, count(*) AS n_t FROM f GROUP BY ALL),
    lex AS (SELECT query_id, doc_id, sum(greatest(ln((n - n_t + 0.5) / (n_t + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM f JOIN nt USING (query_id, phrase), st GROUP BY query_id, doc_id),
    r AS (SELECT query_id, doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS INTEGER) AS rank FROM lex) SELECT * FROM r WHERE rank <= 10""")
def bm25_prefix_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Terms in fewer than five documents match all words that begin with them, as one phrase."""
    tokens, terms = K.tokens(spark, sf), K.query_terms(spark, sf)
    vocab = R.vocabulary(tokens)
    sparse = terms.join(vocab, "term", "left").where(F.coalesce("df", F.lit(0)) < C.SPARSE_DOCS).select("query_id", F.col("term").alias("phrase"))
    # prefixes by an equality join: a word is split into its beginnings of the lengths that the sparse terms have
    lengths = [r["n"] for r in sparse.select(F.length("phrase").alias("n")).distinct().collect()]
    heads = vocab.select("term", F.explode(F.array(*(F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")).alias("phrase")).where(F.col("phrase").isNotNull())
    expanded = terms.withColumn("phrase", F.col("term")).select("query_id", "phrase", "term").union(sparse.join(heads, "phrase").select("query_id", "phrase", "term")).distinct()
    return R.top(R.bm25(tokens, expanded), ["query_id"], "bm25", 10).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "rank")


@query(f"""WITH {', '.join((K.SQL_DOCS, K.SQL_DENSE))}, r AS (SELECT query_id, doc_id, round(dense, 6) AS dense, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, doc_id) AS INTEGER) AS rank FROM den) SELECT * FROM r WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_top(K.vectors(spark, sf), K.query_vectors(spark, sf), 10).select("query_id", "doc_id", F.round("dense", 6).alias("dense"), "rank")


@query(f"""WITH {', '.join((K.SQL_DOCS, K.SQL_DENSE))}, r AS (SELECT query_id, lane, doc_id, round(dense, 6) AS dense, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY round(dense, 9) DESC, doc_id) AS INTEGER) AS rank FROM den) SELECT * FROM r WHERE rank <= 10""")
def dense_two_lane(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_top(K.vectors(spark, sf), K.query_vectors(spark, sf), 10, by_lane=True).select("query_id", "lane", "doc_id", F.round("dense", 6).alias("dense"), "rank")


_COLS = "query_id, doc_id, round(bm25, 6) AS bm25, round(dense, 6) AS dense, round(fusion_score, 6) AS fusion_score, round(final_score, 6) AS final_score, CAST(rank AS INTEGER) AS rank"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", *more, "doc_id", *(F.round(c, 6).alias(c) for c in ("bm25", "dense", "fusion_score", "final_score")), "rank")


@query(f"WITH {K.sql_hub()}, {K.sql_fused('query_id', 0.0, juris=False)} SELECT {_COLS} FROM ranked WHERE rank <= 20")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled lexical and dense fusion without authority."""
    return _shown(R.top(R.fused(K.candidates(spark, sf), ["query_id"], 0.0, juris=False), ["query_id"], "final_score", 20))


@query(f"WITH {K.sql_hub()}, {K.sql_fused('query_id', C.ALPHA_DEFAULT)} SELECT {_COLS} FROM ranked WHERE rank <= 20")
def hybrid_authority_jurisdiction(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.top(R.fused(K.candidates(spark, sf), ["query_id"], C.ALPHA_DEFAULT), ["query_id"], "final_score", 20))


@query(f"WITH {K.sql_ranked(C.CANDIDATES)} SELECT lane, {_COLS} FROM ranked WHERE rank <= 25")
def two_lane_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each lane retrieved and ranked by itself, 25 results a lane."""
    return _shown(K.ranked(spark, sf, k=C.CANDIDATES).where("rank <= 25"), "lane")


@query(f"""WITH {K.sql_hub()}, {K.sql_fused('query_id', C.ALPHA_DEFAULT)}, b AS (SELECT *, min(CASE WHEN lane = 'legislation' THEN rank END) OVER (PARTITION BY query_id) AS best FROM ranked),
    p AS (SELECT query_id, doc_id, lane, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best > 3 AND rank = best THEN 0 ELSE rank END) AS INTEGER) AS promoted_rank FROM b) SELECT * FROM p WHERE promoted_rank <= 10""")
def lane_promotion(spark: SparkSession, sf: str) -> DataFrame:
    ranked = R.top(R.fused(K.candidates(spark, sf), ["query_id"], C.ALPHA_DEFAULT), ["query_id"], "final_score", 1 << 30)
    return R.promoted(ranked, ["query_id"]).where("promoted_rank <= 10").select("query_id", "doc_id", "lane", "rank", "promoted_rank")


_GRID = [(0.0, 0.4, False), (0.1, 0.4, True), (0.2, 0.4, True), (0.3, 0.4, True), (0.4, 0.4, True), (0.0, 1.0, False), (0.0, 0.0, False)]
_GRID_SQL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {j})" for a, b, j in _GRID)


@query(f"""WITH {K.sql_hub(C.CANDIDATES_FROZEN)}, g AS (SELECT * FROM (VALUES {_GRID_SQL}) t(alpha, beta, juris)),
    nrm AS (SELECT *, {K.sql_norm('bm25', 'query_id, lane')} AS bm25_norm, {K.sql_norm('dense', 'query_id, lane')} AS dense_norm, {K.sql_norm('authority_weight', 'query_id, lane')} AS authority_norm FROM cand),
    s AS (SELECT *, ((beta * bm25_norm + (1 - beta) * dense_norm) * (1 - alpha) + authority_norm * alpha) * CASE WHEN juris THEN jurisdiction_weight ELSE 1 END AS score FROM nrm, g),
    r AS (SELECT alpha, beta, juris, query_id, lane, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY alpha, beta, juris, query_id, lane ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All parameter settings in one plan: normalised once, scored for every row of a small grid."""
    by = ["query_id", "lane"]
    pool = K.candidates(spark, sf, C.CANDIDATES_FROZEN).withColumns({"bm25_norm": R.normalised("bm25", by), "dense_norm": R.normalised("dense", by), "authority_norm": R.normalised("authority_weight", by)})
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(j).alias("juris")) for a, b, j in _GRID)))
    swept = pool.withColumn("g", grid).select("*", "g.*").drop("g")
    score = ((F.col("beta") * F.col("bm25_norm") + (1 - F.col("beta")) * F.col("dense_norm")) * (1 - F.col("alpha")) + F.col("authority_norm") * F.col("alpha")) * F.when(F.col("juris"), F.col("jurisdiction_weight")).otherwise(1.0)
    keys = ["alpha", "beta", "juris", *by]
    return R.top(swept.withColumn("score", score), keys, "score", 5).select(*keys, "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {K.sql_hub()}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM lex), b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, doc_id) AS r FROM den),
    u AS (SELECT query_id, doc_id, sum(1.0 / (60 + r)) AS rrf FROM (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50) GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round(rrf, 8) AS rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, doc_id) AS INTEGER) AS rank FROM u) SELECT * FROM r WHERE rank <= 10""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    lexical = R.top(R.bm25(K.tokens(spark, sf), K.query_terms(spark, sf)), ["query_id"], "bm25", 50)
    near = R.dense_top(K.vectors(spark, sf), K.query_vectors(spark, sf), 50)
    return R.top(R.rrf([lexical, near]), ["query_id"], "rrf", 10).select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"), "rank")
