"""Queries that measure retrieval against gold targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.operators import metrics as M
from corpusmill.operators import retrieval as R
from corpusmill.plans import corpus as K
from corpusmill.sources.files import written

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, requirement_id (the lane of the target), doc_id."""
    return K.gold(spark, sf).join(K.docs(spark, sf).select("doc_id", "lane"), "doc_id").select("query_id", F.col("lane").alias("requirement_id"), "doc_id")


#: A stand-in for a reranker: the share of the query's terms that a document has.
def overlap_scores(spark: SparkSession, sf: str) -> DataFrame:
    terms = K.query_terms(spark, sf)
    n = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = terms.join(R.postings(K.tokens(spark, sf), terms), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return hits.join(n, "query_id").select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("ce_score"))


def reranked(spark: SparkSession, sf: str, lam: float | None = None) -> DataFrame:
    return R.reranked(K.ranked(spark, sf).join(overlap_scores(spark, sf), ["query_id", "doc_id"], "left"), ["query_id", "lane"], lam=lam)


_EVAL = f"{K.sql_ranked()}, {K.SQL_GOLD}, tgt AS (SELECT query_id, lane AS requirement_id, doc_id FROM gold JOIN d USING (doc_id))"
_CE = """
    qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
    ce AS (SELECT query_id, doc_id, c / n AS ce_score FROM (SELECT query_id, doc_id, count(*) AS c FROM q JOIN post USING (term) GROUP BY ALL) JOIN qn USING (query_id)),
    rc AS (SELECT ranked.*, ce_score, ce_score IS NOT NULL AND rank <= 75 AS head FROM ranked LEFT JOIN ce USING (query_id, doc_id)),
    post_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY CASE WHEN head THEN 0 ELSE 1 END, CASE WHEN head THEN round(ce_score, 9) END DESC NULLS LAST, rank) AS post_rank FROM rc)"""


@query(f"""WITH {_EVAL}, h AS (SELECT tgt.query_id, requirement_id, bool_or(ranked.doc_id IS NOT NULL) AS hit FROM tgt LEFT JOIN ranked ON ranked.query_id = tgt.query_id AND ranked.doc_id = tgt.doc_id AND rank <= 25 GROUP BY ALL)
    SELECT query_id, CAST(sum(hit::INT) AS BIGINT) AS n_satisfied, count(*) AS n_total, round(avg(hit::INT), 6) AS recall, min(hit::INT) AS complete FROM h GROUP BY query_id""")
def requirement_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = M.coverage(M.requirement_hits(K.ranked(spark, sf), targets(spark, sf), 25))
    return c.withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_EVAL}, ks AS (SELECT unnest([1, 5, 10, 25]) AS k), h AS (SELECT k, tgt.query_id, requirement_id, bool_or(ranked.doc_id IS NOT NULL) AS hit FROM tgt CROSS JOIN ks LEFT JOIN ranked ON ranked.query_id = tgt.query_id AND ranked.doc_id = tgt.doc_id AND rank <= k GROUP BY ALL),
    s AS (SELECT k, query_id, sum(hit::INT) AS s, count(*) AS t, min(hit::INT) AS c FROM h GROUP BY ALL) SELECT CAST(k AS INTEGER) AS k, round(sum(s) / sum(t), 6) AS micro, round(avg(s / t), 6) AS macro, round(avg(c), 6) AS complete FROM s GROUP BY k""")
def complete_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Micro and macro recall of requirements and complete coverage at several depths, ranked once."""
    best = K.ranked(spark, sf).select("query_id", "doc_id", "rank")
    h = targets(spark, sf).join(best, ["query_id", "doc_id"], "left").groupBy("query_id", "requirement_id").agg(F.min("rank").alias("first"))
    h = h.withColumn("k", F.explode(F.array(*(F.lit(k) for k in (1, 5, 10, 25))))).withColumn("hit", F.coalesce((F.col("first") <= F.col("k")).cast("int"), F.lit(0)))
    s = h.groupBy("k", "query_id").agg(F.sum("hit").alias("s"), F.count("*").alias("t"), F.min("hit").alias("c"))
    return s.groupBy("k").agg(F.round(F.sum("s") / F.sum("t"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("t")), 6).alias("macro"), F.round(F.avg("c"), 6).alias("complete"))


@query(f"""WITH {_EVAL}, h AS (SELECT tgt.query_id, requirement_id, bool_or(coalesce(rank <= 5, false)) AS hit FROM tgt LEFT JOIN ranked ON ranked.query_id = tgt.query_id AND ranked.doc_id = tgt.doc_id GROUP BY ALL),
    m AS (SELECT query_id, bool_or(requirement_id = 'legislation') AND bool_or(requirement_id = 'other') AS mixed, bool_and(hit) AS all_hit, bool_or(hit AND requirement_id = 'legislation') AS law, bool_or(hit AND requirement_id = 'other') AS guide FROM h GROUP BY query_id)
    SELECT query_id, law AND guide AS any_any, all_hit AS all_all FROM m WHERE mixed""")
def dual_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with targets in both lanes: some hit on either side, and every requirement hit, at 5 a lane."""
    h = M.requirement_hits(K.ranked(spark, sf), targets(spark, sf), 5)
    law, other = F.col("requirement_id") == "legislation", F.col("requirement_id") == "other"
    m = h.groupBy("query_id").agg((F.bool_or(law) & F.bool_or(other)).alias("mixed"), F.bool_and("hit").alias("all_all"), F.bool_or(F.col("hit") & law).alias("law"), F.bool_or(F.col("hit") & other).alias("guide"))
    return m.where("mixed").select("query_id", (F.col("law") & F.col("guide")).alias("any_any"), "all_all")


@query(f"""WITH {_EVAL}, g AS (SELECT DISTINCT query_id, lane, doc_id FROM gold JOIN d USING (doc_id)), gn AS (SELECT query_id, lane, count(*) AS n_gold FROM g GROUP BY ALL), ks AS (SELECT unnest({list(C.K_LIST)}) AS k),
    r AS (SELECT ranked.query_id, ranked.lane, rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM ranked LEFT JOIN g ON g.query_id = ranked.query_id AND g.doc_id = ranked.doc_id),
    a AS (SELECT query_id, lane, k, sum(rel) / count(*) AS p, sum(rel / log2(rank + 1)) AS dcg FROM r, ks WHERE rank <= k GROUP BY ALL),
    i AS (SELECT query_id, lane, k, dcg, p, list_sum(list_transform(range(1, CAST(least(k, n_gold) AS BIGINT) + 1), lambda x: 1 / log2(x + 1))) AS idcg FROM a JOIN gn USING (query_id, lane))
    SELECT lane, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(p), 6) AS precision_at_k, round(avg(dcg / idcg), 6) AS ndcg FROM i GROUP BY lane, k""")
def ir_metrics_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Binary precision and nDCG a lane over several depths; lanes without gold are left out."""
    g = targets(spark, sf).distinct().withColumnRenamed("requirement_id", "lane")
    n_gold = g.groupBy("query_id", "lane").agg(F.count("*").alias("n_gold"))
    r = K.ranked(spark, sf).select("query_id", "lane", "doc_id", "rank").join(g.withColumn("rel", F.lit(1)), ["query_id", "lane", "doc_id"], "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in C.K_LIST)))).where("rank <= k")
    rel = F.coalesce("rel", F.lit(0))
    a = r.groupBy("query_id", "lane", "k").agg((F.sum(rel) / F.count("*")).alias("p"), F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg")).join(n_gold, ["query_id", "lane"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    return a.groupBy("lane", "k").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision_at_k"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))


@query(f"""WITH {_EVAL}, b AS (SELECT gold.query_id, min(rank) AS first FROM gold LEFT JOIN ranked ON ranked.query_id = gold.query_id AND ranked.doc_id = gold.doc_id GROUP BY 1)
    SELECT query_id, coalesce(round(1 / first, 6), 0.0) AS mrr, coalesce(first <= 10, false) AS hit_10 FROM b""")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank of the first gold document; a miss is 0, queries without gold have no row."""
    first = K.gold(spark, sf).join(K.ranked(spark, sf).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("first") <= 10, F.lit(False)).alias("hit_10"))


@query(f"WITH {K.sql_ranked()}, {_CE} SELECT query_id, lane, doc_id, CAST(rank AS INTEGER) AS rank, CAST(post_rank AS INTEGER) AS post_rank FROM post_ WHERE post_rank <= 10")
def rerank_order(spark: SparkSession, sf: str) -> DataFrame:
    return reranked(spark, sf).where("post_rank <= 10").select("query_id", "lane", "doc_id", "rank", "post_rank")


@query(f"""WITH {K.sql_ranked()}, {_CE}, mm AS (SELECT *, min(CASE WHEN head THEN ce_score END) OVER w AS cl, max(CASE WHEN head THEN ce_score END) OVER w AS chi, min(CASE WHEN head THEN final_score END) OVER w AS fl, max(CASE WHEN head THEN final_score END) OVER w AS fh FROM rc WINDOW w AS (PARTITION BY query_id, lane)),
    s AS (SELECT *, 0.5 * CASE WHEN chi - cl < 1e-12 THEN 0.5 ELSE (ce_score - cl) / (chi - cl) END + 0.5 * CASE WHEN fh - fl < 1e-12 THEN 0.5 ELSE (final_score - fl) / (fh - fl) END AS blend FROM mm),
    o AS (SELECT query_id, lane, doc_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id, lane ORDER BY CASE WHEN head THEN 0 ELSE 1 END, CASE WHEN head THEN round(blend, 9) END DESC NULLS LAST, rank) AS INTEGER) AS post_rank FROM s) SELECT * FROM o WHERE post_rank <= 10""")
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    return reranked(spark, sf, lam=0.5).where("post_rank <= 10").select("query_id", "lane", "doc_id", "rank", "post_rank")


@query(f"""WITH {K.sql_ranked()}, {_CE} SELECT coalesce(authority_class, 'NONE') AS authority_class, count(*) AS n, round(avg(post_rank - rank), 6) AS mean_move, CAST(quantile_cont(post_rank - rank, 0.5) AS DOUBLE) AS median_move,
    CAST(sum(CASE WHEN rank > 25 AND post_rank <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS moved_in, CAST(sum(CASE WHEN rank <= 25 AND post_rank > 25 THEN 1 ELSE 0 END) AS BIGINT) AS moved_out FROM post_ GROUP BY 1""")
def rank_movement(spark: SparkSession, sf: str) -> DataFrame:
    move, inside, outside = F.col("post_rank") - F.col("rank"), (F.col("rank") > 25) & (F.col("post_rank") <= 25), (F.col("rank") <= 25) & (F.col("post_rank") > 25)
    return reranked(spark, sf).groupBy(F.coalesce("authority_class", F.lit("NONE")).alias("authority_class")).agg(F.count("*").alias("n"), F.round(F.avg(move), 6).alias("mean_move"), F.percentile(move, 0.5).alias("median_move"), F.sum(inside.cast("int")).alias("moved_in"), F.sum(outside.cast("int")).alias("moved_out"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    g = K.gold(spark, sf).select("query_id", "doc_id").withColumn("is_gold", F.lit(True))
    return K.ranked(spark, sf).join(g, ["query_id", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


_SIGNALS = ("bm25", "dense", "authority_weight", "final_score")
_LONG_SQL = "lab AS (SELECT ranked.*, gold.doc_id IS NOT NULL AS is_gold FROM ranked LEFT JOIN gold ON gold.query_id = ranked.query_id AND gold.doc_id = ranked.doc_id), lng AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, round({s}, 9) AS v, is_gold FROM lab" for s in _SIGNALS) + ")"


def _long(spark: SparkSession, sf: str) -> DataFrame:
    signals = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.round(s, 9).alias("v")) for s in _SIGNALS)))
    return _labelled(spark, sf).select("is_gold", signals.alias("x")).select("x.signal", "x.v", "is_gold")


@query(f"""WITH {_EVAL}, {_LONG_SQL}, r AS (SELECT signal, is_gold, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2.0 AS mid FROM lng),
    s AS (SELECT signal, sum(CASE WHEN is_gold THEN mid ELSE 0 END) AS r, sum(is_gold::INT) AS p, count(*) AS n FROM r GROUP BY signal) SELECT signal, round((r - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM s WHERE p > 0 AND p < n""")
def signal_auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(_long(spark, sf), "v", "is_gold", ["signal"]).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {_EVAL}, {_LONG_SQL} SELECT signal, is_gold, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95 FROM lng GROUP BY ALL""")
def signal_describe(spark: SparkSession, sf: str) -> DataFrame:
    d = M.described(_long(spark, sf), "v", ["signal", "is_gold"])
    return d.select("signal", "is_gold", "n", *(F.round(c, 6).alias(c) for c in d.columns[3:]))


@query(f"WITH {K.sql_ranked()} SELECT round(avg((final_score > 0.9)::INT), 6) AS over_90, round(avg((final_score < 0.1)::INT), 6) AS under_10, count(DISTINCT round(final_score, 6)) AS n_unique FROM ranked")
def signal_saturation(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("final_score")
    return K.ranked(spark, sf).agg(F.round(F.avg((s > 0.9).cast("int")), 6).alias("over_90"), F.round(F.avg((s < 0.1).cast("int")), 6).alias("under_10"), F.countDistinct(F.round(s, 6)).alias("n_unique"))


@query(f"""WITH {K.sql_ranked()}, m AS (SELECT rank() OVER (ORDER BY round(bm25, 9)) + (count(*) OVER (PARTITION BY round(bm25, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(dense, 9)) + (count(*) OVER (PARTITION BY round(dense, 9)) - 1) / 2.0 AS b FROM ranked) SELECT round(corr(a, b), 6) AS spearman FROM m""")
def signal_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of mid-ranks; ranks come from counts of distinct values, not from one sorted table of all rows."""
    d = written(K.ranked(spark, sf).select(F.round("bm25", 9).alias("x"), F.round("dense", 9).alias("y")))

    def ranks(c: str) -> DataFrame:
        n = d.groupBy(c).agg(F.count("*").alias("n"))
        return M.values_before(n, c).select(c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r_{c}"))

    return d.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.round(F.corr("r_x", "r_y"), 6).alias("spearman"))


@query(f"""WITH {K.sql_ranked()} SELECT count(*) AS pairs, CAST(sum((s.final_score > p.final_score)::INT) AS BIGINT) AS inversions FROM ranked p JOIN ranked s ON s.query_id = p.query_id AND s.lane = p.lane AND p.authority_class = 'PRIMARY_LEGISLATION' AND s.authority_class = 'SECONDARY_LEGISLATION'""")
def authority_inversions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of primary and secondary legislation of one query in which the secondary scores higher, counted by ranks in each group."""
    c = K.ranked(spark, sf).where(F.col("lane") == "legislation").select("query_id", "final_score", (F.col("authority_class") == "PRIMARY_LEGISLATION").cast("int").alias("p"))
    below = F.coalesce(F.sum("p").over(Window.partitionBy("query_id").orderBy("final_score").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("p").over(Window.partitionBy("query_id", "final_score"))
    rows = c.withColumn("below", F.when(F.col("p") == 0, below))
    per = rows.groupBy("query_id").agg((F.sum("p") * F.sum(1 - F.col("p"))).alias("pairs"), F.sum("below").alias("inv"))
    return per.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum(F.coalesce("inv", F.lit(0))).alias("inversions"))


_PAIRS_SQL = f"""{_EVAL}, {_CE}, t AS (SELECT DISTINCT query_id, doc_id FROM gold), v AS (SELECT t.query_id, avg(coalesce(rank <= 5, false)::INT) AS a, avg(coalesce(post_rank <= 5, false)::INT) AS b FROM t LEFT JOIN post_ ON post_.query_id = t.query_id AND post_.doc_id = t.doc_id GROUP BY 1)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, a, b: share of gold among the first five of a lane, before and after reranking."""
    r = reranked(spark, sf).select("query_id", "doc_id", "rank", "post_rank")
    hit = lambda c: F.avg(F.coalesce((F.col(c) <= 5).cast("int"), F.lit(0)))
    return K.gold(spark, sf).select("query_id", "doc_id").join(r, ["query_id", "doc_id"], "left").groupBy("query_id").agg(hit("rank").alias("a"), hit("post_rank").alias("b"))


@query(f"WITH {_PAIRS_SQL} SELECT count(*) AS n, round(avg(b - a), 6) AS mean_diff, CASE WHEN stddev_samp(b - a) > 0 THEN round(avg(b - a) / stddev_samp(b - a), 6) END AS cohens_d FROM v")
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("b") - F.col("a")
    return _pairs(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.avg(d) / F.when(F.stddev_samp(d) > 0, F.stddev_samp(d)), 6).alias("cohens_d"))


@query(f"WITH {_PAIRS_SQL} SELECT CAST(sum((a = 1 AND b < 1)::INT) AS BIGINT) AS only_before, CAST(sum((b = 1 AND a < 1)::INT) AS BIGINT) AS only_after, CAST(sum((a = 1 AND b = 1)::INT) AS BIGINT) AS \"both\" FROM v")
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a") == 1, F.col("b") == 1
    s = lambda c: F.sum(c.cast("int"))
    return _pairs(spark, sf).agg(s(a & ~b).alias("only_before"), s(b & ~a).alias("only_after"), s(a & b).alias("both"))


@query(None)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.paired_bootstrap(_pairs(spark, sf).withColumn("comparison", F.lit("rerank")), ["comparison"])
