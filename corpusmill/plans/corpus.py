"""How the tables at hand play the parts of a retrieval corpus, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as T
from corpusmill.operators import retrieval as R

#: Which authority class stands for which source; others have none.
SOURCE_CLASSES = {
    "src0": "PRIMARY_LEGISLATION", "src1": "PRIMARY_LEGISLATION", "src2": "SECONDARY_LEGISLATION", "src3": "SECONDARY_LEGISLATION",
    "src4": "OFFICIAL_TECHNICAL_GUIDANCE", "src5": "OFFICIAL_GOVERNMENT_GUIDANCE", "src6": "OFFICIAL_REGULATOR_GUIDANCE", "src7": "PROCUREMENT_POLICY",
    "src8": "OFFICIAL_WORKFLOW", "src9": "OFFICIAL_TRAINING", "src10": "PROFESSIONAL_INTERPRETATION", "src11": "INDUSTRY_PRACTICE",
}
JURISDICTIONS = {"en": "UK", "es": "EU"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with authority_class, jurisdiction and lane."""
    classes = F.create_map(*(F.lit(x) for kv in SOURCE_CLASSES.items() for x in kv))
    places = F.create_map(*(F.lit(x) for kv in JURISDICTIONS.items() for x in kv))
    d = table(spark, sf_dir, "documents").withColumns({"authority_class": F.try_element_at(classes, F.col("source")), "jurisdiction": F.coalesce(F.try_element_at(places, F.col("lang")), F.lit("Scotland"))})
    return d.withColumn("lane", T.lane(F.col("authority_class")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tokenized(docs(spark, sf_dir), T.words(F.col("text")))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term: the distinct content words of each benchmark item."""
    kept = F.filter(T.words(F.col("text")), lambda w: (F.length(w) > 1) & ~w.isin(*sorted(C.QUERY_STOPWORDS)))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(kept)).alias("term"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lane, vector: a document's vector is that whose vec_id is its doc_id modulo the table's size."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    return docs(spark, sf_dir).select("doc_id", "lane", (F.col("doc_id") % n).alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("doc_id", "vector", "lane")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % n).alias("vec_id")).join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")


def candidates(spark: SparkSession, sf_dir: str, k: int = C.CANDIDATES) -> DataFrame:
    """The hub: each query's k best of either channel and lane, with both raw scores, weights and text."""
    lexical = R.bm25(tokens(spark, sf_dir), query_terms(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id", "lane"), "doc_id")
    best = R.top(lexical, ["query_id", "lane"], "bm25", k).select("query_id", "doc_id")
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    near = R.dense_top(v, q, k, by_lane=True).select("query_id", "doc_id")
    pool = best.union(near).distinct().join(lexical.select("query_id", "doc_id", "bm25"), ["query_id", "doc_id"], "left").fillna(0.0, ["bm25"])
    pool = pool.join(v.withColumnRenamed("vector", "dv"), "doc_id").join(q.withColumnRenamed("vector", "qv"), "query_id").withColumn("dense", R.cosine(F.col("dv"), F.col("qv"))).drop("dv", "qv")
    meta = docs(spark, sf_dir).select("doc_id", "authority_class", "jurisdiction", "source", "n_chars")
    return pool.join(meta, "doc_id").withColumns({"authority_weight": T.authority_weight(F.col("authority_class")), "jurisdiction_weight": T.jurisdiction_weight(F.col("jurisdiction"))})


def ranked(spark: SparkSession, sf_dir: str, alpha: float = C.ALPHA_FROZEN, k: int = C.CANDIDATES_FROZEN) -> DataFrame:
    """candidates with final_score and pre-rerank rank in each query and lane; the depth is the frozen evaluation's."""
    by = ["query_id", "lane"]
    return R.top(R.fused(candidates(spark, sf_dir, k), by, alpha), by, "final_score", 1 << 30)


def gold(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    """query_id, doc_id, coverage: documents that have at least that share of an item's five-word shingles."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.shingles(T.words(F.col("text"))).alias("s")).select("query_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    have = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.shingles(T.words(F.col("text")))).alias("shingle")).join(items.select("shingle").distinct(), "shingle", "left_semi")
    hits = items.join(have, "shingle").groupBy("query_id", "doc_id", "n").agg(F.count("*").alias("hits"))
    return hits.select("query_id", "doc_id", F.round(F.col("hits") / F.col("n"), 4).alias("coverage")).where(F.col("coverage") >= least)


def _cases(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else repr(v)) for k, v in values.items()) + f" ELSE {default} END"


_STOP = ", ".join(f"'{w}'" for w in sorted(C.QUERY_STOPWORDS))
#: Common table expressions for the oracles, in the order in which they build on each other.
SQL_DOCS = f"""
    d0 AS (SELECT *, {_cases('source', SOURCE_CLASSES, 'NULL')} AS authority_class, {_cases('lang', JURISDICTIONS, "'Scotland'")} AS jurisdiction FROM documents),
    d AS (SELECT *, CASE WHEN authority_class IN ('PRIMARY_LEGISLATION', 'SECONDARY_LEGISLATION') THEN 'legislation' ELSE 'other' END AS lane,
        {_cases('authority_class', C.AUTHORITY_WEIGHTS, repr(C.DEFAULT_AUTHORITY_WEIGHT))} AS authority_weight, CASE WHEN jurisdiction = 'EU' THEN 0.35 ELSE 1.0 END::DOUBLE AS jurisdiction_weight FROM d0)"""
SQL_TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"
SQL_QUERY = f"""
    q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS term FROM benchmark)"""
SQL_BM25 = """
    st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    post AS (SELECT t AS term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM tok) WHERE t IN (SELECT term FROM q) GROUP BY ALL),
    nt AS (SELECT term, count(*) AS n_t FROM post GROUP BY term),
    lex AS (SELECT query_id, doc_id, sum(greatest(ln((n - n_t + 0.5) / (n_t + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
        FROM q JOIN post USING (term) JOIN nt USING (term), st GROUP BY query_id, doc_id)"""
SQL_DENSE = """
    ne AS (SELECT count(*) AS n FROM embeddings),
    dv AS (SELECT doc_id, lane, embedding::DOUBLE[] AS v FROM d, ne JOIN embeddings e ON e.vec_id = d.doc_id % ne.n),
    qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark, ne JOIN embeddings e ON e.vec_id = item_id % ne.n),
    den AS (SELECT query_id, doc_id, lane, list_cosine_similarity(qv.v, dv.v) AS dense FROM qv, dv)"""
def sql_candidates(k: int) -> str:
    return f"""
    lexr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM lex JOIN d USING (doc_id)),
    denr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY round(dense, 9) DESC, doc_id) AS r FROM den),
    ids AS (SELECT query_id, doc_id FROM lexr WHERE r <= {k} UNION SELECT query_id, doc_id FROM denr WHERE r <= {k}),
    cand AS (SELECT ids.query_id, ids.doc_id, d.lane, coalesce(bm25, 0.0) AS bm25, dense, d.authority_class, d.jurisdiction, d.source, d.n_chars, authority_weight, jurisdiction_weight
        FROM ids JOIN d USING (doc_id) LEFT JOIN lex ON lex.query_id = ids.query_id AND lex.doc_id = ids.doc_id JOIN den ON den.query_id = ids.query_id AND den.doc_id = ids.doc_id)"""


def sql_norm(c: str, by: str) -> str:
    sd = f"coalesce(stddev_pop({c}) OVER (PARTITION BY {by}), 0)"
    return f"(tanh(({c} - avg({c}) OVER (PARTITION BY {by})) / CASE WHEN {sd} < 1e-12 THEN 1 ELSE {sd} END) + 1) / 2"


def sql_fused(by: str, alpha: float = C.ALPHA_FROZEN, beta: float = C.BM25_WEIGHT, juris: bool = True) -> str:
    return f"""
    nrm AS (SELECT *, {sql_norm('bm25', by)} AS bm25_norm, {sql_norm('dense', by)} AS dense_norm, {sql_norm('authority_weight', by)} AS authority_norm FROM cand),
    fus AS (SELECT *, {beta} * bm25_norm + {1 - beta} * dense_norm AS fusion_score FROM nrm),
    fin AS (SELECT *, (fusion_score * {1 - alpha} + authority_norm * {alpha}){' * jurisdiction_weight' if juris else ''} AS final_score FROM fus),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM fin)"""


def sql_hub(k: int = C.CANDIDATES) -> str:
    return ", ".join((SQL_DOCS, SQL_TOKENS, SQL_QUERY, SQL_BM25, SQL_DENSE, sql_candidates(k)))


def sql_ranked(k: int = C.CANDIDATES_FROZEN) -> str:
    return ", ".join((sql_hub(k), sql_fused("query_id, lane")))


def sql_shingles(n: int = 5, words: str = "w") -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))) ELSE [] END"


SQL_GOLD = f"""
    gi AS (SELECT query_id, len(s) AS n, unnest(s) AS shingle FROM (SELECT query_id, {sql_shingles()} AS s FROM (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))),
    gd AS (SELECT doc_id, unnest({sql_shingles()}) AS shingle FROM tok),
    gold AS (SELECT * FROM (SELECT query_id, doc_id, round(count(*) / n, 4) AS coverage FROM gi JOIN gd USING (shingle) GROUP BY query_id, doc_id, n) WHERE coverage >= 0.5)"""
