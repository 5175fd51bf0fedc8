"""Queries on text cleaning, hashing, duplicates, containment, chunk quality and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as T
from corpusmill.operators import quality as Q
from corpusmill.plans import corpus as K

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_HASH = r"sha1(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+', ''), '\s+$', ''), '\s+', ' ', 'g'))"


@query(f"SELECT {_HASH} AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return K.table(spark, sf, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY {_HASH} ORDER BY source, doc_id) > 1 AS duplicate FROM documents")
def first_occurrence_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A text is a duplicate unless it is the first by source and id; the first comes from an aggregate, so copies needn't meet in one task."""
    d = K.table(spark, sf, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("hash"))
    first = d.groupBy("hash").agg(F.min(F.struct("source", "doc_id")).alias("first"))
    return d.join(first, "hash").select("doc_id", (F.struct("source", "doc_id") != F.col("first")).alias("duplicate"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(coalesce(sum(n) - count(*), 0) AS BIGINT) AS redundant FROM (SELECT count(*) AS n FROM documents GROUP BY " + _HASH + ") WHERE n > 1")
def duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    groups = K.table(spark, sf, "documents").groupBy(T.content_hash(F.col("text"))).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("redundant"))


_URL = r"regexp_replace(regexp_replace(regexp_replace(split_part(lower(coalesce(url, '')), '#', 1), '/+$', ''), '^https?://(www\.)?', ''), '/(data\.(akn|xml|htm|feed)|contents|made|introduction)$', '')"


@query(f"""WITH u AS (SELECT {_URL} AS url_key, page_id, length(html) AS n FROM pages), r AS (SELECT *, first_value(page_id) OVER (PARTITION BY url_key ORDER BY n DESC, page_id) AS canonical, count(*) OVER (PARTITION BY url_key) AS members FROM u)
    SELECT url_key, page_id AS superseded, canonical FROM r WHERE members > 1 AND page_id <> canonical""")
def url_canonical_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Of pages that share a normalised address, all but the largest are superseded by it."""
    u = K.table(spark, sf, "pages").select(T.dedupe_url(F.col("url")).alias("url_key"), "page_id", F.length("html").alias("n"))
    best = u.groupBy("url_key").agg(F.min(F.struct((-F.col("n")).alias("m"), "page_id")).alias("best"), F.count("*").alias("members")).where("members > 1")
    return u.join(best, "url_key").where("page_id <> best.page_id").select("url_key", F.col("page_id").alias("superseded"), F.col("best.page_id").alias("canonical"))


_LINES = "ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents))"
_STRIP = r"regexp_replace(regexp_replace(coalesce(line, ''), '^\s+', ''), '\s+$', '')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return K.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _sql_drop() -> str:
    rules = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in C.UNIVERSAL_DROPS)
    return f"CASE WHEN t = '' THEN 'empty' {rules} WHEN length(t) < {C.MIN_SUBSTANTIVE_CHARS} AND NOT regexp_matches(t, '{C.SUBSTANCE}') THEN 'thin_no_substance' END"


@query(f"WITH {_LINES} SELECT reason, count(*) AS n FROM (SELECT {_sql_drop()} AS reason FROM (SELECT {_STRIP} AS t FROM ln)) GROUP BY reason")
def line_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy(T.drop_reason(F.col("line")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ln) SELECT doc_id, count(*) AS kept FROM p WHERE before IS NULL OR before <> line GROUP BY doc_id")
def adjacent_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Lines kept when each that equals the one before it goes; inside each text, without a shuffle of lines."""
    ls = F.split("text", "\n")
    kept = F.size(F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, i - 1))))
    return K.table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", kept.cast("bigint").alias("kept"))


_DOMAINS = sorted(C.DOMAIN_DROPS)
#: RE2 lacks look-around: words are joined over a broken line by groups, twice, as neighbouring matches share a letter.
_SQL_REPAIR = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\w)\n \n(\w)', '\1 \2', 'g'), '[\t\r ]+', ' ', 'g'), '[  ]{{2,}}', ' ', 'g'), '^\s+', ''), '\s+$', '')"""


def _sql_domain_drop() -> str:
    rules = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in C.UNIVERSAL_DROPS)
    more = " ".join(f"WHEN domain = '{d}' AND regexp_matches(t, '{p}') THEN '{n}'" for d in C.DOMAIN_DROPS for n, p in C.DOMAIN_DROPS[d])
    return f"CASE WHEN t = '' THEN 'empty' {rules} {more} WHEN length(t) < {C.MIN_SUBSTANTIVE_CHARS} AND NOT regexp_matches(t, '{C.SUBSTANCE}') THEN 'thin_no_substance' END"


#: Lines that the domains' rules are about, one for each document, as the invented prose has none.
_DOMAIN_LINES = ("this applies to", "Route 2 for goods", "Annual dinner and membership application of the committee", "Book a demo", "This guidance is now withdrawn and out of date", "Table of contents", "title page", "The supplier must give notice in writing   to the authority")


@query(f"""WITH {_LINES}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ln),
    a AS (SELECT doc_id, line FROM p WHERE before IS NULL OR before <> line UNION ALL SELECT doc_id, {list(_DOMAIN_LINES)}[CAST(doc_id % {len(_DOMAIN_LINES)} AS INTEGER) + 1] FROM documents),
    t AS (SELECT doc_id, {_DOMAINS}[CAST(doc_id % {len(_DOMAINS)} AS INTEGER) + 1] AS domain, {_SQL_REPAIR.format(x='line')} AS t FROM a)
    SELECT coalesce(r, 'kept') AS reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(sum(CASE WHEN r IS NULL THEN length(t) ELSE 0 END) AS BIGINT) AS kept_chars FROM (SELECT doc_id, t, {_sql_domain_drop()} AS r FROM t) GROUP BY 1""")
def filter_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent duplicates go, the rest is repaired, then each rule, the domain's own too, drops what it names; counts of what is kept and dropped."""
    at = lambda values: F.get(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values)).cast("int"))
    ls = F.split("text", "\n")
    kept = F.filter(ls, lambda x, i: (i == 0) | (x != F.get(ls, i - 1)))
    d = K.table(spark, sf, "documents")
    rows = d.select("doc_id", F.explode(kept).alias("line")).union(d.select("doc_id", at(_DOMAIN_LINES))).select("doc_id", at(_DOMAINS).alias("domain"), T.repaired(F.col("line")).alias("t"))
    reason = F.coalesce(T.drop_reason(F.col("t"), F.col("domain")), F.lit("kept"))
    rows = rows.withColumn("reason", reason)
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.when(F.col("reason") == "kept", F.length("t")).otherwise(0)).alias("kept_chars"))


@query(f"WITH {K.SQL_TOKENS}, {K.SQL_GOLD} SELECT * FROM gold")
def shingle_containment(spark: SparkSession, sf: str) -> DataFrame:
    return K.gold(spark, sf)


@query(f"""WITH {K.SQL_TOKENS}, {K.SQL_GOLD}, u AS (SELECT DISTINCT query_id, gi.shingle, n FROM gi JOIN gd USING (shingle))
    SELECT query_id, round(count(*) / n, 4) AS recall FROM u GROUP BY query_id, n""")
def source_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each item's shingles that all documents together have."""
    items = K.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.shingles(T.words(F.col("text"))).alias("s")).select("query_id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    have = K.table(spark, sf, "documents").select(F.explode(T.shingles(T.words(F.col("text")))).alias("shingle"))
    hit = items.join(have, "shingle", "left_semi")
    return hit.groupBy("query_id", "n").agg(F.count("*").alias("c")).select("query_id", F.round(F.col("c") / F.col("n"), 4).alias("recall"))


# Chunks of ten lines stand for served chunks here.
_CHUNKS = f"""{_LINES}, ch AS (SELECT doc_id, CAST(pos // 10 + 1 AS INTEGER) AS chunk_ordinal, string_agg(line, chr(10) ORDER BY pos) AS text FROM ln GROUP BY doc_id, pos // 10),
    nx AS (SELECT *, {_STRIP.replace('line', 'text')} AS t, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_ordinal) AS nxt FROM ch),
    h AS (SELECT *, regexp_replace(coalesce(nxt, ''), '^\\s+', '') AS hn, greatest(1, length(t) // 4) AS tokens FROM nx)"""
_ENDS, _DANGLE, _LIST = (p.replace("'", "''") for p in (C.SENTENCE_END, C.DANGLING, C.LIST_START))
_DEFECTS = f"""list_filter([CASE WHEN t = '' THEN 'EMPTY_TEXT' END,
    CASE WHEN t <> '' AND NOT regexp_matches(t, '{_ENDS}') AND right(t, 1) NOT IN (';', ',') AND regexp_matches(hn, '^[a-z]') AND NOT regexp_matches(hn, '{_LIST}') THEN 'SEVERED_SENTENCE' END,
    CASE WHEN t <> '' AND regexp_matches(right(t, 40), '{_DANGLE}') THEN 'SEVERED_ENUMERATION' END,
    CASE WHEN right(t, 1) = ':' THEN 'SEVERED_LIST_STEM' END,
    CASE WHEN t <> '' AND regexp_matches(t, '{_LIST}') AND chunk_ordinal > 1 THEN 'ORPHAN_LIST_ITEM' END,
    CASE WHEN t <> '' AND tokens < {C.TOO_SMALL_TOKENS} THEN 'TOO_SMALL_TO_RETRIEVE' END], lambda x: x IS NOT NULL)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = K.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 10).cast("int")), lambda i: F.array_join(F.slice("ls", i * 10 + 1, 10), "\n"))
    return d.select("doc_id", F.posexplode(parts).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("chunk_ordinal"), "text")


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_ordinal, CAST(tokens AS INTEGER) AS est_tokens, array_to_string({_DEFECTS}, ',') AS defects FROM h")
def chunk_quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    flagged = Q.assessed(chunks(spark, sf), ["doc_id"], metadata=False)
    return flagged.select("doc_id", "chunk_ordinal", "est_tokens", F.array_join("defects", ",").alias("defects"))


@query(f"""WITH {_CHUNKS}, f AS (SELECT tokens, {_DEFECTS} AS defects FROM h)
    SELECT count(*) AS chunks, round(100.0 * avg(CASE WHEN len(defects) = 0 THEN 1 ELSE 0 END), 4) AS clean_pct, round(avg(len(defects)), 6) AS defects_per_chunk, round(avg(tokens), 6) AS mean_tokens,
    round(100.0 * avg(CASE WHEN tokens BETWEEN 200 AND 800 THEN 1 ELSE 0 END), 4) AS in_band_pct, CAST(max(tokens) AS INTEGER) AS max_tokens, CAST(quantile_cont(tokens, 0.5) AS DOUBLE) AS median_tokens FROM f""")
def chunk_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.report(Q.assessed(chunks(spark, sf), ["doc_id"], metadata=False))


@query(f"WITH {_CHUNKS}, f AS (SELECT unnest({_DEFECTS}) AS defect FROM h) SELECT defect, count(*) AS n FROM f GROUP BY defect")
def defect_totals(spark: SparkSession, sf: str) -> DataFrame:
    return Q.assessed(chunks(spark, sf), ["doc_id"], metadata=False).select(F.explode("defects").alias("defect")).groupBy("defect").agg(F.count("*").alias("n"))


@query(f"""WITH {K.SQL_DOCS} SELECT coalesce(authority_class, 'NONE') AS authority_class, lane, jurisdiction, count(*) AS n, CAST(min(n_chars) AS BIGINT) AS min_chars, round(avg(authority_weight), 6) AS weight FROM d GROUP BY ALL""")
def authority_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = K.docs(spark, sf).withColumn("w", T.authority_weight(F.col("authority_class")))
    return d.groupBy(F.coalesce("authority_class", F.lit("NONE")).alias("authority_class"), "lane", "jurisdiction").agg(F.count("*").alias("n"), F.min("n_chars").alias("min_chars"), F.round(F.avg("w"), 6).alias("weight"))


@query("""SELECT CASE WHEN n < 50 THEN '0-50' WHEN n < 100 THEN '50-100' WHEN n < 200 THEN '100-200' WHEN n < 400 THEN '200-400' WHEN n < 800 THEN '400-800' WHEN n < 1600 THEN '800-1600' WHEN n < 3000 THEN '1600-3k' ELSE '3k+' END AS band, count(*) AS n_docs
    FROM (SELECT greatest(1, length(text) // 4) AS n FROM documents) GROUP BY 1""")
def token_bands(spark: SparkSession, sf: str) -> DataFrame:
    return K.table(spark, sf, "documents").groupBy(T.token_band(T.est_tokens(F.col("text"))).alias("band")).agg(F.count("*").alias("n_docs"))


@query("""SELECT count(*) AS n, round(avg(t), 6) AS mean, CAST(quantile_cont(t, 0.5) AS DOUBLE) AS median, round(CAST(quantile_cont(t, 0.95) AS DOUBLE), 6) AS p95, CAST(max(t) AS BIGINT) AS max, round(100.0 * avg(CASE WHEN t > 512 THEN 1 ELSE 0 END), 6) AS pct_over_512, round(100.0 * avg(CASE WHEN t > 1024 THEN 1 ELSE 0 END), 6) AS pct_over_1024, round(100.0 * avg(CASE WHEN t > 2048 THEN 1 ELSE 0 END), 6) AS pct_over_2048,
    CAST(quantile_cont(t, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(t, 0.75) AS DOUBLE) AS p75, CAST(min(t) AS BIGINT) AS min
    FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)""")
def token_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = K.table(spark, sf, "documents").select(F.size(T.words(F.col("text"))).cast("bigint").alias("t"))
    return t.agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"), F.percentile("t", 0.5).alias("median"), F.round(F.percentile("t", 0.95), 6).alias("p95"), F.max("t").alias("max"), *(F.round(100 * F.avg(F.when(F.col("t") > n, 1).otherwise(0)), 6).alias(f"pct_over_{n}") for n in (512, 1024, 2048)), F.percentile("t", 0.25).alias("p25"), F.percentile("t", 0.75).alias("p75"), F.min("t").alias("min"))


@query("""SELECT lang, CASE WHEN quality = 1 THEN 'GOOD' WHEN toxic = 1 THEN 'LOW_VALUE' ELSE 'INCOMPLETE' END AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((1, 2), (2))""")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """By language and in all, in one pass over the data."""
    label = F.when(F.col("quality") == 1, "GOOD").when(F.col("toxic") == 1, "LOW_VALUE").otherwise("INCOMPLETE")
    d = K.table(spark, sf, "documents").select("doc_id", "lang").join(K.table(spark, sf, "labels"), "doc_id").withColumn("label", label)
    return d.groupingSets([["lang", "label"], ["label"]], "lang", "label").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id) AS r FROM documents) SELECT source, doc_id FROM s WHERE r <= 3""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three of each source, drawn by a seeded hash; the feature is the sample."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7"))), "doc_id")
    return K.table(spark, sf, "documents").select("source", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+', ''), '_+$', ''), ''), 'UNKNOWN')[1:220] AS safe, regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) AS domain,
    CASE WHEN regexp_matches(trim(coalesce(url, '')), '(?i)legislation\.gov\.uk/.*?/data\.(akn|xml)$|legislation\.gov\.uk/[a-z]+/\d{4}/[\w-]+/?$') THEN 'LEGISLATION' ELSE 'BLOCKS' END AS route
    FROM (SELECT page_id, url FROM pages UNION ALL SELECT -o_orderkey, 'https://www.legislation.gov.uk/' || CASE WHEN o_orderstatus = 'F' THEN 'ukpga/' ELSE 'uksi/x/' END || (2000 + o_custkey % 30) || '/' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '/data.akn' WHEN o_orderkey % 3 = 1 THEN '/' ELSE '' END FROM orders)""")
def url_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Safe id, domain and ingestion route of each page's address and of one made of each order's numbers, as no page is legislation."""
    made = K.table(spark, sf, "orders").select((-F.col("o_orderkey")).alias("page_id"), F.concat(
        F.lit("https://www.legislation.gov.uk/"), F.when(F.col("o_orderstatus") == "F", "ukpga/").otherwise("uksi/x/"), (2000 + F.col("o_custkey") % 30).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderkey") % 3 == 0, "/data.akn").when(F.col("o_orderkey") % 3 == 1, "/").otherwise("")).alias("url"))
    return K.table(spark, sf, "pages").select("page_id", "url").unionByName(made).select("page_id", T.safe_id(F.col("url")).alias("safe"), T.domain(F.col("url")).alias("domain"), T.ingest_route(F.col("url")).alias("route"))


@query(f"""SELECT item_id, round(len(list_intersect(s, f)) / len(s), 4) AS grounding FROM (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text[1:120]), '[a-z][a-z\\-]{{2,}}')), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in sorted(C.GROUNDING_STOPWORDS))})) AS s, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')) AS f FROM benchmark) WHERE len(s) > 0""")
def summary_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """How far each item's first 120 characters, as its summary, are grounded in it."""
    b = K.table(spark, sf, "benchmark").select("item_id", "text", F.substring("text", 1, 120).alias("summary")).where(F.size(T.content_words(F.col("summary"))) > 0)
    return b.select("item_id", F.round(T.grounding(F.col("summary"), F.col("text")), 4).alias("grounding"))
