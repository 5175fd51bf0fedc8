"""Queries on citation graphs, trees and segmentation, over the star schema and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators import segment as S
from corpusmill.plans import corpus as K

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_EDGES_SQL = """e AS (
    SELECT 'N' || n_nationkey AS source_id, 'CONTAINS' AS relation, 'R' || n_regionkey AS target_id, 1.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'C' || c_custkey, 'REFERENCES', 'N' || c_nationkey, 0.9 FROM customer
    UNION ALL SELECT 'O' || o_orderkey, 'REFERENCES', 'C' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 0.7 END FROM orders
    UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'CROSS_REFERS_TO', 'P' || l_partkey, 0.6 FROM lineitem)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    def e(table: str, source: str, relation: str, target: str, confidence) -> DataFrame:
        a, b = (F.concat(F.lit(x[0]), F.col(x[1:]).cast("string")) for x in (source, target))
        return K.table(spark, sf, table).select(a.alias("source_id"), F.lit(relation).alias("relation"), b.alias("target_id"), confidence.alias("confidence"))

    surety = F.when(F.col("o_orderstatus") == "F", 0.8).otherwise(0.7)
    parts = [e("nation", "Nn_nationkey", "CONTAINS", "Rn_regionkey", F.lit(1.0)), e("customer", "Cc_custkey", "REFERENCES", "Nc_nationkey", F.lit(0.9)), e("orders", "Oo_orderkey", "REFERENCES", "Co_custkey", surety), e("lineitem", "Ol_orderkey", "CROSS_REFERS_TO", "Pl_partkey", F.lit(0.6)).distinct()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_EDGES_SQL} SELECT relation, count(*) AS n, count(DISTINCT target_id) AS targets, round(avg(confidence), 6) AS confidence FROM e GROUP BY relation")
def edges_star(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("target_id").alias("targets"), F.round(F.avg("confidence"), 6).alias("confidence"))


_HOP = """SELECT query_id, s, t, relation, max(confidence) AS confidence FROM {frontier} f JOIN (SELECT source_id AS s, target_id AS t, relation, confidence FROM e) x ON x.s = f.node GROUP BY ALL"""


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Each seed order is a query of its own."""
    o = K.table(spark, sf, "orders").where("o_orderkey % 50 = 0")
    return o.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node"))


_ONE = f"""{_EDGES_SQL}, seed AS (SELECT DISTINCT o_orderkey AS query_id, 'O' || o_orderkey AS node FROM orders WHERE o_orderkey % 50 = 0), h1 AS ({_HOP.format(frontier='seed')}),
    k1 AS (SELECT query_id, t AS node, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, s, t, relation) AS r FROM h1) WHERE r <= 40 GROUP BY ALL),
    n1 AS (SELECT * FROM k1 WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.query_id = k1.query_id AND seed.node = k1.node))"""


@query(f"WITH {_ONE} SELECT query_id, node, CAST(1 AS INTEGER) AS hop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS graph_rank FROM n1")
def graph_expand_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.expanded(edges(spark, sf), _seeds(spark, sf), 1, 40)


@query(f"""WITH {_ONE}, h2 AS ({_HOP.format(frontier='n1')}), k2 AS (SELECT query_id, t AS node, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, s, t, relation) AS r FROM h2) WHERE r <= 40 GROUP BY ALL),
    n2 AS (SELECT * FROM k2 WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.query_id = k2.query_id AND seed.node = k2.node) AND NOT EXISTS (SELECT 1 FROM n1 WHERE n1.query_id = k2.query_id AND n1.node = k2.node)),
    u AS (SELECT query_id, node, r, 1 AS hop FROM n1 UNION ALL SELECT query_id, node, r, 2 FROM n2) SELECT query_id, node, CAST(hop AS INTEGER) AS hop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, r) AS INTEGER) AS graph_rank FROM u""")
def graph_expand_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.expanded(edges(spark, sf), _seeds(spark, sf), 2, 40)


_NODES = "'D' || l_orderkey || '__section-' || l_linenumber || '-' || l_suppkey"


@query(f"""WITH known AS (SELECT DISTINCT 'D' || l_orderkey || '__section-' || l_linenumber AS node_id FROM lineitem WHERE l_linenumber <= 2), i AS (SELECT DISTINCT {_NODES} AS id, 'D' || l_orderkey || '__section-' || l_linenumber AS up FROM lineitem)
    SELECT CASE WHEN known.node_id IS NULL THEN 'UNRESOLVABLE' ELSE 'ANCESTOR' END AS how, count(*) AS n, count(DISTINCT known.node_id) AS retrieval_ids FROM i LEFT JOIN known ON known.node_id = up GROUP BY 1""")
def edge_rollup_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions below known sections roll up to them; the others can't be resolved."""
    line = K.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    section = F.concat(F.lit("D"), F.col("l_orderkey").cast("string"), F.lit("__section-"), F.col("l_linenumber").cast("string"))
    ids = line.select(F.concat(section, F.lit("-"), F.col("l_suppkey").cast("string")).alias("id")).distinct()
    r = G.rolled_up(ids, line.where("l_linenumber <= 2").select(section.alias("node_id")))
    return r.groupBy("how").agg(F.count("*").alias("n"), F.countDistinct("retrieval_id").alias("retrieval_ids"))


@query("SELECT c_custkey, 'R' || n_regionkey || '/N' || n_nationkey || '/C' || c_custkey AS path, CAST(2 AS INTEGER) AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    c, n = K.table(spark, sf, "customer"), K.table(spark, sf, "nation")
    path = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("/N"), F.col("n_nationkey").cast("string"), F.lit("/C"), F.col("c_custkey").cast("string"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", path.alias("path"), F.lit(2).alias("depth"))


@query(r"""SELECT l_returnflag AS relation, l_linestatus AS stratum, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS strict_rate, round(avg((l_quantity > 5)::INT), 6) AS not_wrong_rate FROM lineitem GROUP BY ALL""")
def stratum_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict rates by stratum; the quantity stands for the verdict."""
    rate = lambda c: F.round(F.avg((F.col("l_quantity") > c).cast("int")), 6)
    return K.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("stratum")).agg(F.count("*").alias("n"), rate(25).alias("strict_rate"), rate(5).alias("not_wrong_rate"))


@query("""WITH RECURSIVE ln AS (SELECT doc_id, list_transform(str_split(text, chr(10)), lambda x: length(x)) AS z FROM documents),
    w(doc_id, z, i, acc, g) AS (SELECT doc_id, z, 1, z[1], 1 FROM ln UNION ALL SELECT doc_id, z, i + 1, CASE WHEN acc >= 1500 THEN z[i + 1] ELSE acc + z[i + 1] END, CASE WHEN acc >= 1500 THEN g + 1 ELSE g END FROM w WHERE i < len(z))
    SELECT doc_id, CAST(g AS INTEGER) AS chunk_ordinal, CAST(count(*) AS INTEGER) AS n_blocks, CAST(sum(z[i]) + count(*) - 1 AS BIGINT) AS n_chars FROM w GROUP BY doc_id, g""")
def chunks_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are taken until their characters reach 1,500."""
    d = K.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("blocks"))
    return S.chunked(d, "blocks", 1500).select("doc_id", "chunk_ordinal", "n_blocks", F.length("text").cast("bigint").alias("n_chars"))


#: Texts with references: every page's html, and a sentence made of each order line's numbers, as the pages cite nothing.
_REFS_SQL = r"""t AS (SELECT page_id AS node_id, html AS text FROM pages
        UNION ALL SELECT 1000000 + l_orderkey * 10 + l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Section ' WHEN 1 THEN 'see regulation ' WHEN 2 THEN 'schedules ' ELSE 'part ' END || l_suppkey || CASE WHEN l_returnflag = 'A' THEN 'A' ELSE '' END || CASE WHEN l_linestatus = 'F' THEN '(' || l_linenumber || ')(b)' ELSE '' END || ' and part ' || l_linenumber FROM lineitem),
    r AS (SELECT node_id, regexp_extract_all(text, '(?i)\b(?:section|regulation|schedule|part)s?\s+[0-9]+[A-Za-z]*(?:\([0-9A-Za-z]+\))*') AS m FROM t),
    u AS (SELECT node_id AS source_node_id, CAST(unnest(range(len(m))) AS INTEGER) AS ordinal, unnest(m) AS t FROM r),
    l AS (SELECT source_node_id, ordinal, upper(regexp_extract(t, '(?i)^(section|regulation|schedule|part)', 1)) AS reference_type, regexp_extract(t, '\s([0-9].*)$', 1) AS locator FROM u)"""


def _references(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 4 == 0, "Section ").when(F.col("l_linenumber") % 4 == 1, "see regulation ").when(F.col("l_linenumber") % 4 == 2, "schedules ").otherwise("part ")
    number = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "A", "A").otherwise(""), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")(b)"))).otherwise(""))
    made = K.table(spark, sf, "lineitem").select((1000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node_id"), F.concat(unit, number, F.lit(" and part "), F.col("l_linenumber").cast("string")).alias("text"))
    return G.references(K.table(spark, sf, "pages").select(F.col("page_id").alias("node_id"), F.col("html").alias("text")).unionByName(made))


@query(f"WITH {_REFS_SQL} SELECT source_node_id AS page_id, reference_type, count(*) AS n FROM l GROUP BY ALL")
def reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    """References of each page by type."""
    return _references(spark, sf).groupBy(F.col("source_node_id").alias("page_id"), "reference_type").agg(F.count("*").alias("n"))


@query(f"WITH {_REFS_SQL} SELECT *, regexp_extract_all(locator, '[0-9A-Za-z]+') AS parts FROM l")
def page_references(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a section, regulation, schedule or part."""
    return _references(spark, sf)
