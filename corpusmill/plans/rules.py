"""Queries on rules, the index, resolution of references, segments and metrics that need made-up columns: where no table has them, numbers of the star schema stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import rules as U
from corpusmill.functions import text as T
from corpusmill.operators import index as I
from corpusmill.operators import metrics as M
from corpusmill.operators import resolve as S
from corpusmill.operators import retrieval as R
from corpusmill.operators import search as X
from corpusmill.operators import segment as G
from corpusmill.plans import corpus as K
from corpusmill.plans import evaluation as V
from corpusmill.sources.files import written

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: An address of each order; both engines read this expression.
_MADE_URL = """CASE o_orderkey % 8 WHEN 0 THEN 'https://www.legislation.gov.uk/ukpga/' || (2000 + o_custkey % 30) || '/' || (o_custkey % 50) || '/section/' || (o_orderkey % 40)
    WHEN 1 THEN 'https://www.gov.uk/guidance/g' || o_orderkey WHEN 2 THEN 'https://assets.publishing.service.gov.uk/f' || o_orderkey || '.pdf' WHEN 3 THEN 'https://www.procurementjourney.scot/p' || (o_orderkey % 90) || '/'
    WHEN 4 THEN 'mailto:x' || o_orderkey || '@b.org' WHEN 5 THEN 'https://ico.org.uk/' || o_orderkey WHEN 6 THEN 'https://www.legislation.gov.uk/uksi/' || (2000 + o_custkey % 30) || '/' || (o_custkey % 50) ELSE 'https://www.gov.uk/government/publications/p' || (o_orderkey % 90) || '#frag' END"""
_URLS_SQL = f"u AS (SELECT o_orderkey AS id, {_MADE_URL} AS url, o_totalprice AS amount, o_orderpriority AS grp FROM orders UNION ALL SELECT -page_id, url, 0, 'page' FROM pages)"


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """id, url, amount, grp of each page and order."""
    made = K.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_MADE_URL).alias("url"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("grp"))
    return made.unionByName(K.table(spark, sf, "pages").select((-F.col("page_id")).alias("id"), "url", F.lit(0.0).alias("amount"), F.lit("page").alias("grp")))


@query(f"""WITH {_URLS_SQL} SELECT CASE WHEN url LIKE '%legislation.gov.uk%' THEN 'legislation.gov.uk' WHEN url LIKE '%procurementpathway.civilservice.gov.uk%' THEN 'procurementpathway.civilservice.gov.uk' WHEN url LIKE '%procurementjourney.scot%' THEN 'procurementjourney.scot'
    WHEN url LIKE '%gov.uk%' THEN 'gov.uk (other)' WHEN url IS NULL OR url = '' THEN '(no source_url)' ELSE 'other publishers' END AS host_class, count(*) AS n FROM u GROUP BY 1""")
def link_host_classes(spark: SparkSession, sf: str) -> DataFrame:
    return urls(spark, sf).groupBy(U.host_class(F.col("url")).alias("host_class")).agg(F.count("*").alias("n"))


_HOST, _PATH = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))", "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


@query(f"""WITH {_URLS_SQL}, h AS (SELECT id, {_HOST} AS h, {_PATH} AS p FROM u) SELECT id, CASE WHEN ends_with(h, 'legislation.gov.uk') THEN 'LEGISLATION' WHEN h = 'assets.publishing.service.gov.uk' THEN CASE WHEN ends_with(p, '.pdf') THEN 'GOVUK_PDF_ATTACHMENT' ELSE 'GOVUK_ASSET' END
    WHEN h = 'www.gov.uk' THEN CASE WHEN starts_with(p, '/guidance/') THEN 'GOVUK_GUIDANCE' WHEN starts_with(p, '/government/publications/') THEN 'GOVUK_PUBLICATION' ELSE 'GOVUK_PAGE' END WHEN ends_with(h, 'gov.uk') THEN 'OTHER_GOVUK_SERVICE' WHEN contains(h, 'ico.org.uk') THEN 'ICO_INTERNAL' ELSE 'EXTERNAL' END AS link_class, h AS host, p AS path FROM h""")
def link_classes(spark: SparkSession, sf: str) -> DataFrame:
    return I.parts_of_url(urls(spark, sf)).select("id", U.link_class(F.col("url")).alias("link_class"), "host", "path")


_LEG = C.LEGISLATION_URL.replace("(?i)", "")
#: The corpus that addresses are resolved in: provisions below 20 of Acts with even numbers, and the documents of two addresses.
_CORPUS_SQL = f"""nodes AS (SELECT DISTINCT 'UKPGA_' || (2000 + o_custkey % 30) || '_' || (o_custkey % 50) || '__section-' || (o_orderkey % 20) AS node_id FROM orders WHERE o_custkey % 2 = 0), held AS (SELECT DISTINCT split_part(node_id, '__', 1) AS doc FROM nodes),
    m AS (SELECT id, url, CASE WHEN regexp_matches(url, '(?i){_LEG}') THEN CASE lower(regexp_extract(url, '(?i){_LEG}', 1)) WHEN 'ukpga' THEN 'UKPGA' ELSE 'UKSI' END || '_' || regexp_extract(url, '(?i){_LEG}', 2) || '_' || regexp_extract(url, '(?i){_LEG}', 3) END AS doc, nullif(regexp_extract(url, '(?i){_LEG}', 5), '') AS loc,
        lower(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS k FROM u),
    dl AS (SELECT k, max(d) AS d FROM (VALUES ('https://www.procurementjourney.scot/p7', 'DOC_A'), ('https://www.gov.uk/government/publications/p55', 'DOC_B')) t(k, d) GROUP BY k),
    j AS (SELECT m.*, held.doc IS NOT NULL AS is_held, n.node_id, dl.d FROM m LEFT JOIN held USING (doc) LEFT JOIN nodes n ON n.node_id = m.doc || '__section-' || m.loc LEFT JOIN dl ON dl.k = m.k)"""


@query(f"""WITH {_URLS_SQL}, {_CORPUS_SQL} SELECT id, CASE WHEN url = '' THEN 'UNRESOLVED' WHEN starts_with(lower(url), 'mailto:') THEN 'NOT_A_LEGAL_REFERENCE' WHEN doc IS NOT NULL AND NOT is_held THEN 'TARGET_NOT_IN_CORPUS' WHEN doc IS NOT NULL AND loc IS NOT NULL AND node_id IS NOT NULL THEN 'EXACT_URL' WHEN doc IS NOT NULL AND loc IS NOT NULL THEN 'DOCUMENT_ONLY'
    WHEN doc IS NOT NULL OR d IS NOT NULL THEN 'EXACT_DOCUMENT' WHEN {_HOST} <> '' THEN 'TARGET_NOT_IN_CORPUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN doc IS NOT NULL AND is_held AND loc IS NOT NULL THEN node_id END AS node, coalesce(doc, d) AS document FROM j""")
def resolved_urls(spark: SparkSession, sf: str) -> DataFrame:
    r = S.resolve_url(urls(spark, sf), _nodes(spark, sf), _documents(spark))
    return r.select("id", "result.status", F.col("result.target_node_id").alias("node"), F.col("result.target_document_id").alias("document"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return K.table(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.expr("'UKPGA_' || (2000 + o_custkey % 30) || '_' || (o_custkey % 50) || '__section-' || (o_orderkey % 20)").alias("node_id")).distinct().withColumn("text", F.lit(None).cast("string"))


def _documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("DOC_A", "https://www.procurementjourney.scot/p7/"), ("DOC_B", "https://www.gov.uk/government/publications/p55#x")], "document_id string, source_url string")


@query(f"""WITH {_URLS_SQL}, {_CORPUS_SQL}, s AS (SELECT *, CASE WHEN doc IS NOT NULL AND is_held AND loc IS NOT NULL AND node_id IS NOT NULL THEN 'EXACT_URL' WHEN doc IS NOT NULL AND is_held AND loc IS NULL THEN 'EXACT_DOCUMENT' WHEN doc IS NULL AND d IS NOT NULL THEN 'EXACT_DOCUMENT' END AS st, coalesce(CASE WHEN is_held AND loc IS NOT NULL THEN node_id END, doc, d) AS target FROM j)
    SELECT 'S' || (abs(id) % 200) AS source_id, target AS target_id, st AS resolution_status, min(id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY abs(id) % 200, target ORDER BY id) AS r FROM s WHERE st IS NOT NULL) GROUP BY ALL""")
def resolution_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of resolved addresses, each source and target once."""
    r = S.resolve_url(urls(spark, sf), _nodes(spark, sf), _documents(spark))
    rows = r.select(F.lit("PLACEHOLDER_LINK").alias("candidate_type"), F.concat(F.lit("S"), (F.abs("id") % 200).cast("string")).alias("source_id"), F.lit("REFERENCES").alias("relation"), F.col("id").cast("string").alias("evidence"), F.col("id").alias("order"), "result")
    edges, _, _ = S.outcome(rows)
    return edges.select("source_id", "target_id", "resolution_status", F.col("evidence").cast("bigint").alias("first_id"))


@query(f"""WITH {_URLS_SQL}, c AS (SELECT upper(regexp_extract(url, '(?i){_LEG}', 1)) || '_' || regexp_extract(url, '(?i){_LEG}', 2) || '_' || regexp_extract(url, '(?i){_LEG}', 3) AS document_id, CAST(sum(id) AS BIGINT) AS citations FROM u WHERE regexp_matches(url, '(?i){_LEG}') GROUP BY 1)
    SELECT * FROM c WHERE document_id NOT IN (SELECT 'UKPGA_' || (2000 + o_custkey % 30) || '_' || (o_custkey % 50) FROM orders WHERE o_custkey % 2 = 0) ORDER BY citations DESC, document_id LIMIT 50""")
def missing_instruments(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most cited instruments that the corpus lacks; the report is a top list."""
    held = _nodes(spark, sf).select(F.substring_index("node_id", "__", 1).alias("document_id"))
    return I.missing_instruments(urls(spark, sf).select("url", F.col("id").alias("citations")), held, 50)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as chunks of their order."""
    line = K.table(spark, sf, "lineitem")
    return line.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("chunk_id"), F.concat(F.lit("D"), F.col("l_orderkey").cast("string")).alias("document_id"), F.concat(F.lit("https://a.org/"), (F.col("l_orderkey") % 4000).cast("string"), F.when(F.col("l_linenumber") == 1, "/contents").otherwise("")).alias("source_url"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).when(F.col("l_returnflag") == "N", "").alias("parent_node_id"), F.col("l_linestatus").alias("authority_class"), F.lit(None).cast("string").alias("legal_regime"), F.col("l_shipmode").alias("citation") if "l_shipmode" in line.columns else F.col("l_returnflag").alias("citation"),
        F.when(F.col("l_quantity") < 5, " \n").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("text"), F.col("l_linenumber").alias("chunk_ordinal"), F.when(F.col("l_discount") > 0.09, "D1").alias("superseded_by"), F.when(F.col("l_tax") > 0.07, "T1").alias("filtered_out"),
    )


_CHUNK_SQL = """c AS (SELECT l_orderkey || '-' || l_linenumber AS chunk_id, 'D' || l_orderkey AS document_id, 'https://a.org/' || (l_orderkey % 4000) || CASE WHEN l_linenumber = 1 THEN '/contents' ELSE '' END AS source_url, CASE l_returnflag WHEN 'A' THEN 'n' || l_suppkey WHEN 'N' THEN '' END AS parent_node_id,
    l_linestatus AS authority_class, l_returnflag AS citation, CASE WHEN l_quantity < 5 THEN ' ' || chr(10) ELSE CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) END AS text, l_linenumber AS chunk_ordinal, CASE WHEN l_discount > 0.09 THEN 'D1' END AS superseded_by, CASE WHEN l_tax > 0.07 THEN 'T1' END AS filtered_out FROM lineitem)"""


@query(f"""WITH {_CHUNK_SQL} SELECT authority_class, count(*) AS n, count(DISTINCT document_id) AS documents FROM c WHERE superseded_by IS NULL AND filtered_out IS NULL AND regexp_replace(text, '\\s+', '', 'g') <> '' AND source_url ILIKE '%/CONTENTS' GROUP BY 1""")
def served_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Active chunks with text, of addresses that end in /contents."""
    c = I.hosted(I.active(I.indexable(_chunks(spark, sf))), "%/CONTENTS")
    return c.groupBy("authority_class").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query(f"""WITH {_CHUNK_SQL} SELECT document_id, min(citation) AS citation, min(source_url) AS source_url, min(authority_class) AS authority_class, count(*) AS n_chunks, CAST(sum(CASE WHEN parent_node_id <> '' THEN 1 ELSE 0 END) AS BIGINT) AS identified FROM c GROUP BY document_id""")
def document_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(_chunks(spark, sf)).drop("legal_regime")


@query(f"""WITH {_CHUNK_SQL}, d AS (SELECT document_id, regexp_replace(regexp_replace(min(source_url), '^https?://(www\\.)?', ''), '/contents$', '') AS url_key, count(*) AS n, sum(CASE WHEN parent_node_id <> '' THEN 1 ELSE 0 END) AS i FROM c GROUP BY 1),
    r AS (SELECT *, first_value(document_id) OVER (PARTITION BY url_key ORDER BY i > 0 DESC, n DESC, document_id) AS canonical FROM d) SELECT url_key, document_id AS superseded, canonical, i > 0 AS superseded_has_identity FROM r WHERE document_id <> canonical""")
def superseded_documents(spark: SparkSession, sf: str) -> DataFrame:
    return I.superseded(I.documents(_chunks(spark, sf)))


@query(f"""WITH {_CHUNK_SQL} SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_ordinal, chunk_id, text) AS text FROM c WHERE superseded_by IS NULL AND filtered_out IS NULL GROUP BY document_id""")
def rechunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    return I.rebuilt_sources(_chunks(spark, sf))


@query(f"""WITH {_CHUNK_SQL}, o AS (SELECT document_id, min(authority_class) AS authority_class FROM c WHERE chunk_ordinal = 1 AND filtered_out IS NULL GROUP BY 1) SELECT chunk_id, o.authority_class, o.document_id IS NULL AS no_metadata FROM c LEFT JOIN o USING (document_id) WHERE chunk_ordinal > 5""")
def inherited_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return I.inherited(c.where("chunk_ordinal > 5"), c.where("chunk_ordinal = 1 AND filtered_out IS NULL"), ["authority_class"]).select("chunk_id", "authority_class", "no_metadata")


@query(f"""WITH {K.SQL_DOCS}, e AS (SELECT d.*, CASE doc_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'compound' ELSE 'odd' END AS cat FROM d) SELECT coalesce(authority_class, 'NONE') AS authority_class, CASE authority_class WHEN 'PRIMARY_LEGISLATION' THEN 'primary_legislation' WHEN 'SECONDARY_LEGISLATION' THEN 'secondary_legislation' WHEN 'OFFICIAL_TECHNICAL_GUIDANCE' THEN 'official_guidance' WHEN 'OFFICIAL_GOVERNMENT_GUIDANCE' THEN 'official_guidance'
    WHEN 'OFFICIAL_REGULATOR_GUIDANCE' THEN 'regulator_guidance' WHEN 'PROCUREMENT_POLICY' THEN 'regulator_guidance' WHEN 'OFFICIAL_WORKFLOW' THEN 'workflow' WHEN 'OFFICIAL_TRAINING' THEN 'workflow' WHEN 'PROFESSIONAL_INTERPRETATION' THEN 'professional_interpretation' WHEN 'INDUSTRY_PRACTICE' THEN 'professional_interpretation' ELSE 'other' END AS source_group,
    CASE authority_class WHEN 'PRIMARY_LEGISLATION' THEN 'primary_legislation' WHEN 'SECONDARY_LEGISLATION' THEN 'secondary_legislation' WHEN 'OFFICIAL_GOVERNMENT_GUIDANCE' THEN 'official_guidance' ELSE 'guidance_workflow' END AS class_group,
    CASE cat WHEN 'semantic' THEN 'semantic / practitioner phrasing' WHEN 'compound' THEN 'compound / multi-requirement' ELSE cat END AS category, CASE WHEN n_chars % 5 = 0 THEN 'essential_gold' WHEN n_chars % 3 = 0 THEN 'wrong_regime' WHEN n_chars % 2 = 0 THEN 'supporting_gold' ELSE 'non_gold' END AS gold_tag, count(*) AS n FROM e GROUP BY ALL""")
def class_names(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of classes, names of categories and tags, counted."""
    c, n = F.col("authority_class"), F.col("n_chars")
    cat = F.when(F.col("doc_id") % 3 == 0, "semantic").when(F.col("doc_id") % 3 == 1, "compound").otherwise("odd")
    return K.docs(spark, sf).groupBy(F.coalesce(c, F.lit("NONE")).alias("authority_class"), U.source_group(c).alias("source_group"), U.class_group(c).alias("class_group"), U.category_name(cat).alias("category"), U.gold_tag(n % 5 == 0, n % 3 == 0, n % 2 == 0).alias("gold_tag")).agg(F.count("*").alias("n"))


_SUFFIX = "CASE l_linenumber % 3 WHEN 0 THEN 'schedule-' || l_suppkey || '-paragraph-' || l_linenumber WHEN 1 THEN 'schedule-' || l_suppkey ELSE 'section-' || l_suppkey END"


@query(f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_SUFFIX} AS suffix, CASE WHEN l_returnflag = 'A' THEN 'UKSI_2024_716' WHEN l_returnflag = 'N' THEN 'UKPGA_2000_' || l_suppkey ELSE 'SSI_2001_1' END AS doc, l_suppkey AS num FROM lineitem)
    SELECT id, doc || CASE WHEN starts_with(suffix, 'schedule') THEN ' Sch ' || num || CASE WHEN contains(suffix, 'paragraph') THEN ' para ' || (id % 10) ELSE '' END ELSE ' s ' || num END AS citation, suffix AS rest, replace(doc, '_', ' ') || CASE WHEN starts_with(doc, 'UKPGA') THEN ' s ' ELSE ' reg ' END || num AS cited,
    CASE WHEN doc = 'UKSI_2024_716' THEN 'PA2023_COMMENCEMENT' ELSE 'CITED_SUPPORTING_LEGISLATION' END AS corpus_role, CASE WHEN starts_with(doc, 'UKPGA') THEN 'PRIMARY_LEGISLATION' ELSE 'SECONDARY_LEGISLATION' END AS authority_class, CASE WHEN contains(suffix, 'paragraph') THEN 'schedule_paragraph' WHEN contains(suffix, 'schedule-') THEN 'schedule' ELSE 'section' END AS parent_type FROM s""")
def provision_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations, roles and parent types of provisions made of each order line's numbers."""
    line = K.table(spark, sf, "lineitem")
    doc = F.expr("CASE WHEN l_returnflag = 'A' THEN 'UKSI_2024_716' WHEN l_returnflag = 'N' THEN 'UKPGA_2000_' || l_suppkey ELSE 'SSI_2001_1' END")
    s = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(_SUFFIX).alias("suffix"), doc.alias("doc"), F.col("l_suppkey").cast("string").alias("num"))
    eid = F.concat(F.lit("http-www-legislation-gov-uk-"), F.replace(F.lower("doc"), F.lit("_"), F.lit("-")), F.lit("-"), "suffix")
    s = s.withColumn("rest", U.eid_suffix(eid, F.col("doc"))).withColumn("role", U.document_role(F.col("doc")))
    return s.select("id", U.provision_citation(F.col("doc"), F.lit("s"), F.col("rest"), F.col("num")).alias("citation"), "rest", U.document_citation(F.col("doc"), F.col("num")).alias("cited"), "role.corpus_role", "role.authority_class", U.parent_type(F.col("rest"), F.lit("s 1")).alias("parent_type"))


@query("""WITH m AS (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents), w AS (SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 1 - 140, 0) + 1, p + 4 + 140 - greatest(p - 1 - 140, 0)) ELSE '' END AS context FROM m) SELECT doc_id, context, CASE WHEN instr(context, ' the ') > 0 THEN substr(context, instr(context, ' the ') + 5, 90) ELSE '' END AS "after" FROM w""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    """140 characters around each text's first ' the ' and 90 behind it."""
    start = F.nullif(F.instr("text", " the "), F.lit(0)) - 1
    w = K.table(spark, sf, "documents").select("doc_id", U.window(F.col("text"), start, start + 5).alias("context"))
    return w.select("doc_id", "context", U.after_match(F.col("context"), F.lit(" the ")).alias("after"))


_NOTES = "CASE l_orderkey % 7 WHEN 0 THEN 'Act coming into force' WHEN 1 THEN 'words inserted' WHEN 2 THEN 'F12 substituted' WHEN 3 THEN 'repealed in part' WHEN 4 THEN 'C3 applied' WHEN 5 THEN 'extent' ELSE 'This guidance was  withdrawn' END || ' ' || l_linenumber"


@query(f"""WITH n AS (SELECT {_NOTES} AS t FROM lineitem) SELECT CASE WHEN regexp_matches(t, 'coming into force') THEN 'COMMENCED_BY' WHEN regexp_matches(t, 'inserted') THEN 'INSERTED_BY' WHEN regexp_matches(t, 'substituted') THEN 'SUBSTITUTED_BY' WHEN regexp_matches(t, 'repealed') THEN 'REPEALED_BY' WHEN regexp_matches(t, 'applied') THEN 'MODIFIED_BY' ELSE 'LEGAL_EFFECT_OTHER' END AS effect,
    CASE WHEN regexp_matches(t, 'F12') THEN 'TEXTUAL_AMENDMENT' WHEN regexp_matches(t, 'C3') THEN 'MODIFICATION' WHEN regexp_matches(t, 'into force') THEN 'COMMENCEMENT' WHEN regexp_matches(t, 'extent') THEN 'EXTENT' ELSE 'OTHER_ANNOTATION' END AS annotation, CASE WHEN contains(t, 'withdrawn') THEN 'WITHDRAWN' ELSE 'CURRENT_OR_UNMARKED' END AS status, count(*) AS n FROM n GROUP BY ALL""")
def legal_effects(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr(_NOTES)
    return K.table(spark, sf, "lineitem").groupBy(U.effect_class(t).alias("effect"), U.annotation_class(t).alias("annotation"), U.document_status(t).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT term, n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) JOIN (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1) USING (term) GROUP BY ALL ORDER BY n DESC, term LIMIT 100""")
def common_words(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 commonest words; the report is a top list."""
    return I.most_common(K.tokens(spark, sf).select(F.explode("w").alias("term")), "term", 100)


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def first_events(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and type."""
    return I.first_kept(K.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH t AS (SELECT greatest(1, length(text) // 4) AS n FROM documents), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM t)
    SELECT CAST(max(CASE WHEN i = c // 10 THEN n END) AS INTEGER) AS p10, CAST(max(CASE WHEN i = CAST(floor(0.9 * c) AS BIGINT) THEN n END) AS INTEGER) AS p90, round(avg(n), 6) AS mean, CAST(max(n) AS INTEGER) AS max FROM o""")
def chunk_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank tenths of token counts, from counts of distinct values."""
    t = K.table(spark, sf, "documents").select(T.est_tokens(F.col("text")).alias("v"))
    n = M.values_before(t.groupBy("v").agg(F.count("*").alias("n")), "v")
    total = t.agg(F.count("*").alias("c"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("max"))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("v")))
    return n.crossJoin(F.broadcast(total)).agg(at(F.floor(F.col("c") / 10)).alias("p10"), at(F.floor(0.9 * F.col("c"))).alias("p90"), F.first("mean").alias("mean"), F.first("max").alias("max"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, list_transform(str_split(text, chr(10)), lambda x: length(x)) AS z, list_transform(str_split(text, chr(10)), lambda x: length(x) % 7 = 0) AS h FROM documents),
    w(doc_id, z, h, i, acc, g) AS (SELECT doc_id, z, h, 1, z[1], 1 FROM b UNION ALL SELECT doc_id, z, h, i + 1, CASE WHEN (h[i + 1] AND acc >= 400) OR acc + z[i + 1] > 1200 THEN z[i + 1] ELSE acc + z[i + 1] END, CASE WHEN (h[i + 1] AND acc >= 400) OR acc + z[i + 1] > 1200 THEN g + 1 ELSE g END FROM w WHERE i < len(z))
    SELECT doc_id, CAST(g AS INTEGER) AS segment_ordinal, CAST(count(*) AS INTEGER) AS n_blocks FROM w GROUP BY doc_id, g""")
def heading_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines grouped up to 1,200 characters; those of a length divisible by 7 are headings and begin a group that has a third of it."""
    d = K.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.format_string("L%d", i).alias("block_id"), F.when(F.length(x) % 7 == 0, "heading").otherwise("p").alias("block_type"), F.lit(None).cast("int").alias("heading_level"), x.alias("text"))).alias("blocks"))
    return G.grouped_blocks(d, 1200).select(F.col("document_id").cast("bigint").alias("doc_id"), "segment_ordinal", F.size("blocks").alias("n_blocks"))


_NINE = f"""{K.sql_ranked()}, {V._CE}, g6 AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE, {j})' for i, a, b, j in X.POOLED)}) t(config, al, be, ju)),
    pn AS (SELECT *, {K.sql_norm('bm25', 'query_id')} AS b_n, {K.sql_norm('dense', 'query_id')} AS d_n, {K.sql_norm('authority_weight', 'query_id')} AS a_n FROM cand),
    ps AS (SELECT config, query_id, lane, doc_id, ((be * b_n + (1 - be) * d_n) * (1 - al) + a_n * al) * CASE WHEN ju THEN jurisdiction_weight ELSE 1 END AS s FROM pn, g6),
    ln AS (SELECT *, {K.sql_norm('bm25', 'query_id, lane')} AS b_n, {K.sql_norm('dense', 'query_id, lane')} AS d_n FROM cand),
    al AS (SELECT config, query_id, lane, doc_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(s, 9) DESC, doc_id) AS r, 50 AS k FROM ps
        UNION ALL SELECT 7, query_id, lane, doc_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY round((0.4 * b_n + 0.6 * d_n) * jurisdiction_weight, 9) DESC, doc_id), 25 FROM ln
        UNION ALL SELECT 8, query_id, lane, doc_id, rank, 25 FROM ranked UNION ALL SELECT 9, query_id, lane, doc_id, post_rank, 25 FROM post_)"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    pool = K.candidates(spark, sf, C.CANDIDATES_FROZEN)
    return written(pool.join(V.overlap_scores(spark, sf), ["query_id", "doc_id"], "left"))  # several configurations read it


@query(f"WITH {_NINE} SELECT CAST(config AS INTEGER) AS config, query_id, lane, doc_id, CAST(r AS INTEGER) AS rank FROM al WHERE r <= k AND r <= 10")
def same_budget_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of nine configurations of one budget."""
    return X.same_budget(_pool(spark, sf)).where("rank <= 10")


@query(f"""WITH {_NINE}, {K.SQL_GOLD}, tgt AS (SELECT query_id, lane AS requirement_id, doc_id FROM gold JOIN d USING (doc_id)), cf AS (SELECT unnest(range(1, 10)) AS config),
    h AS (SELECT cf.config, tgt.query_id, requirement_id, bool_or(al.doc_id IS NOT NULL) AS hit FROM tgt CROSS JOIN cf LEFT JOIN al ON al.config = cf.config AND al.query_id = tgt.query_id AND al.doc_id = tgt.doc_id AND r <= k GROUP BY ALL), s AS (SELECT config, query_id, sum(hit::INT) AS s, count(*) AS t, min(hit::INT) AS c FROM h GROUP BY ALL)
    SELECT CAST(config AS INTEGER) AS config, round(sum(s) / sum(t), 6) AS weighted_recall, round(avg(s / t), 6) AS macro_recall, round(avg(c), 6) AS complete FROM s GROUP BY config""")
def same_budget_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Requirement recall and complete coverage of the nine configurations, all in one pass."""
    kept = X.same_budget(_pool(spark, sf)).select("config", "query_id", "doc_id").withColumn("in_top", F.lit(True))
    t = V.targets(spark, sf).withColumn("config", F.explode(F.sequence(F.lit(1), F.lit(9))))
    h = t.join(kept, ["config", "query_id", "doc_id"], "left").groupBy("config", "query_id", "requirement_id").agg(F.coalesce(F.bool_or("in_top"), F.lit(False)).cast("int").alias("hit"))
    s = h.groupBy("config", "query_id").agg(F.sum("hit").alias("s"), F.count("*").alias("t"), F.min("hit").alias("c"))
    return s.groupBy("config").agg(F.round(F.sum("s") / F.sum("t"), 6).alias("weighted_recall"), F.round(F.avg(F.col("s") / F.col("t")), 6).alias("macro_recall"), F.round(F.avg("c"), 6).alias("complete"))


@query(f"""WITH {K.sql_ranked()}, {K.SQL_GOLD}, gr AS (SELECT query_id, doc_id, CASE WHEN coverage >= 0.9 THEN 2 ELSE 1 END AS grade FROM gold),
    i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM gr) WHERE r <= 10 GROUP BY 1),
    a AS (SELECT gr.query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM gr JOIN ranked ON ranked.query_id = gr.query_id AND ranked.doc_id = gr.doc_id WHERE rank <= 10 GROUP BY 1) SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM i LEFT JOIN a USING (query_id)""")
def graded_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    grades = K.gold(spark, sf).select("query_id", "doc_id", F.when(F.col("coverage") >= 0.9, 2).otherwise(1).alias("grade"))
    return M.graded_ndcg(K.ranked(spark, sf), grades, 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""WITH {K.sql_ranked()}, s AS (SELECT 'bm25' AS signal, 0.4 AS coefficient, 0.4 * bm25_norm AS v FROM ranked UNION ALL SELECT 'dense', 0.6, 0.6 * dense_norm FROM ranked UNION ALL SELECT 'authority', 0.1, 0.1 * authority_norm FROM ranked), a AS (SELECT signal, CAST(coefficient AS DOUBLE) AS coefficient, max(v) - min(v) AS er, stddev_samp(v) AS sd, avg(v) AS m, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS sp FROM s GROUP BY ALL)
    SELECT signal, coefficient, round(er, 6) AS effective_range, round(sd / abs(m), 6) AS coefficient_of_variation, round(sd / sum(sd) OVER (), 6) AS relative_contribution_share, round(sp, 6) AS p10_p90_spread FROM a""")
def signal_effective_range(spark: SparkSession, sf: str) -> DataFrame:
    r = M.effective_range(K.ranked(spark, sf), {"bm25": ("bm25_norm", 0.4), "dense": ("dense_norm", 0.6), "authority": ("authority_norm", 0.1)})
    return r.select("signal", "coefficient", *(F.round(c, 6).alias(c) for c in ("effective_range", "coefficient_of_variation", "relative_contribution_share", "p10_p90_spread")))


@query(f"""WITH {K.sql_ranked()}, f AS (SELECT query_id, lane, doc_id, authority_class, rank, row_number() OVER (PARTITION BY query_id, lane ORDER BY round(fusion_score, 9) DESC, rank) AS fr FROM ranked) SELECT coalesce(authority_class, 'NONE') AS authority_class, count(*) AS n, round(avg(fr - rank), 6) AS mean_move, CAST(quantile_cont(fr - rank, 0.5) AS DOUBLE) AS median_move FROM f GROUP BY 1""")
def authority_rank_moves(spark: SparkSession, sf: str) -> DataFrame:
    """By how many places authority moves a class: rank by the fused score less the final one."""
    r = R.top(K.ranked(spark, sf).withColumnRenamed("rank", "final_rank"), ["query_id", "lane"], "fusion_score", 1 << 30, "fused_rank", "final_rank")
    move = F.col("fused_rank") - F.col("final_rank")
    return r.groupBy(F.coalesce("authority_class", F.lit("NONE")).alias("authority_class")).agg(F.count("*").alias("n"), F.round(F.avg(move), 6).alias("mean_move"), F.percentile(move, 0.5).alias("median_move"))


@query("SELECT 0.0::DOUBLE AS max_error")
def score_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """The largest difference of final scores worked out anew from their parts, to nine decimals."""
    return M.reconstruction_error(K.ranked(spark, sf), C.ALPHA_FROZEN).select(F.round("max_error", 9).alias("max_error"))


def _corpus(spark: SparkSession, sf: str) -> X.Corpus:
    """documents as a corpus: each refers to the next but one of its source's number, and is its own node."""
    d = K.docs(spark, sf)
    edges = d.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("REFERENCES").alias("relation"), (F.col("doc_id") + 7).cast("string").alias("target_id"), (0.5 + F.col("doc_id") % 10 / 20.0).alias("confidence"))
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_node_id"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), F.lit(None).cast("string").alias("legal_regime"), "jurisdiction")
    return X.Corpus(K.tokens(spark, sf), K.vectors(spark, sf), d.select("doc_id", "lane", "authority_class", "jurisdiction"), edges, chunks)


def _arm(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = X.searched(_corpus(spark, sf), K.query_terms(spark, sf), K.query_vectors(spark, sf), candidates=40, **X.ARMS[name])
        return found.select("query_id", "doc_id", F.round("final_score", 6).alias("final_score"), "via_graph_only", "rank")

    run.__name__ = f"search_arm_{name.lower()}"
    run.__doc__ = f"Arm {name} of the ablation: {X.ARMS[name] or 'all channels'}."
    return run


def _arm_sql(name: str) -> str:
    a = {"lexical": True, "dense": True, "graph": True, "rerank": True} | X.ARMS[name]
    ids = " UNION ".join(([f"SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM lex) WHERE r <= 40"] if a["lexical"] else []) + ([f"SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, doc_id) AS r FROM den) WHERE r <= 40"] if a["dense"] else []))
    raw = f"SELECT x.query_id, x.doc_id, {{core}} AS core, {'coalesce(bm25, 0.0)' if a['lexical'] else '0.0'} AS bm25, {'dense' if a['dense'] else '0.0'} AS dense FROM {{ids}} x LEFT JOIN lex ON lex.query_id = x.query_id AND lex.doc_id = x.doc_id JOIN den ON den.query_id = x.query_id AND den.doc_id = x.doc_id"

    def norm(c: str, by: str = "query_id", core: str = "core") -> str:
        v = f"CASE WHEN {core} THEN {c} END"
        sd = f"coalesce(stddev_pop({v}) OVER (PARTITION BY {by}), 0)"
        return f"(tanh(({c} - avg({v}) OVER (PARTITION BY {by})) / CASE WHEN {sd} < 1e-12 THEN 1 ELSE {sd} END) + 1) / 2"

    b, d = norm("bm25") if a["lexical"] else "0.0", norm("dense") if a["dense"] else "0.0"
    graph = f""", f0 AS (SELECT *, 0.4 * {norm('bm25')} + 0.6 * {norm('dense')} AS f FROM p0), sd AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, doc_id) AS r FROM f0) WHERE r <= 10),
        ge AS (SELECT sd.query_id, CAST(sd.doc_id AS VARCHAR) AS s, CAST(sd.doc_id + 7 AS VARCHAR) AS t, 0.5 + sd.doc_id % 10 / 20.0 AS c FROM sd JOIN d USING (doc_id)), gk AS (SELECT query_id, t, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, s, t) AS r FROM ge) WHERE r <= 40 GROUP BY ALL),
        gn AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY r) AS gr FROM gk WHERE t NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM sd WHERE sd.query_id = gk.query_id)),
        gc AS (SELECT query_id, d.doc_id, 1.0 / row_number() OVER (PARTITION BY query_id ORDER BY gr, t) AS g FROM gn JOIN d ON CAST(d.doc_id AS VARCHAR) = t WHERE d.jurisdiction <> 'EU'), gz AS (SELECT *, {norm('g', core='true')} AS gn FROM gc), gx AS (SELECT query_id, doc_id FROM gz WHERE NOT EXISTS (SELECT 1 FROM p0 WHERE p0.query_id = gz.query_id AND p0.doc_id = gz.doc_id)), p1 AS (SELECT * FROM p0 UNION ALL {raw.format(core='false', ids='gx')})""" if a["graph"] else ", p1 AS (SELECT * FROM p0)"
    gz = "LEFT JOIN gz ON gz.query_id = p1.query_id AND gz.doc_id = p1.doc_id" if a["graph"] else ""
    g = "coalesce(0.6 * gn, 0)" if a["graph"] else "0"
    final = f"((0.4 * b + 0.6 * dd + g) * 0.7 + {norm('authority_weight', core='true')} * 0.3) * jurisdiction_weight" if a["rerank"] else "0.4 * b + 0.6 * dd + g"
    return f"""WITH {', '.join((K.SQL_DOCS, K.SQL_TOKENS, K.SQL_QUERY, K.SQL_BM25, K.SQL_DENSE))}, i0 AS ({ids}), p0 AS ({raw.format(core='true', ids='i0')}){graph},
        z AS (SELECT p1.*, {b} AS b, {d} AS dd FROM p1), y AS (SELECT z.*, {g} AS g, authority_class, lane, authority_weight, jurisdiction_weight FROM z JOIN d USING (doc_id) {gz.replace('p1', 'z')}), x AS (SELECT *, {final} AS final_score FROM y),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS rank FROM x), m AS (SELECT *, min(CASE WHEN lane = 'legislation' THEN rank END) OVER (PARTITION BY query_id) AS best FROM r),
        o AS (SELECT query_id, doc_id, round(final_score, 6) AS final_score, NOT core AS via_graph_only, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best > 3 AND rank = best THEN 0 ELSE rank END) AS INTEGER) AS rank FROM m) SELECT * FROM o WHERE rank <= 10"""


for _name in X.ARMS:
    _run = _arm(_name)
    QUERIES[_run.__name__], ORACLES[_run.__name__] = _run, _arm_sql(_name)


@query(None)
def two_lane_graph_search(spark: SparkSession, sf: str) -> DataFrame:
    """Both lanes retrieved and ranked by themselves, with a graph channel that they share."""
    return X.searched(_corpus(spark, sf), K.query_terms(spark, sf), K.query_vectors(spark, sf), top_k=25, candidates=C.CANDIDATES, by_lane=True, alpha=C.ALPHA_FROZEN).select("query_id", "lane", "doc_id", "final_score", "via_graph_only", "rank")


@query(None)
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted requirement recall of two lanes after reranking against the pooled hybrid, queries drawn whole."""
    kept = X.same_budget(_pool(spark, sf)).where("config IN (3, 9)").select("config", "query_id", "doc_id").withColumn("in_top", F.lit(True))
    t = V.targets(spark, sf).withColumn("config", F.explode(F.array(F.lit(3), F.lit(9))))
    h = t.join(kept, ["config", "query_id", "doc_id"], "left").groupBy("query_id", "config", "requirement_id").agg(F.coalesce(F.bool_or("in_top"), F.lit(False)).cast("int").alias("hit"))
    s = h.groupBy("query_id").agg(*(F.sum(F.when(F.col("config") == c, x)).alias(n) for c, n, x in ((9, "sat_a", F.col("hit")), (9, "tot_a", F.lit(1)), (3, "sat_b", F.col("hit")), (3, "tot_b", F.lit(1)))))
    return M.clustered(s.withColumn("comparison", F.lit("two_lane_vs_pooled")), ["comparison"])
