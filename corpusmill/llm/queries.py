"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import ann, bpe, fingerprints, jaccard_join, langid, packing, token_counts, toxicity, url_filters, warc
from corpusmill.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contents(warc.write(table(spark, sf_dir, "pages"), warc.shared_folder(spark, "warc"), least_bytes=0), spark)


#: Rules of op10: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_langid, op2_ann, op3_jaccard_join, op4_fingerprints, op5_packing, op6_toxicity, op7_token_counts, op8_byte_bpe, op9_warc, op10_url_filters)}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        t AS (SELECT doc_id, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(root, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT root, e.b FROM r JOIN e ON e.a = r.node)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(node) AS component_id FROM r JOIN n ON n.doc_id = root GROUP BY n.doc_id, n.n
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (
            SELECT page_id, octet_length(payload) AS n, min(page_id) OVER (PARTITION BY payload) AS first_id,
                array_to_string(list_transform(range(8), lambda g: (
                    array_to_string(list_transform([32768, 1024, 32, 1], lambda u:
                        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) // u) % 32 + 1 AS INTEGER), 1)), '')
                )), '') AS digest
            FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM d
    """,
}


def _sql_of_url_filters(rounds: int = 8, damping: float = 0.85) -> str:
    """SQL of op10: rules, seeds, and the rounds of propagation written out."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    after = lambda x: f"(CASE WHEN instr({x}, '://') > 0 THEN substr({x}, instr({x}, '://') + 3) ELSE '' END)"
    host = lambda x: lower(f"regexp_extract({after(x)}, '^([^/?#]*)', 1)")
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda give: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{give(v, h, p)}'" for v, h, p in rules) + " END"
    ctes = [
        "p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)",
        f"u AS (SELECT page_id, {host('url')} AS host, regexp_extract({after('url')}, '^[^/?#]*([^?#]*)', 1) AS path FROM p)",
        f"j AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said FROM u)",
        f"""k AS (SELECT {host('url')} AS source, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?((?:https?:)?//[^\\s"''<>]+)', 1)) AS link FROM p)""",
        f"l AS (SELECT source, {host('link')} AS target FROM (SELECT source, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS link FROM k))",
        "e AS (SELECT source, target, count(*) AS n FROM l WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL)",
        "v AS (SELECT host, count(*) AS pages, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM j WHERE host <> '' GROUP BY host)",
        "tf AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM e)",
        "df AS (SELECT target AS source, source AS target, n / sum(n) OVER (PARTITION BY target) AS share FROM e)",
        "ts AS (SELECT host, allow::DOUBLE / sum(allow) OVER () AS mass FROM v WHERE 2 * allow > pages)",
        "ds AS (SELECT host, block::DOUBLE / sum(block) OVER () AS mass FROM v WHERE 2 * block > pages)",
    ]
    for c in "td":
        for i in range(1, rounds + 1):
            before = f"{c}{i - 1}" if i > 1 else f"{c}s"
            ctes.append(f"{c}r{i} AS (SELECT host, sum(mass) AS mass FROM (SELECT host, {1 - damping} * mass AS mass FROM {c}s UNION ALL SELECT target, {damping} * mass * share FROM {before} JOIN {c}f ON host = source) GROUP BY host)")
            ctes.append(f"{c}{i} AS (SELECT r.host, r.mass + coalesce(s.mass, 0) * (1 - (SELECT sum(mass) FROM {c}r{i})) AS mass FROM {c}r{i} r LEFT JOIN {c}s s ON s.host = r.host)")
    return f"""WITH {', '.join(ctes)} SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN t{rounds} t ON t.host = j.host LEFT JOIN d{rounds} d ON d.host = j.host"""


ORACLES["op10_url_filters"] = _sql_of_url_filters()
