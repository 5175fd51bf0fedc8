"""Resolution of references: locators, addresses and placeholders to nodes and documents of the corpus.

Every look-up is an equality join on keys worked out from the reference; the ladder that decides is one expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import rules as U
from corpusmill.functions import text as T
from corpusmill.operators import graph as G

RESULT = "struct<status:string,target_node_id:string,target_document_id:string,confidence:double>"


def _result(status: str, node: Column | None, document: Column | None, confidence: float) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), (none if node is None else node).alias("target_node_id"), (none if document is None else document).alias("target_document_id"), F.lit(confidence).alias("confidence"))


def located(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (look_doc, look_unit, look_parts) with node and how: EXACT, the deepest existing ANCESTOR of the locator, or ABSENT."""
    unit = F.concat(F.col("look_doc"), F.lit("__"), F.col("look_unit"))
    r = refs.withColumn("_id", F.when((F.size("look_parts") > 0) & unit.isNotNull(), F.concat_ws("-", unit, F.array_join("look_parts", "-"))))
    found = G.rolled_up(r.select(F.col("_id").alias("id")).where("id IS NOT NULL").distinct(), nodes).select(F.col("id").alias("_id"), "retrieval_id", "how")
    above = (F.col("how") == "ANCESTOR") & (F.col("retrieval_id") != unit)
    how = F.when(F.col("how") == "DIRECT", "EXACT").when(above, "ANCESTOR").otherwise("ABSENT")
    return r.join(found, "_id", "left").withColumns({"node": F.when(F.col("how").eqNullSafe(F.lit("DIRECT")) | above, F.col("retrieval_id")), "how": how}).drop("_id", "retrieval_id")


def named_instrument(text: Column) -> Column:
    """Id of the first instrument of the corpus that the text names."""
    return F.coalesce(*(F.when(text.rlike(p), d) for p, d in C.NAMED_INSTRUMENTS))


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def resolve_regex(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (source_document_id, source_node_id, reference_type, locator, matched_text, start_char, end_char) with result.

    A citation that the following words give to another instrument goes there if the corpus names it; changes to other instruments are ambiguous; a
    unit that the source doesn't have goes to the Act it is made under; all else resolves inside: exactly, to the nearest ancestor or to the document.
    nodes: node_id, text.
    """
    r = refs.join(nodes.select(F.col("node_id").alias("source_node_id"), F.col("text").alias("_text")), "source_node_id", "left")
    context = U.window(F.col("_text"), F.col("start_char"), F.col("end_char"))
    r = r.withColumn("_context", context).withColumn("_after", U.after_match(F.col("_context"), F.coalesce("matched_text", F.lit(""))))
    document, unit = F.col("source_document_id"), F.lower("reference_type")
    r = r.withColumns({
        "_other": named_instrument(F.col("_after")), "_external": F.col("_after").rlike(C.EXTERNAL_QUALIFIER), "_change": F.col("_context").rlike(C.AMENDMENT) & F.col("_context").rlike(C.EXTERNAL_QUALIFIER),
        "_unit": F.when(unit.isin("section", "regulation", "schedule", "part"), unit), "_own": _of(C.UNITS, F.substring_index(document, "_", 1)), "_act": _of(C.ENABLING_ACTS, document),
    })
    elsewhere = F.col("_external") & F.col("_other").isNotNull() & (F.col("_other") != document)
    foreign = F.col("_unit").isin("section", "regulation") & F.col("_own").isNotNull() & (F.col("_unit") != F.col("_own"))
    to_act = foreign & (F.col("_unit") == "section") & F.col("_act").isNotNull()
    look_doc = F.when(elsewhere, F.col("_other")).when(to_act, F.col("_act")).otherwise(document)
    look_unit = F.when(elsewhere, F.coalesce(_of(C.UNITS, F.substring_index("_other", "_", 1)), F.lit("section"))).otherwise(F.col("_unit"))
    r = located(r.withColumns({"look_doc": look_doc, "look_unit": look_unit, "look_parts": T.locator_parts(F.col("locator"))}), nodes)
    node, how, at = F.col("node"), F.col("how"), F.col("look_doc")
    ladder = (
        F.when(elsewhere & (how == "EXACT"), _result("EXACT_CROSS_DOCUMENT", node, at, 0.9)).when(elsewhere & (how == "ANCESTOR"), _result("NEAREST_ANCESTOR", node, at, 0.7)).when(elsewhere, _result("DOCUMENT_ONLY", None, at, 0.5))
        .when(F.col("_external"), _result("TARGET_NOT_IN_CORPUS", None, None, 0.9)).when(F.col("_change"), _result("AMBIGUOUS", None, None, 0.5)).when(F.col("_unit").isNull(), _result("UNRESOLVED", None, None, 0.0))
        .when(to_act & (how == "EXACT"), _result("EXACT_CROSS_DOCUMENT", node, at, 0.8)).when(to_act & (how == "ANCESTOR"), _result("NEAREST_ANCESTOR", node, at, 0.65)).when(foreign, _result("EXTERNAL_INSTRUMENT_REFERENCE", None, None, 0.5))
        .when(how == "EXACT", _result("EXACT_INTERNAL", node, document, 0.95)).when(how == "ANCESTOR", _result("NEAREST_ANCESTOR", node, document, 0.75)).otherwise(_result("DOCUMENT_ONLY", None, document, 0.4))
    )
    return r.select(*refs.columns, ladder.cast(RESULT).alias("result"))


def resolve_url(refs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """refs (url) with result. nodes: node_id; documents: document_id, source_url.

    Addresses of legislation go to a provision, its nearest ancestor or the document, if the corpus has that; others to the document of equal address.
    """
    url = F.coalesce("url", F.lit(""))
    part = lambda i: F.nullif(F.regexp_extract(url, C.LEGISLATION_URL, i), F.lit(""))
    r = refs.withColumns({"look_doc": F.when(url.rlike(C.LEGISLATION_URL), U.canonical_doc_id(part(1), part(2), part(3))), "look_unit": F.lower(part(4)), "look_parts": T.locator_parts(part(5)), "_key": U.url_key(url)})
    held = nodes.select(F.substring_index("node_id", "__", 1).alias("look_doc")).distinct().withColumn("_held", F.lit(True))
    by_url = documents.where(F.coalesce("source_url", F.lit("")) != "").groupBy(U.url_key(F.col("source_url")).alias("_key")).agg(F.max("document_id").alias("_doc"))
    r = located(r.join(held, "look_doc", "left").join(by_url, "_key", "left"), nodes)
    node, how, at, legal = F.col("node"), F.col("how"), F.col("look_doc"), F.col("look_doc").isNotNull()
    provision = F.col("look_unit").isNotNull() & (F.coalesce(part(5), F.lit("")) != "")
    ladder = (
        F.when(url == "", _result("UNRESOLVED", None, None, 0.0)).when(F.lower(url).startswith("mailto:") | F.lower(url).startswith("tel:"), _result("NOT_A_LEGAL_REFERENCE", None, None, 1.0))
        .when(legal & F.col("_held").isNull(), _result("TARGET_NOT_IN_CORPUS", None, at, 0.9)).when(legal & provision & (how == "EXACT"), _result("EXACT_URL", node, at, 0.98)).when(legal & provision & (how == "ANCESTOR"), _result("NEAREST_ANCESTOR", node, at, 0.75))
        .when(legal & provision, _result("DOCUMENT_ONLY", None, at, 0.5)).when(legal, _result("EXACT_DOCUMENT", None, at, 0.9)).when(F.col("_doc").isNotNull(), _result("EXACT_DOCUMENT", None, F.col("_doc"), 0.9))
        .when(U.url_host(url) != "", _result("TARGET_NOT_IN_CORPUS", None, None, 0.6)).otherwise(_result("UNRESOLVED", None, None, 0.0))
    )
    return r.select(*refs.columns, ladder.cast(RESULT).alias("result"))


_HREF = r"(?i)^(section|regulation|schedule|part|article)[-_]?([\w\-.]*)$"


def resolve_structured(refs: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """refs (source_document_id, raw_href, absolute_url) with result: web addresses as ``resolve_url``, opaque keys unresolved, section-… hrefs inside the document."""
    href = F.trim(F.coalesce("raw_href", F.lit("")))
    web = href.startswith("http")
    r = resolve_url(refs.withColumn("url", F.when(web, F.coalesce(F.nullif("absolute_url", F.lit("")), href)).otherwise("")), nodes, documents).withColumnRenamed("result", "_web")
    unit, parts = F.lower(F.regexp_extract(href, _HREF, 1)), F.filter(F.split(F.regexp_extract(href, _HREF, 2), r"[-.]"), lambda p: p != "")
    r = located(r.withColumns({"look_doc": F.col("source_document_id"), "look_unit": F.nullif(unit, F.lit("")), "look_parts": parts}), nodes)
    inside, document = (unit != "") & ~href.startswith("key-"), F.col("source_document_id")
    ladder = (
        F.when(web, F.col("_web")).when(inside & (F.size(parts) == 0), _result("DOCUMENT_ONLY", None, document, 0.4).cast(RESULT)).when(inside & (F.col("how") == "EXACT"), _result("EXACT_INTERNAL", F.col("node"), document, 0.95).cast(RESULT))
        .when(inside & (F.col("how") == "ANCESTOR"), _result("NEAREST_ANCESTOR", F.col("node"), document, 0.75).cast(RESULT)).otherwise(_result("UNRESOLVED", None, None, 0.0).cast(RESULT))
    )
    return r.select(*refs.columns, ladder.alias("result"))


def outcome(resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, rows held for review, and counts by candidate type and status, of resolved rows (candidate_type, source_id, relation, evidence, result).

    The first row of a source, relation and target by ``order`` makes the edge; repeated ones are neither edges nor held.
    """
    target = F.coalesce("result.target_node_id", "result.target_document_id")
    r = resolved.withColumn("target_id", target).withColumn("creates", F.col("result.status").isin(*C.EDGE_STATUSES) & F.col("source_id").isNotNull() & target.isNotNull())
    edges = r.where("creates").groupBy("source_id", "relation", "target_id").agg(F.min_by(F.struct("evidence", F.col("result.status").alias("resolution_status"), F.col("result.confidence").alias("confidence")), "order").alias("e")).select("source_id", "relation", "target_id", "e.*")
    counts = r.groupBy("candidate_type", F.col("result.status").alias("status")).agg(F.count("*").alias("n"))
    return edges, r.where("NOT creates").drop("creates", "target_id"), counts


def provision_keys(nodes: DataFrame) -> DataFrame:
    """key (document|type|NUMBER) and node_id, of keys that just one node has; regulations are articles as well. nodes: document_id, node_id, node_type, number."""
    number = T.norm_locator(F.col("number"))
    kinds = F.when(F.lower("node_type") == "regulation", F.array(F.lit("regulation"), F.lit("article"))).otherwise(F.array(F.lower("node_type")))
    keys = nodes.where(number.isNotNull()).select("node_id", F.explode(F.transform(kinds, lambda k: F.concat_ws("|", "document_id", k, number))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1").select("key", "node_id")


def exact_provisions(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """refs (document_id, kind, locator) with node_id where the key is unique; an article is looked up as a regulation too."""
    r = refs.withColumn("key", F.concat_ws("|", "document_id", F.lower("kind"), T.norm_locator(F.col("locator"))))
    return r.join(keys, "key", "left").drop("key")


def placeholder_links(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunk_id, placeholder, url and anchor_text of every placeholder in chunks (chunk_id, source_id, text); without a link ``reason`` says so."""
    p = chunks.select("chunk_id", "source_id", F.explode(F.array_distinct(T.placeholders(F.col("text")))).alias("placeholder"))
    known = links.select("source_id", "placeholder", F.col("absolute_url").alias("url"), "anchor_text", F.lit(True).alias("_known")).dropDuplicates(["source_id", "placeholder"])
    return p.join(known, ["source_id", "placeholder"], "left").withColumn("reason", F.when(F.col("_known").isNull(), "missing link")).drop("_known")


# How provisions are numbered in citations, alone and as parts of the provision at hand.
_ITEM = r"\d+[A-Za-z]?(?:\([0-9A-Za-z]+\))*"
_LOCAL = r"\([0-9A-Za-z]+\)(?:\([0-9A-Za-z]+\))*"


def _suite(kind: str) -> list[tuple[str, re.Pattern, float]]:
    """Patterns in order of precedence: what an earlier one covers, later ones leave alone."""
    short, local = ("s", "subsection") if kind == "section" else ("reg", "paragraph")
    joint = r"\s*(?:,|and|or)\s*"
    return [
        ("LIST", re.compile(rf"\b{kind}s?\s+(?P<body>{_ITEM}(?:{joint}{_ITEM})+)", re.I), 0.99),
        ("EXPLICIT", re.compile(rf"\b(?:{kind}|{short}\.)\s*(?P<body>{_ITEM})", re.I), 0.99),
        ("LOCAL", re.compile(rf"\b{local}s?\s+(?P<body>{_LOCAL}(?:{joint}{_LOCAL})*)", re.I), 0.97),
        ("SCHEDULE_PARAGRAPH", re.compile(rf"\bparagraphs?\s+(?P<body>{_ITEM})\s+of\s+Schedule\s+(?P<s>\d+[A-Za-z]?)", re.I), 0.99),
        ("SCHEDULE", re.compile(r"\bSchedule\s+(?P<body>\d+[A-Za-z]?)\b", re.I), 0.97),
        ("PART", re.compile(r"\bPart\s+(?P<body>\d+[A-Za-z]?)\b", re.I), 0.97),
    ]


def cross_reference_spans(text: str, kind: str, own_number: str | None) -> list[tuple[str, str, list[str], int, int, float]]:
    """(pattern, unit, locator parts, start, end, confidence) of every reference in a text; spans don't overlap, but for schedules and parts among themselves."""
    taken: list[tuple[int, int]] = []
    out = []
    for name, pattern, sure in _suite(kind):
        if name == "LOCAL" and not own_number:
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if name != "LIST" and any(a < y and b > x for x, y in taken):
                continue
            if name not in ("SCHEDULE", "PART"):
                taken.append((a, b))
            for item in re.split(r"\s*(?:,|and|or)\s*", m["body"]) if name in ("LIST", "LOCAL") else [m["body"]]:
                head, chain = re.match(r"\d*[A-Za-z]?", item.strip())[0] if name != "LOCAL" else own_number, re.findall(r"\(([0-9A-Za-z]+)\)", item)
                if name == "SCHEDULE_PARAGRAPH":
                    out.append((name, "schedule", [m["s"], "paragraph", head, *chain], a, b, sure))
                elif head and (name != "LOCAL" or chain):
                    out.append((name, {"SCHEDULE": "schedule", "PART": "part"}.get(name, kind), [head, *chain], a, b, sure))
    return out


def cross_references(nodes: DataFrame, kind: str) -> DataFrame:
    """Edges from nodes (node_id, document_id, text, own_number) to what their texts cite; a locator that no node has goes to its nearest ancestor, or is held for ``review``."""
    def run(frames):
        for f in frames:
            rows = []
            for node, document, text, own in zip(f["node_id"], f["document_id"], f["text"], f["own_number"], strict=True):
                text = " ".join((text or "").split())
                for name, unit, parts, a, b, sure in cross_reference_spans(text, kind, own or None):
                    rows.append((node, document, name, unit, parts, text[a:b], " ".join(text[max(0, a - 150) : b + 150].split()), sure))
            yield pd.DataFrame(rows, columns=["source_node_id", "look_doc", "pattern", "look_unit", "look_parts", "matched_text", "evidence", "confidence"])

    found = nodes.select("node_id", "document_id", "text", "own_number").mapInPandas(run, "source_node_id string, look_doc string, pattern string, look_unit string, look_parts array<string>, matched_text string, evidence string, confidence double")
    r = located(found, nodes)
    locator = F.concat_ws("-", "look_unit", F.array_join("look_parts", "-"))
    r = r.select("source_node_id", "pattern", locator.alias("target_locator"), F.col("node").alias("target_node_id"), F.col("how").alias("target_resolution"), "matched_text", "evidence", "confidence")
    r = r.where(F.col("target_node_id").isNull() | (F.col("target_node_id") != F.col("source_node_id"))).dropDuplicates(["source_node_id", "target_locator", "matched_text"])
    return r.withColumn("review", F.col("target_resolution") == "ABSENT")


def merged_references(structured: DataFrame, regex: DataFrame) -> DataFrame:
    """Both sets of (source_id, relation, locator, …), one row of each key; structured ones win."""
    both = structured.withColumn("_p", F.lit(0)).unionByName(regex.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    keys = ["source_id", "relation", "locator"]
    rest = [c for c in both.columns if c not in (*keys, "_p")]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("r")).select(*keys, "r.*")
