"""The corpus as an index: which chunks take part, roll-ups by document, edge families, supersession, gold targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import rules as U
from corpusmill.functions import text as T


def indexable(chunks: DataFrame) -> DataFrame:
    """Chunks with text other than white space."""
    return chunks.where(T.stripped(F.coalesce("text", F.lit(""))) != "")


def active(chunks: DataFrame) -> DataFrame:
    """Chunks that nothing supersedes and no filter has taken out."""
    return chunks.where(F.col("superseded_by").isNull() & F.col("filtered_out").isNull())


def loaded(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Active chunks of the given chunk_ids."""
    return active(chunks).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def hosted(rows: DataFrame, pattern: str, column: str = "source_url") -> DataFrame:
    """Rows whose address is like the SQL pattern, in any case."""
    return rows.where(F.col(column).ilike(pattern))


def documents(chunks: DataFrame) -> DataFrame:
    """A row a document: least citation, address, class and regime, number of chunks and of those with a parent node."""
    first = (F.min(c).alias(c) for c in ("citation", "source_url", "authority_class", "legal_regime"))
    return chunks.groupBy("document_id").agg(*first, F.count("*").alias("n_chunks"), F.sum(F.when(F.col("parent_node_id") != "", 1).otherwise(0)).alias("identified"))


def superseded(docs: DataFrame) -> DataFrame:
    """url_key, superseded, canonical, superseded_has_identity of documents of equal address (document_id, source_url, n_chunks, identified).

    Canonical is one with parsed identity before one without, then the larger, then the least id.
    """
    d = docs.where(F.coalesce("source_url", F.lit("")) != "").withColumn("url_key", T.dedupe_url(F.col("source_url")))
    best = d.groupBy("url_key").agg(F.min(F.struct((F.col("identified") == 0).alias("a"), (-F.col("n_chunks")).alias("b"), "document_id")).alias("best"), F.count("*").alias("members")).where("members > 1")
    return d.join(best, "url_key").where("document_id <> best.document_id").select("url_key", F.col("document_id").alias("superseded"), F.col("best.document_id").alias("canonical"), (F.col("identified") > 0).alias("superseded_has_identity"))


def rescoped(qrels: DataFrame, chunks: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgements that stay when the plan's superseded documents go, and one row of what is lost."""
    gone = chunks.join(plan.select(F.col("superseded").alias("document_id")).distinct(), "document_id", "left_semi").select("chunk_id").distinct()
    lost = qrels.join(gone, "chunk_id", "left_semi")
    return qrels.join(gone, "chunk_id", "left_anti"), lost.agg(F.count("*").alias("judgements"), F.coalesce(F.sum((F.col("relevance") >= 2).cast("int")), F.lit(0)).alias("relevant_lost"), F.countDistinct("query_id").alias("queries_touched"))


def applied(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """chunks with superseded_by set as the plan says; a plan is only looked at until it is applied."""
    p = plan.select(F.col("superseded").alias("document_id"), F.col("canonical").alias("_by"))
    return chunks.join(p, "document_id", "left").withColumn("superseded_by", F.coalesce("_by", F.col("superseded_by") if "superseded_by" in chunks.columns else F.lit(None))).drop("_by")


def edge_families(v1: DataFrame, v2: DataFrame, guidance: DataFrame) -> DataFrame:
    """All edges with their origin: structural ones, resolved references, those of the first version only if there are no resolved ones, and guidance's."""
    structural = F.col("relation").isin("CONTAINS", "HAS_CHUNK")
    any_v2 = v2.limit(1).agg((F.count("*") > 0).alias("any"))  # one row
    old = v1.where(~structural).crossJoin(F.broadcast(any_v2)).where(~F.col("any")).drop("any")
    parts = ((v1.where(structural), "structural_v1"), (v2, "reference_v2"), (old, "reference_v1"), (guidance, "guidance_refs"))
    frames = [df.withColumn("origin", F.lit(name)) for df, name in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_kept(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, from an aggregate that starts before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("_r")).select(*key, order, "_r.*") if rest else rows.groupBy(*key).agg(F.min(order).alias(order))


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values with their counts; ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def best_variant(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of each group's representations (top_count, node_count, reference_count, byte_count) the one of the highest score, then counts."""
    score = F.col("top_count") * 1_000_000 + F.col("node_count") * 1000 + F.least("reference_count", F.lit(10_000)) * 10
    c = candidates.withColumn("score", score)
    rest = [x for x in c.columns if x not in by]
    return c.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("score", "top_count", "node_count", "reference_count", "byte_count")).alias("r")).select(*by, "r.*")


def canonical_variant(latest: Column, original: Column, expected: Column, share: float = 0.6) -> Column:
    """'latest' unless it has under ``share`` of the expected provisions and the original has more; else 'original'; null without both."""
    poor = latest < F.greatest(F.lit(1), F.floor(expected * share))
    return F.when(latest.isNull(), F.when(original.isNotNull(), "original")).when(poor & (original > latest), "original").otherwise("latest")


def missing_instruments(citations: DataFrame, held: DataFrame, top: int) -> DataFrame:
    """document_id and citations of the most cited instruments that aren't held; drafts and non-numeric numbers don't count. citations: url, citations."""
    from corpusmill.functions import constants as C

    part = lambda i: F.regexp_extract("url", C.LEGISLATION_URL, i)
    c = citations.where(F.col("url").rlike(C.LEGISLATION_URL) & (F.lower(part(1)) != "ukdsi"))
    c = c.groupBy(F.concat_ws("_", F.upper(part(1)), part(2), part(3)).alias("document_id")).agg(F.sum("citations").alias("citations"))
    return c.join(held.select("document_id").distinct(), "document_id", "left_anti").orderBy(F.desc("citations"), "document_id").limit(top)


def inherited(new: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    """New chunks with their document's least old values; no_metadata marks those whose document wasn't there."""
    o = old.groupBy("document_id").agg(*(F.min(c).alias(c) for c in columns), F.lit(True).alias("_there"))
    return new.drop(*columns).join(o, "document_id", "left").withColumn("no_metadata", F.col("_there").isNull()).drop("_there")


def rebuilt_sources(chunks: DataFrame, sep: str = "\n\n") -> DataFrame:
    """document_id and text: a document's active chunks in order, for chunking anew."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_ordinal", "chunk_id", "text")))
    return active(chunks).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), sep).alias("text"))


def node_report(nodes: DataFrame) -> DataFrame:
    """node_type, nodes, numbered, with_text, max_depth by type."""
    some = lambda c: F.sum(F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0))
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"), some("number").alias("numbered"), some("text").alias("with_text"), F.max("depth").alias("max_depth"))


def full_text(nodes: DataFrame, expected: str) -> DataFrame:
    """document_id and text: top provisions with their text under their label, parts, chapters and schedules as headings, in order."""
    kind, number, heading = F.col("node_type"), F.coalesce("number", F.lit("")), F.coalesce("heading", F.lit(""))
    top = kind == expected
    label = F.concat(F.when(top, F.initcap(kind)).otherwise(F.upper(kind)), F.when(number != "", F.concat(F.lit(" "), number)).otherwise(""), F.when(heading != "", F.concat(F.lit(" — "), heading)).otherwise(""))
    lines = F.concat(label, F.lit("\n"), F.when(top, F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))).otherwise(""))
    n = nodes.where(kind.isin("part", "chapter", "schedule", expected)).select("document_id", "ordinal", "node_id", lines.alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "line")))
    return n.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


_ACCEPTED = ("MATCHED", "FUZZY_MATCHED")
_ITEM = "array<struct<acceptable_chunk_ids:array<string>,resolution:struct<status:string,chunk_id:string>>>"
#: Gold records as read from JSON lines.
GOLD_SCHEMA = f"scenario_id string, requirements array<struct<requirement_id:string,mandatory:boolean,required_evidence_roles:array<string>,essential_evidence:{_ITEM},strong_supporting_evidence:{_ITEM},wrong_regime_evidence:{_ITEM}>>"


def _evidence(gold: DataFrame, bucket: str) -> DataFrame:
    r = gold.select("scenario_id", F.explode("requirements").alias("r")).select("scenario_id", "r.requirement_id", "r.mandatory", F.col("r.required_evidence_roles").alias("roles"), F.explode(f"r.{bucket}").alias("e"))
    return r.withColumn("accepted", F.coalesce(F.col("e.resolution.status").isin(*_ACCEPTED), F.lit(False)))


def gold_targets(gold: DataFrame) -> DataFrame:
    """scenario_id, requirement_id, chunk_id, roles: targets of requirements that aren't optional, with acceptable ones, of matched evidence only."""
    e = _evidence(gold, "essential_evidence").where("accepted AND coalesce(mandatory, true)")
    ids = F.array_distinct(F.array_compact(F.concat(F.array("e.resolution.chunk_id"), F.coalesce("e.acceptable_chunk_ids", F.array().cast("array<string>")))))
    return e.select("scenario_id", "requirement_id", F.explode(ids).alias("chunk_id"), "roles").where("chunk_id <> ''").dropDuplicates(["scenario_id", "requirement_id", "chunk_id"])


def essential_targets(gold: DataFrame) -> DataFrame:
    """scenario_id, requirement_id, chunk_id of matched essential evidence, optional requirements too."""
    return _evidence(gold, "essential_evidence").where("accepted AND e.resolution.chunk_id <> ''").select("scenario_id", "requirement_id", F.col("e.resolution.chunk_id").alias("chunk_id")).distinct()


def gold_chunks(gold: DataFrame, buckets: tuple[str, ...] = ("essential_evidence", "strong_supporting_evidence")) -> DataFrame:
    """scenario_id, chunk_id of matched evidence in any of the buckets."""
    parts = [_evidence(gold, b).where("accepted AND e.resolution.chunk_id <> ''").select("scenario_id", F.col("e.resolution.chunk_id").alias("chunk_id")) for b in buckets]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def wrong_regime_chunks(gold: DataFrame) -> DataFrame:
    """scenario_id, chunk_id of wrong-regime evidence, by resolution or as acceptable, whatever its status."""
    ids = F.array_compact(F.concat(F.array("e.resolution.chunk_id"), F.coalesce("e.acceptable_chunk_ids", F.array().cast("array<string>"))))
    return _evidence(gold, "wrong_regime_evidence").select("scenario_id", F.explode(ids).alias("chunk_id")).distinct()


def scenarios_of(scenarios: DataFrame, split: str = "ALL") -> DataFrame:
    return scenarios if split == "ALL" else scenarios.where(F.lower("split") == split.lower())


def reranker_scores(outputs: DataFrame) -> DataFrame:
    """scenario_id, lane, chunk_id, ce_score, ce_rank of a reranker's nested output (scenarios with a list for each lane)."""
    s = outputs.select(F.explode("scenarios").alias("s"))
    lanes = [s.select("s.scenario_id", F.lit(lane).alias("lane"), F.explode(f"s.{lane}_lane_top75").alias("c")) for lane in ("legislation", "other")]
    return lanes[0].union(lanes[1]).select("scenario_id", "lane", "c.chunk_id", "c.ce_score", F.col("c.rerank_position").alias("ce_rank"))


def split_scenarios(scenarios: DataFrame, seed: int = 20260920) -> DataFrame:
    """scenario_id and split: in each suite and regime half go to dev and half to test by a seeded hash; odd groups give the extra row to dev and test in turn."""
    s = scenarios.select("scenario_id", "suite", "regime")
    groups = s.groupBy("suite", "regime").agg(F.count("*").alias("n"))
    odd = groups.withColumn("turn", F.row_number().over(Window.orderBy("suite", "regime")))  # over a row a group
    w = Window.partitionBy("suite", "regime").orderBy(F.xxhash64("scenario_id", F.lit(seed)), "scenario_id")
    take = F.floor((F.col("n") + F.col("turn") % 2) / 2)
    return s.withColumn("r", F.row_number().over(w)).join(F.broadcast(odd), ["suite", "regime"]).select("scenario_id", F.when(F.col("r") <= take, "dev").otherwise("test").alias("split"))


def judge_summary(judged: DataFrame, dimensions: list[str], top: int = 15) -> tuple[DataFrame, DataFrame]:
    """Means of the dimensions and share of harmful chunks by kind and in all; and the commonest issues (lower case, 80 characters)."""
    means = [F.round(F.avg(d), 4).alias(d) for d in dimensions]
    by = judged.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), *means, F.round(100 * F.avg(F.col("harmful").cast("int")), 4).alias("harmful_pct"))
    issues = judged.select(F.explode("issues").alias("i")).select(F.substring(F.lower("i"), 1, 80).alias("issue"))
    return by, most_common(issues, "issue", top)


def parts_of_url(rows: DataFrame) -> DataFrame:
    return rows.select("*", U.url_host(F.col("url")).alias("host"), U.url_path(F.col("url")).alias("path"))
