"""Segmentation: ordered folds that fill chunks, windows, and checks of boundary plans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_groups(sizes: Column, limit: int, close_at: bool = False) -> Column:
    """For each size in order, the number (from 0) of the group it falls into.

    A group is closed when one more would exceed ``limit`` or, with ``close_at``, as soon as it has reached it.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        fresh = (acc["g"] < 0) | (acc["sum"] >= limit if close_at else acc["sum"] + size > limit)
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(fresh, size).otherwise(acc["sum"] + size).cast("bigint").alias("sum"), g.alias("g"), F.array_append(acc["out"], g).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def chunked(segments: DataFrame, blocks: str, target: int, sep: str = "\n") -> DataFrame:
    """Rows of segments with chunk_ordinal, text and n_blocks: blocks are taken until their characters reach ``target``."""
    numbered = segments.withColumn("_g", greedy_groups(F.transform(blocks, lambda b: F.length(b)), target, close_at=True))
    paired = F.explode(F.sequence(F.lit(0), F.array_max("_g")))
    rows = numbered.where(F.size(blocks) > 0).withColumn("_k", paired)
    mine = F.filter(blocks, lambda b, i: F.get("_g", i) == F.col("_k"))
    return rows.select(*(c for c in segments.columns if c != blocks), (F.col("_k") + 1).alias("chunk_ordinal"), F.array_join(mine, sep).alias("text"), F.size(mine).alias("n_blocks"))


def plan_is_valid(block_ids: Column, plan: Column) -> Column:
    """Whether the ranges (start, end of block ids) cover every block exactly once, in order."""
    covered = F.flatten(F.transform(plan, lambda p: F.when((F.array_position(block_ids, p["start"]) > 0) & (F.array_position(block_ids, p["end"]) >= F.array_position(block_ids, p["start"])), F.slice(block_ids, F.array_position(block_ids, p["start"]).cast("int"), (F.array_position(block_ids, p["end"]) - F.array_position(block_ids, p["start"]) + 1).cast("int"))).otherwise(F.array().cast("array<string>"))))
    return covered == block_ids


def placeholders_conserved(source: Column, chunks: Column) -> Column:
    """Whether both arrays hold the same placeholders as often."""
    return F.array_sort(source) == F.array_sort(chunks)


def cut_windows(text: str, marks: list[int], target: int, hard_max: int) -> list[str]:
    """Cuts at provision marks where one lies within ``hard_max``: the last that makes a window of ``target`` or more, else the last at all.

    Without a mark in reach the cut falls on the last blank line past half the target, or at the limit. Windows of white space are left out.
    """
    marks = sorted({*marks, len(text)})
    out, start = [], 0
    while start < len(text):
        reach = [m for m in marks if start < m <= start + hard_max]
        if reach:
            full = [m for m in reach if m - start >= target]
            end = (full or reach)[-1]
        else:
            blank = text.rfind("\n\n", start, start + hard_max)
            end = blank if blank - start > target // 2 else min(start + hard_max, len(text))
        if text[start:end].strip():
            out.append(text[start:end])
        start = end
    return out


#: Where provisions begin: numbered sections, regulations, schedules and parts at a line's start.
PROVISION = r"(?m)^(?:\d+[A-Z]?\.?\s|(?:section|regulation|schedule|part)\s+\d+)"


def windows(rows: DataFrame, target: int, pattern: str = PROVISION, factor: float = 1.6) -> DataFrame:
    """doc_id, window (from 1) and text of every document's windows."""
    found = re.compile(pattern, re.I)

    def run(batches):
        for b in batches:
            cut = [(d, i, w) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, w in enumerate(cut_windows(t or "", [m.start() for m in found.finditer(t or "")], target, int(target * factor)), 1)]
            yield pd.DataFrame(cut, columns=["doc_id", "window", "text"])

    return rows.select("doc_id", "text").mapInPandas(run, "doc_id long, window int, text string")


def exclusive_text(text: Column, children: Column) -> Column:
    """The text without the first occurrence of each child's text, in order; nothing if there are children and none was found."""
    start = F.struct(text.alias("t"), F.lit(False).alias("any"))

    def step(acc: Column, child: Column) -> Column:
        at = F.instr(acc["t"], child)
        hit = (F.length(child) > 0) & (at > 0)
        rest = F.concat(F.substring(acc["t"], F.lit(1), at - 1), F.substring(acc["t"], at + F.length(child), F.length(acc["t"])))
        return F.struct(F.when(hit, rest).otherwise(acc["t"]).alias("t"), (acc["any"] | hit).alias("any"))

    done = F.aggregate(children, start, step)
    return F.when((F.size(children) > 0) & ~done["any"], "").otherwise(done["t"])


def broken_groups(blocks: Column, limit: int, breaks: Column, share: int) -> Column:
    """The number (from 0) of each block's group, for structs (size, head) in order.

    A group closes when one more would exceed ``limit``, or, once it has ``limit`` / ``share``, where ``breaks`` (an array of booleans, one a block) says so.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("g"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    pairs = F.arrays_zip(blocks.alias("size"), breaks.alias("cut"))

    def step(acc: Column, b: Column) -> Column:
        fresh = (acc["n"] > 0) & ((b["cut"] & (acc["sum"] >= limit // share)) | (acc["sum"] + b["size"] > limit))
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(fresh, b["size"]).otherwise(acc["sum"] + b["size"]).cast("bigint").alias("sum"), g.alias("g"), (acc["n"] + 1).alias("n"), F.array_append(acc["out"], g).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _segments(docs: DataFrame, groups: Column) -> DataFrame:
    """document_id, segment_ordinal, segment_id, blocks of each group of docs (document_id, blocks), blocks numbered anew."""
    n = docs.withColumn("_g", groups).where(F.size("blocks") > 0)
    rows = n.select("document_id", F.posexplode(F.arrays_zip("blocks", "_g")).alias("p", "x")).groupBy("document_id", F.col("x._g").alias("g")).agg(F.array_sort(F.collect_list(F.struct("p", F.col("x.blocks").alias("b")))).alias("bs"))
    named = F.transform("bs", lambda b, i: b["b"].withField("original_block_id", b["b"]["block_id"]).withField("block_id", F.format_string("B%04d", i + 1)))
    return rows.select("document_id", (F.col("g") + 1).alias("segment_ordinal"), F.concat("document_id", F.lit("__SEG_"), F.lpad((F.col("g") + 1).cast("string"), 4, "0")).alias("segment_id"), named.alias("blocks"))


def grouped_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """Segments of blocks (block_id, block_type, heading_level, text) up to ``limit`` characters; a heading of the first two levels begins one that has a third of it."""
    sizes = F.transform("blocks", lambda b: F.length(F.coalesce(b["text"], F.lit(""))))
    major = F.transform("blocks", lambda b: F.coalesce(b["block_type"].isin("h1", "h2", "heading") & (F.coalesce(b["heading_level"], F.lit(2)) <= 2), F.lit(False)))
    return _segments(docs, broken_groups(sizes, limit, major, 3))


def headed_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """Segments of blocks (block_id, heading_path, text): a change in the first two headings begins one that has a quarter of ``limit``; blank blocks are left out."""
    d = docs.withColumn("blocks", F.filter("blocks", lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
    sizes = F.transform("blocks", lambda b: F.length(b["text"]))
    head = lambda b: F.slice(F.coalesce(b["heading_path"], F.array().cast("array<string>")), 1, 2)
    changed = F.transform("blocks", lambda b, i: (i > 0) & (head(b) != head(F.get("blocks", i - 1))))
    return _segments(d, broken_groups(sizes, limit, F.transform(changed, lambda c: F.coalesce(c, F.lit(False))), 4))


def page_blocks(docs: DataFrame) -> DataFrame:
    """document_id and blocks of pre-extracted PDF pages (document_id, page_number, text): a page is a block."""
    b = F.struct(F.col("page_number").alias("page_number"), F.format_string("P%04d", "page_number").alias("block_id"), F.lit("pdf_page").alias("block_type"), F.lit(None).cast("int").alias("heading_level"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("document_id").agg(F.array_sort(F.collect_list(b)).alias("blocks"))


def text_blocks(text: Column) -> Column:
    """Blocks of plain text: parts between blank lines; those that begin with # are headings of that level."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t\r\f\x0B]+", " "), r"^\s+|\s+$", "")), lambda p: p != "")

    def block(p: Column, i: Column) -> Column:
        mark = F.regexp_extract(p, r"^(#{1,6})\s+", 1)
        return F.struct(F.format_string("B%04d", i + 1).alias("block_id"), F.when(mark != "", "heading").otherwise("paragraph").alias("block_type"), F.when(mark != "", F.length(mark)).alias("heading_level"), F.when(mark != "", F.regexp_replace(p, r"^#{1,6}\s+", "")).otherwise(p).alias("text"))

    return F.transform(parts, block)


def fallback_plan(blocks: Column, title: Column) -> Column:
    """A plan of one chunk over all blocks."""
    return F.array(F.struct(F.element_at(blocks, 1)["block_id"].alias("start"), F.element_at(blocks, -1)["block_id"].alias("end"), title.alias("title")))


def materialised(segments: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and a status a segment, of segments (segment_id, segment_sha256, blocks of block_id and text) and plans (segment_id, segment_sha256, plan of start and end).

    Statuses: MISSING_BOUNDARIES, INPUT_HASH_MISMATCH, INVALID_BOUNDARIES, PLACEHOLDER_MISMATCH or PASS; the first three give no chunks.
    """
    ids = F.transform("blocks", lambda b: b["block_id"])
    j = segments.join(plans.select("segment_id", F.col("segment_sha256").alias("_hash"), "plan"), "segment_id", "left").withColumn("_ids", ids)
    early = F.when(F.col("plan").isNull(), "MISSING_BOUNDARIES").when(~F.col("_hash").eqNullSafe(F.col("segment_sha256")), "INPUT_HASH_MISMATCH").when((F.size("plan") == 0) | ~plan_is_valid(F.col("_ids"), F.col("plan")), "INVALID_BOUNDARIES")
    place = lambda x: F.array_position(F.col("_ids"), x).cast("int")
    texts = F.transform("plan", lambda p: F.trim(F.array_join(F.transform(F.slice("blocks", place(p["start"]), place(p["end"]) - place(p["start"]) + 1), lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")))
    j = j.withColumn("status", early).withColumn("texts", F.when(F.col("status").isNull(), texts))
    marks = lambda c: F.flatten(F.transform(c, lambda t: F.regexp_extract_all(t, F.lit(r"(\[\[LINK_\d{4,}\]\])"), F.lit(1))))
    kept = placeholders_conserved(marks(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit("")))), marks(F.col("texts")))
    j = j.withColumn("status", F.coalesce("status", F.when(kept, "PASS").otherwise("PLACEHOLDER_MISMATCH")))
    chunks = j.where("texts IS NOT NULL").select("segment_id", F.posexplode("texts").alias("p", "text"))
    return chunks.select("segment_id", (F.col("p") + 1).alias("chunk_ordinal"), F.concat("segment_id", F.lit("__CH_"), F.lpad((F.col("p") + 1).cast("string"), 3, "0")).alias("chunk_id"), "text", F.sha2("text", 256).alias("content_sha256")), j.select("segment_id", "status")


def provision_nodes(nodes: DataFrame) -> DataFrame:
    """Sections, regulations and schedules without any of these below them, one row a parent id (the first by ordinal), blank ones left out.

    nodes: parent_node_id (the provision's own id), node_type, ordinal, text. Whether a schedule has provisions is found by its ids' ancestors, not by comparing prefixes.
    """
    from corpusmill.functions import text as T
    from corpusmill.operators.index import first_kept

    units = nodes.where(F.col("node_type").isin("section", "regulation"))
    owners = units.select(F.explode(T.ancestors(F.col("parent_node_id"))).alias("parent_node_id")).distinct()
    lone = nodes.where(F.col("node_type") == "schedule").join(owners, "parent_node_id", "left_anti").select(*nodes.columns)
    return first_kept(units.unionByName(lone).where(F.trim(F.coalesce("text", F.lit(""))) != ""), ["parent_node_id"], "ordinal")


def numbered_provisions(nodes: DataFrame) -> DataFrame:
    """node_id, number, text of top containers whose text is a heading, a number with a stop and a numbered body; others are left out."""
    found = r"(?s)^(.*?)\s*(\d+[A-Z]?)\.\s*(\(?\d.*)$"
    return nodes.where(F.trim("text").rlike(found)).select("node_id", F.regexp_extract(F.trim("text"), found, 2).alias("number"), F.trim("text").alias("text"))


def top_provisions(nodes: DataFrame) -> DataFrame:
    """Numbered nodes that are provisions by type or by id, no cross-headings."""
    by_id = F.col("node_id").rlike(r"__(section|regulation|schedule)-[0-9]+[A-Za-z]?$")
    return nodes.where((F.coalesce("number", F.lit("")) != "") & ~F.col("node_id").contains("crossheading") & (F.col("node_type").isin("section", "regulation", "schedule") | by_id))


def legal_segments(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """segment_id, node_id and blocks of each top provision: its own and its descendants' exclusive texts in reading order.

    nodes: document_id, node_id, parent_node_id, node_type, number, ordinal, text. A tree is walked level by level, each an equality join.
    """
    children = nodes.groupBy(F.col("parent_node_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("node_id").alias("id"), "text"))).alias("kids"))
    own = exclusive_text(F.coalesce("text", F.lit("")), F.coalesce(F.transform("kids", lambda k: F.coalesce(k["text"], F.lit(""))), F.array().cast("array<string>")))
    texts = nodes.join(children, "node_id", "left").select("node_id", "parent_node_id", "ordinal", F.regexp_replace(F.trim(own), r"[ \t]+", " ").alias("own"))
    level = top_provisions(nodes).select("document_id", F.col("node_id").alias("top"), F.col("ordinal").alias("top_ordinal"), "node_id", F.array(F.lit(0).cast("bigint")).alias("path"))
    found = level
    for _ in range(most_depth):
        below = texts.select(F.col("node_id").alias("child"), F.col("parent_node_id").alias("node_id"), "ordinal")
        level = level.join(below, "node_id").select("document_id", "top", "top_ordinal", F.col("child").alias("node_id"), F.concat("path", F.array(F.col("ordinal").cast("bigint"))).alias("path"))
        if not level.limit(1).count():
            break
        found = found.union(level)
    blocks = found.join(texts.select("node_id", "own"), "node_id").where("own <> ''")
    seg = blocks.groupBy("document_id", "top", "top_ordinal").agg(F.array_sort(F.collect_list(F.struct("path", F.col("node_id").alias("source_node_id"), F.col("own").alias("text")))).alias("b"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("document_id").orderBy("top_ordinal", "top"))
    named = F.transform("b", lambda x, i: F.struct(F.format_string("B%04d", i + 1).alias("block_id"), x["source_node_id"].alias("source_node_id"), x["text"].alias("text")))
    return seg.select("document_id", F.concat("document_id", F.lit("__SEG_"), F.lpad(number.cast("string"), 4, "0")).alias("segment_id"), F.col("top").alias("node_id"), named.alias("blocks"))
