"""Chunk quality: defects that are wrong for retrieval, advisories that only describe, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as T


def assessed(chunks: DataFrame, by: list[str], metadata: bool = True) -> DataFrame:
    """Adds est_tokens, in_target_band, defects and advisories to chunks (text, chunk_ordinal and, with ``metadata``, retrieval_title, retrieval_summary, topics, legal_concepts).

    A sentence is severed if this chunk ends without a stop and the next of the segment goes on in lower case.
    """
    t = T.stripped(F.coalesce("text", F.lit("")))
    head = T.stripped(F.coalesce(F.lead("text").over(Window.partitionBy(*by).orderBy("chunk_ordinal")), F.lit("")))
    c = chunks.withColumns({"_t": t, "_next": head}).withColumn("est_tokens", T.est_tokens(F.col("_t")))
    t, head, n = F.col("_t"), F.col("_next"), F.col("est_tokens")
    some = t != ""
    last = F.right(t, F.lit(1))
    open_end = some & ~t.rlike(C.SENTENCE_END) & ~last.isin(";", ",")
    resumed = head.rlike(r"^\p{Ll}") & ~head.rlike(C.LIST_START)
    defects = [
        (~some, "EMPTY_TEXT"), (open_end & resumed, "SEVERED_SENTENCE"), (some & F.right(t, F.lit(40)).rlike(C.DANGLING), "SEVERED_ENUMERATION"), (last == ":", "SEVERED_LIST_STEM"),
        (some & t.rlike(C.LIST_START) & (F.col("chunk_ordinal") > 1), "ORPHAN_LIST_ITEM"), (some & (n < C.TOO_SMALL_TOKENS), "TOO_SMALL_TO_RETRIEVE"),
    ]
    advisories = [(open_end & ~resumed, "UNTERMINATED_TAIL"), (some & n.between(C.TOO_SMALL_TOKENS, C.PREFERRED_MIN_TOKENS - 1), "BELOW_PREFERRED_BAND"), (some & (n > C.HARD_MAX_TOKENS), "ABOVE_PREFERRED_BAND")]
    if metadata:
        title, summary = (T.stripped(F.coalesce(x, F.lit(""))) for x in ("retrieval_title", "retrieval_summary"))
        none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
        defects += [(title == "", "NO_TITLE"), (summary == "", "NO_SUMMARY")]
        advisories += [(none("topics"), "NO_TOPICS"), (none("legal_concepts"), "NO_LEGAL_CONCEPTS"), ((summary != "") & some & (T.grounding(summary, t) < C.LOW_GROUNDING), "SUMMARY_LOW_GROUNDING")]
    flags = lambda rules: F.array_compact(F.array(*(F.when(cond, name) for cond, name in rules)))
    return c.withColumns({"in_target_band": n.between(C.PREFERRED_MIN_TOKENS, C.PREFERRED_MAX_TOKENS), "defects": flags(defects), "advisories": flags(advisories)}).drop("_t", "_next")


def report(assessed_chunks: DataFrame) -> DataFrame:
    """One row of totals over assessed chunks."""
    n = F.size("defects")
    return assessed_chunks.agg(
        F.count("*").alias("chunks"), F.round(100 * F.avg(F.when(n == 0, 1).otherwise(0)), 4).alias("clean_pct"), F.round(F.avg(n), 6).alias("defects_per_chunk"), F.round(F.avg("est_tokens"), 6).alias("mean_tokens"),
        F.round(100 * F.avg(F.col("in_target_band").cast("int")), 4).alias("in_band_pct"), F.max("est_tokens").alias("max_tokens"), F.percentile("est_tokens", 0.5).alias("median_tokens"),
    )


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, before, after and change of two one-row reports."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns))).alias("x")).select("x.*")

    return long(a, "before").join(long(b, "after"), "metric").withColumn("change", F.col("after") - F.col("before"))


def label_union(structural: DataFrame, judged: DataFrame) -> DataFrame:
    """chunk_id with the union of both flag lists, without flags that end in a number in brackets."""
    both = structural.join(judged.withColumnRenamed("flags", "judged_flags"), "chunk_id", "full")
    empty = F.array().cast("array<string>")
    union = F.array_union(F.coalesce("flags", empty), F.coalesce("judged_flags", empty))
    return both.select("chunk_id", F.filter(union, lambda f: ~f.rlike(r"\(\d+\)$")).alias("flags"))


def droppable(chunks: DataFrame, *guards: DataFrame) -> DataFrame:
    """chunks without those whose chunk_id a guard names (gold, judged, cited)."""
    for g in guards:
        chunks = chunks.join(g.select("chunk_id"), "chunk_id", "left_anti")
    return chunks
