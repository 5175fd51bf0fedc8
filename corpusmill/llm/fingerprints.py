"""Bottom-k sketches of shingle hashes, in built-in expressions only.

A text is its set of word shingles, a sketch the k least hashes of that set. Sketches of
parts merge to the sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles. A sketch that holds fewer than k hashes is the whole set, and what it gives is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles in the order of the text, in lower case, words parted by spaces and the controls 9 to 13.

    Fewer words than a shingle make one shingle; null and wordless texts have none.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def all_shingles(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    # a transform over an array of one element binds the word hashes to a variable, so that they are worked out once
    return F.element_at(F.transform(F.array(hashed), lambda h: F.when(F.size(h) > 0, all_shingles(h)).otherwise(F.array().cast("array<bigint>"))), 1)


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    of = F.least(F.lit(k), F.size(F.array_union(a, b)))
    return F.when(of == 0, 1.0).otherwise(both / of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    reach = (F.element_at(a, F.size(a)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)))


def encoded(a: Column) -> Column:
    """16 hexadecimal digits a hash, without separators."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def decoded(text: Column) -> Column:
    """The sketch that ``encoded`` wrote."""
    digits = F.regexp_extract_all(text, F.lit("([0-9a-f]{16})"), F.lit(1))
    return F.transform(digits, lambda d: F.conv(d, 16, -10).cast("bigint"))


def with_next(documents: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with next_<column> of the row that follows in ascending doc_id; the first follows the last.

    Rows are dealt out by ranges of doc_id, each range with a copy of the row that begins the next, so
    that every task finds all successors itself and none gets all rows. A null doc_id comes last, equal
    ones in order of their text's hash; a single row follows itself.
    """
    spark = documents.sparkSession
    ranges = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # several a task, so that tasks are alike
    order = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    rows = documents.withColumn("_order", order)
    ids = documents.select(order.alias("_order"))
    cuts = sorted(set(ids.select(F.percentile_approx("_order", [i / ranges for i in range(1, ranges)] or [1.0], 10_000).alias("q")).first()["q"] or []))
    array = F.array(*(F.lit(c).cast("bigint") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))))
    # binary search: the number of cuts up to the row's place
    range_of = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(array, low + step - 1) <= F.col("_order"), F.lit(False)), low + step).otherwise(low))
    first = {r["_range"]: r["f"] for r in ids.withColumn("_range", range_of).groupBy("_range").agg(F.min("_order").alias("f")).collect()}
    held = sorted(first)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    firsts = F.array(*(F.lit(first.get(r)).cast("bigint") for r in range(len(cuts) + 1)))
    befores = F.array(*(F.lit(before.get(r)).cast("int") for r in range(len(cuts) + 1)))

    def place(r: Column, around: Column, copy: bool) -> Column:
        return F.struct(r.alias("_range"), around.alias("_around"), F.lit(copy).alias("_copy"))

    rows = rows.withColumn("_range", range_of)
    begins = F.get(firsts, F.col("_range")) == F.col("_order")
    own = F.array(place(F.col("_range"), F.lit(False), False))
    around = F.col("_range") == (held[0] if held else 0)
    places = F.when(begins, F.concat(own, F.array(place(F.get(befores, F.col("_range")), around, True)))).otherwise(own)
    w = Window.partitionBy("_range").orderBy("_around", "_order", F.xxhash64("text"), "text")
    placed = rows.withColumn("_p", F.explode(places)).drop("_range").select("*", "_p.*").drop("_p")
    return placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col("_copy")).drop("_order", "_range", "_around", "_copy")


def fingerprints(documents: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has the last half (rounded down) of its code points replaced by the first as many of the
    next document, or all it has. A null text counts as empty; empty texts have the empty fingerprint
    and resemble each other fully. Other columns are left out, an empty table gives none; nulls and repeats of
    doc_id as in ``with_next``.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(shingle_hashes(F.col("text"), words), k))
    rows = with_next(own, ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))")
    rows = rows.withColumn("edited", edited).withColumns({"edited_sketch": sketch(shingle_hashes(F.col("edited"), words), k), "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("sketch")).alias("fingerprint"), encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
