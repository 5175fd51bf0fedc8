"""N-gram Jaccard join by grouped prefixes.

A document is its set of word shingles, hashed to 64 bits. All sets are sorted in one
global order; two sets whose Jaccard similarity reaches the threshold share a shingle
among their first few (the prefix), whatever the order is. The order puts shingles that
lie in very many documents last, and else long shingles first, as these are rarer; it only
affects speed. Documents of equal text form a class, classes of equal size and prefix a group.

Shingles that occur in exactly the same groups share one posting list.

First round: within each posting list, and each band of sizes,
groups are compared with one pivot only, and members of a group with its first member.
Second round: pairs of groups that share a list but lie in different components pass filters on sizes, on the list's
places and on parity bitmaps, which bound the overlap from above; each pair found then is
expanded to the members that lie apart, whose larger bitmaps are compared before texts are read and
similarities are verified. So no link between components is lost, and a large group of
near copies costs as many comparisons as it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, hand_over, hot_keys, map_slices, salted_join
from corpusmill.llm.components import components

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SEEDS = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_POWERS = np.multiply.accumulate(np.full(4096, _BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
BITMAP_BITS = 1024
_NOBODY = -(1 << 63)  # stands for a null doc_id, so that keys are plain columns


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _SEEDS[0]
    x = (x ^ (x >> np.uint64(27))) * _SEEDS[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes in ascending order, and their lengths in bytes.

    Words are what lies between spaces and the controls 9 to 13, with A-Z in lower case. A text of fewer words than
    a shingle is one shingle; without words the set is empty.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    opens = np.zeros(len(data), np.int64)
    opens[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(opens)
    power = _POWERS[place] if place.max(initial=0) < len(_POWERS) else np.multiply.accumulate(np.full(place.max() + 1, _BASE))[place]
    value = (data.astype(np.uint64) + np.uint64(1)) * power
    value[gap] = 0
    word = _mixed(np.add.reduceat(value, start) + size.astype(np.uint64) * _SEEDS[2])
    width = min(words, len(word))
    mix, length = np.zeros(len(word) - width + 1, np.uint64), np.zeros(len(word) - width + 1, np.int64)
    for k in range(width):
        mix = _mixed(mix + word[k : len(word) - width + 1 + k] + _SEEDS[k % 3])
        length += size[k : len(word) - width + 1 + k]
    found, first = np.unique(mix, return_index=True)
    return found, length[first]


def prefix_size(n: int | np.ndarray, percent: int):
    """So many shingles, in any order, that two similar sets of n and more can't miss each other there."""
    return n - (n * percent + 99) // 100 + 1


def bitmap_bits(n: int | np.ndarray):
    """Bits of a set's parity bitmap: a power of two, at least BITMAP_BITS, and n or more, so that large sets' bitmaps tell as much."""
    return np.maximum(BITMAP_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _bitmap(found: np.ndarray) -> np.ndarray:
    size = int(bitmap_bits(len(found)))
    parity = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def common_shingles(documents: DataFrame, words: int, most: int, least: int = 32) -> np.ndarray:
    """The ``most`` shingles of most documents, rarest first, as far as they lie in ``least`` or more.

    Each task counts its own, half a million at a time, keeps those that came twice there, and passes on those that it met
    four times or more. This list steers the
    order of shingles, so that its bound affects speed, never results.
    """

    def counted(batches):
        hand_over(__name__)
        seen: list[np.ndarray] = []
        held, parts = 0, []

        def settle() -> None:
            keys, counts = np.unique(np.concatenate(seen), return_counts=True)
            parts.append((keys[counts > 1], counts[counts > 1]))

        for batch in batches:
            for text in batch.column(0):
                found, _ = shingle_set(text.as_py(), words)
                seen.append(found)
                held += len(found)
                if held > 500_000:
                    settle()
                    seen, held = [], 0
        if seen:
            settle()
        if parts:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= 4].view(np.int64)), pa.array(counts[counts >= 4])], ["shingle", "n"])
        seen = parts = keys = counts = at = None
        hand_over(__name__)

    found = documents.select("text").mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = found.orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    return np.ascontiguousarray(rows.column("shingle").to_numpy()[::-1]).view(np.uint64)


def _sets(documents: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """rid, doc_id, key, n, prefix, bits of each row."""
    order = np.argsort(common)
    shared = documents.sparkSession.sparkContext.broadcast((common[order], order))

    def make():
        keys, rank = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, prefixes, bits = [], [], []
            for text in batch.column(2).to_pylist():
                found, length = shingle_set(text, words)
                weight = np.zeros(len(found), np.int64)
                if len(keys) and len(found):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    weight = np.where(keys[at] == found, rank[at] + 1, 0)
                kept = found[np.lexsort((found, -length, weight))[: prefix_size(len(found), percent) if len(found) else 0]]
                n.append(len(found))
                prefixes.append(kept.view(np.int64))
                bits.append(_bitmap(found))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "key", "n", "prefix", "bits"])

        return work

    rows = map_slices(_keyed(documents), make, "doc_id long, key binary, n long, prefix array<long>, bits array<long>")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")


def _sizes_agree(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two parity bitmaps differ; the longer one, of twice the other's length at most, is folded to the shorter."""

    def folded(v: Column, to: Column) -> Column:
        half = F.size(v) / 2
        return F.when(F.size(v) > to, F.zip_with(F.slice(v, 1, half.cast("int")), F.slice(v, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))).otherwise(v)

    to = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, to), folded(y, to), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, v: s + v)


def _overlap_fits(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """The overlap is at most (n + m - differing bits) / 2; it has to reach percent / (100 + percent) of n + m."""
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


_FILTER_BITS, _FILTER_PART = 1 << 25, 32768


def _maybe_in(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, key, text of the rows whose key may be in ``keys``, by a bit set of fixed 4 MB; of repeated rows a task passes on few.

    It spares the join most texts; the more keys, the more rows pass it for nothing.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(_FILTER_BITS))
    parts = keys.select(place.alias("p")).groupBy((F.col("p") / _FILTER_PART).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("p") % _FILTER_PART)).alias("bits")).collect()
    held = np.zeros(_FILTER_BITS // 8, np.uint8)
    for r in parts:
        data = np.frombuffer(bytes(r["bits"]), np.uint8)
        held[r["part"] * _FILTER_PART // 8 :][: len(data)] = data
    shared = documents.sparkSession.sparkContext.broadcast(held)

    def make():
        seen: set[tuple] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = batch.column(3).to_numpy()
            there = np.flatnonzero((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)
            if len(seen) > 50_000:
                seen.clear()
            new = []
            for row in there:
                mark = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if mark not in seen:
                    seen.add(mark)
                    new.append(row)
            return batch.select([0, 1, 2]).take(pa.array(new, pa.int64()))

        return work

    return map_slices(_keyed(documents).withColumn("place", place), make, "doc_id long, key binary, text string")


def _verified(work: Workspace, name: str, pairs: DataFrame, classes: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that pass the filters and whose similarity reaches the threshold, written as table ``name``."""
    x, y = (classes.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "bits", "key", "doc_id"))) for s in "ab")
    fits = _sizes_agree(F.col("n_a"), F.col("n_b"), percent) & _overlap_fits(F.col("n_a"), F.col("n_b"), _differing_bits(F.col("bits_a"), F.col("bits_b")), percent)
    # pairs are about as many as classes at most; a class that is the pivot of a large list is dealt out
    hubs = work.keep(f"{name}_hubs", pairs.groupBy("b").agg(F.count("*").alias("rows")))
    hot = hot_keys(hubs, "b", "rows")
    sized = salted_join(pairs, y, "b", hot, by="a").join(x, "a").where(fits)
    sized = work.keep(f"{name}_sized", sized.select("a", "b", "key_a", "doc_id_a", "key_b", "doc_id_b"))
    texts = work.keep(f"{name}_texts", _maybe_in(documents, sized.select(F.col("key_a").alias("key")).union(sized.select(F.col("key_b").alias("key")))))
    for s, other in (("b", "a"), ("a", "b")):
        one = sized.select(s, F.col(f"key_{s}").alias("key"), F.coalesce(f"doc_id_{s}", F.lit(_NOBODY)).alias("at")).distinct()
        own = texts.withColumn("at", F.coalesce("doc_id", F.lit(_NOBODY))).join(one, ["key", "at"]).dropDuplicates([s]).select(s, F.col("text").alias(f"text_{s}"))
        sized = salted_join(sized, own, s, hot, by=other) if s == "b" else sized.join(own, s)

    def make():
        known: dict[str, np.ndarray] = {}

        def of(text: str | None) -> np.ndarray:
            if text not in known:
                if len(known) >= 8:
                    known.pop(next(iter(known)))
                known[text] = shingle_set(text, words)[0]
            return known[text]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = of(s), of(t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        return work

    found = work.keep(name, map_slices(sized.select("a", "b", "text_a", "text_b"), make, "a long, b long"))
    work.drop(f"{name}_hubs", f"{name}_sized", f"{name}_texts")
    return found


def _lists(work: Workspace, heads: DataFrame) -> tuple[DataFrame, list]:
    """list, gid, n, at of the posting lists of prefix shingles with two groups or more, and the hot lists.

    Shingles that occur in exactly the same groups, as those of a passage do, have one list; ``at`` is the least place of any of them.
    """
    postings = heads.select("gid", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = work.keep("shared", postings.groupBy("shingle").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("shingle", "rows"))
    hot = hot_keys(shared, "shingle", "rows")
    listed = work.keep("listed", salted_join(postings, shared.select("shingle"), "shingle", hot, by="gid"))
    same = listed.groupBy("shingle").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("gid").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("x"))
    kinds = work.keep("kinds", same)
    first = kinds.groupBy("rows", "s", "x").agg(F.min("shingle").alias("list"))
    named = work.keep("named", kinds.join(first, ["rows", "s", "x"]).select("shingle", "list", "rows"))
    lists = work.keep("lists", salted_join(listed, named.select("shingle", "list"), "shingle", hot, by="gid").groupBy("list", "gid").agg(F.first("n").alias("n"), F.min("at").alias("at")))
    hot = hot_keys(named.where("shingle = list"), "list", "rows")
    work.drop("shared", "listed", "kinds", "named")
    return lists, hot


def linked(documents: DataFrame, words: int = 5, percent: int = 80, most_common: int = 1 << 18) -> DataFrame:
    """A row for each row of documents: doc_id, key (MD5 of the text), n_shingles, component_id, keeper.

    component_id is the least doc_id in reach by links of Jaccard similarity ``percent`` / 100 or more
    between sets of ``words``-word shingles; keeper marks the rows of component_id whose text stands for
    its component. Texts without words (null, empty, white space) have n_shingles 0, are linked with nothing and
    are keepers. A null doc_id takes part, but isn't the least unless no other is there. Repeated rows and equal
    texts are linked. Very long texts are taken whole, one text's set at a time. Columns other than doc_id and text aren't read; an empty table gives none.
    """
    documents = documents.select("doc_id", "text")
    work = Workspace(documents.sparkSession, "jaccard")
    sets = work.keep("sets", _sets(documents, words, percent, common_shingles(documents, words, most_common)))
    group = F.unhex(F.md5(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>"))))
    texts = work.keep("texts", sets.where("n > 0").groupBy("key").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(group).alias("group_key")))
    groups = work.keep("groups", texts.groupBy("group_key").agg(F.min("cls").alias("gid"), F.count("*").alias("members")))
    named = salted_join(texts, groups, "group_key", hot_keys(groups, "group_key", "members"), by="cls")
    names = work.keep("names", named.select("cls", "key", "doc_id", "copies", "gid", "members"))
    classes = work.keep("classes", sets.select(F.col("rid").alias("cls"), "n", "bits").join(names, "cls"))
    heads = work.keep("heads", sets.select(F.col("rid").alias("gid"), "n", "prefix").join(groups.select("gid"), "gid"))
    rows = work.keep("rows", sets.select("rid", "doc_id", "key", "n"))
    work.drop("sets", "texts")
    lists, hot = _lists(work, heads)
    work.drop("heads", "groups")

    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)))
    banded = lists.withColumn("band", band)
    # a list's pivot is a member that has the shingle early, so has few of its own before it, and is like most others
    pivots = banded.groupBy("list", "band").agg(F.min_by("gid", "at").alias("pivot"), F.min("at").alias("pivot_at"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    near = (F.col("n") - F.greatest("at", "pivot_at")) * (100 + percent) >= 2 * percent * F.col("n")
    met = salted_join(banded, pivots, "list", hot, by="gid", on=("band",)).where((F.col("gid") != F.col("pivot")) & near).groupBy("gid", "pivot").agg(F.count("*").alias("shared"), F.min("pivot_at").alias("pivot_at"))
    # of the pivots that a group meets, two; what they don't link is left to the second round
    chosen = met.groupBy("gid").agg(F.array_distinct(F.array(F.min_by("pivot", "pivot_at"), F.max_by("pivot", "shared"))).alias("pivots"))
    stars = chosen.select(F.col("gid").alias("a"), F.explode("pivots").alias("b"))
    within = classes.where("cls <> gid").select(F.col("cls").alias("a"), F.col("gid").alias("b"))
    links = _verified(work, "links", stars.union(within), classes, documents, words, percent)
    joined = work.keep("joined", components(links))

    pairs = work.keep("pairs", _group_pairs(work, classes, joined, lists, hot, percent))
    both = [classes.select(F.col("gid").alias(f"gid_{s}"), F.col("cls").alias(s)).join(joined.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}")), s, "left") for s in "ab"]
    members = pairs.join(both[0], "gid_a").join(both[1], "gid_b").where((F.coalesce("component_a", "a") != F.coalesce("component_b", "b")) & ((F.col("gid_a") != F.col("gid_b")) | (F.col("a") < F.col("b"))))
    more = _verified(work, "more", members.select("a", "b"), classes, documents, words, percent)
    joined = work.keep("components", components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    work.drop("pairs", "lists", "links", "joined", "more")

    whole = work.keep("whole", names.join(joined, names["cls"] == joined["node"], "left").select("cls", "key", "doc_id", "copies", F.coalesce("component", "cls").alias("component")))
    least = work.keep("least", whole.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("keeper_key"), F.count("*").alias("rows")))
    final = salted_join(whole, least.drop("rows"), "component", hot_keys(least, "component", "rows"), by="cls").select("key", "component_id", (F.col("key") == F.col("keeper_key")).alias("kept_text"))
    empty = F.col("n") == 0
    found = salted_join(rows, final, "key", hot_keys(whole, "key", "copies"), by="rid", how="left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (empty | (F.col("kept_text") & F.col("doc_id").eqNullSafe(F.col("component_id")))).alias("keeper"),
    )
    found = work.keep("found", found)
    work.drop("classes", "names", "rows", "components", "whole", "least")
    return found


def _group_pairs(work: Workspace, classes: DataFrame, joined: DataFrame, lists: DataFrame, hot: list, percent: int) -> DataFrame:
    """Pairs (gid_a, gid_b) of groups in different components that share a list and may be similar; a group whose own members lie apart makes a pair with itself."""
    folds = BITMAP_BITS // 64
    # a bitmap folded to 512 bits, whatever its size
    folded = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.sequence(i, F.size("bits") - 1, F.lit(8)), F.lit(0).cast("bigint"), lambda x, j: x.bitwiseXOR(F.get("bits", j))))
    assert folds >= 8
    own = classes.join(joined, classes["cls"] == joined["node"], "left").select("gid", F.coalesce("component", "cls").alias("component"), F.when(F.col("members") == 1, folded).alias("f"))
    # only a group of one member has marks to compare; with more, all of them have to
    marks = work.keep("marks", own.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("f").alias("f")))
    placed = work.keep("placed", lists.join(marks, "gid"))
    across = work.keep("across", placed.groupBy("list").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("list"))
    rest = work.keep("rest", salted_join(placed, across, "list", hot, by="gid"))
    work.drop("placed", "across")
    x, y = rest.alias("x"), rest.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    differ = F.when(F.col("x.f").isNull() | F.col("y.f").isNull(), 0).otherwise(_differing_bits(F.col("x.f"), F.col("y.f")))
    # at two similar sets' first common shingle, what is left of either still has room for their overlap
    room = F.least(n - F.col("x.at"), m - F.col("y.at")) * (100 + percent) >= percent * (n + m)
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    fits = _sizes_agree(n, m, percent) & room & apart & _overlap_fits(n, m, differ, percent)
    pairs = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.gid") < F.col("y.gid")) & fits).select(F.col("x.gid").alias("gid_a"), F.col("y.gid").alias("gid_b")).distinct()
    return pairs.union(marks.where("lo < hi").select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b")))


def without_near_copies(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, that stand for their component: one of each, that of the least doc_id.

    Texts without words stay. Rows of equal doc_id and text leave one; of nulls likewise. Columns of any name pass through.
    """
    columns = documents.columns
    work = Workspace(documents.sparkSession, "kept")

    def mark(text_key: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.hex(text_key), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))

    keepers = work.keep("keepers", linked(documents, words, percent).where("keeper").groupBy(mark(F.col("key")).alias("mark")).agg(F.count("*").alias("rows")))
    held = documents.select(F.struct("*").alias("row"), mark(F.unhex(F.md5(F.coalesce("text", F.lit(""))))).alias("mark"))
    again = keepers.where("rows > 1")  # repeated rows: combined before they are shuffled
    once = held.join(keepers.where("rows = 1").select("mark"), "mark", "left_semi").select("row.*")
    if not again.limit(1).count():
        return once.select(columns)
    repeated = salted_join(held, again.select("mark"), "mark", hot_keys(keepers, "mark", "rows"), by=F.monotonically_increasing_id(), how="left_semi").dropDuplicates(["mark"]).select("row.*")
    return once.union(repeated).select(columns)
