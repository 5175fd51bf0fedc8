"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced parts by
recursive bisection: a median split along the principal direction, then swaps that keep the balance and save cut
edges. A small network learns to predict the parts in which a vector's neighbours lie. It
files every vector under its most probable part, and sends queries to the most probable parts
until their probabilities add up to a level at which held-out sample queries found enough.
Small parts share a block and large ones are split into several, and each pair of a block and a bounded chunk of its
queries is reranked by exact inner products in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import map_slices

#: Candidates and queries that one task compares at once.
BLOCK_ROWS, QUERY_ROWS = 16384, 2048
_SLACK = 1e-9


def neighbours(x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Rows of x with the largest inner products with each query, its own row left out."""
    out = np.empty((len(queries), k), np.int64)
    for start in range(0, len(queries), 512):
        s = queries[start : start + 512] @ x.T
        s[np.arange(len(s)), own[start : start + 512]] = -np.inf
        out[start : start + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """The part of each row; parts, a power of two, differ by one row at most on each level."""
    part = np.zeros(len(x), np.int64)
    edges = np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1)
    edges = np.concatenate([edges, edges[:, ::-1]])
    for level in range(int(parts).bit_length() - 1):
        nxt = part * 2
        for p in range(1 << level):
            rows = np.flatnonzero(part == p)
            if len(rows) < 2:
                continue
            centred = x[rows] - x[rows].mean(0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            side = np.zeros(len(rows), np.int8)
            side[np.argsort(centred @ direction, kind="stable")[len(rows) // 2 :]] = 1
            index = np.full(len(x), -1)
            index[rows] = np.arange(len(rows))
            e = index[edges]
            e = e[(e >= 0).all(1)]
            best = np.inf
            for _ in range(rounds):
                other = side[e[:, 0]] != side[e[:, 1]]
                cut = other.sum()
                if cut >= best:
                    break
                best, held = cut, side.copy()
                gain = np.bincount(e[:, 0], np.where(other, 1.0, -1.0), len(rows))
                a, b = (np.flatnonzero(side == s) for s in (0, 1))
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                n = min(len(a), len(b))
                swap = np.flatnonzero(gain[a[:n]] + gain[b[:n]] > 0)
                swap = swap[: max(1, len(swap) // 2)]  # half of them, as swaps disturb each other's gains
                side[a[swap]], side[b[swap]] = 1, 0
            nxt[rows] += held if best < np.inf else side
        part = nxt
    return part


@dataclass(frozen=True)
class Router:
    """Network with one hidden layer, from vectors to log probabilities of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    level: float  # probability that the parts tried have to reach

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 1, (x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(0, 1, (hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            h = np.maximum(x[rows] @ theta[0] + theta[1], 0)
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ theta[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return theta


def learn(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.97, hidden: int = 128, epochs: int = 25, seed: int = 1) -> Router:
    """Fits the router to sample vectors; a tenth of them, kept from training, sets the probability level."""
    scale = np.sqrt((x * x).sum(1).mean())
    x = x / scale
    degree = min(10, len(x) - 1)
    graph = neighbours(x, x, np.arange(len(x)), degree) if degree else np.zeros((len(x), 0), np.int64)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), degree + 1), part[np.column_stack([np.arange(len(x)), graph])].ravel()), 1 / (degree + 1))
    held = np.arange(len(x)) % 10 == 0 if len(x) > k else np.zeros(len(x), bool)  # with no more than k all parts have to be tried
    w1, b1, w2, b2 = _train(x[~held], target[~held], hidden, epochs, seed)
    router = Router(w1 / scale, b1, w2, b2, 1.0)
    if not held.any():
        return router
    x = x * scale
    queries = np.flatnonzero(held)
    true = neighbours(x, x[queries], queries, min(k, len(x) - 1))
    filed = router.probabilities(x).argmax(1)
    p = router.probabilities(x[queries])
    order = np.argsort(-p, axis=1)
    before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
    needed = np.empty_like(p)  # a part is tried if the probability of those before it is below the level
    np.put_along_axis(needed, order, before, 1)
    needed = np.sort(np.take_along_axis(needed, filed[true], 1).ravel())
    return Router(w1 / scale, b1, w2, b2, float(min(1.0, needed[min(len(needed) - 1, int(recall * len(needed)))] + 1e-6)))


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part; of rows of equal vec_id the one with the least vector."""
    v = embeddings.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    v = v.where(good)
    size = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    v = v.where(F.size("vector") == (size["d"] if size else 0))
    if v.groupBy("vec_id").count().where("count > 1").limit(1).count():  # only then are vectors shuffled
        v = v.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return v


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_OUT = "query_id long, vec_id long, score double"


def _rerank(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's k best of one block, nearest first, ties to smaller vec_id; rows of equal vec_id count once.

    Only candidates of the parts that a query tries are compared with it.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if candidates.num_rows and queries.num_rows:
        ids, first = np.unique(candidates.column("vec_id").to_numpy(), return_index=True)
        x, part = _matrix(candidates.column("vector"))[first], candidates.column("part").to_numpy()[first]
        query_ids, first = np.unique(queries.column("vec_id").to_numpy(), return_index=True)
        q, tried = _matrix(queries.column("vector"))[first], queries.column("parts").take(pa.array(first)).to_pylist()
        of: dict[int, list[int]] = {}
        for i, parts in enumerate(tried):
            for p in parts:
                of.setdefault(p, []).append(i)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            for start in range(0, len(of.get(p, ())), 256):
                found += _nearest(ids[rows], x[rows], query_ids, q, np.array(of[p][start : start + 256]), k)
    query, near, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((near, -score, query))
    query, near, score = query[order], near[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return pa.table({"query_id": pa.array(query[place < k]), "vec_id": pa.array(near[place < k]), "score": pa.array(score[place < k])})


def _nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, asking: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    s = q[asking] @ x.T
    s[query_ids[asking][:, None] == ids] = -np.inf
    out = []
    for i, row in zip(asking, s, strict=True):
        edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= edge - _SLACK * max(1.0, abs(edge))) & (row > -np.inf)) if edge > -np.inf else np.flatnonzero(row > -np.inf)
        exact = (x[near] * q[i]).sum(1)  # in the same order for all rows, so that equal vectors have equal scores
        best = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[near][best], exact[best]))
    return out


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each part: large parts have several, small ones share one."""
    count = np.maximum(1, -(-sizes // BLOCK_ROWS))
    first, block, room = np.zeros(len(sizes), np.int64), -1, 0
    for p, n in enumerate(sizes):
        if count[p] > 1 or n > room:
            block, room = block + 1, BLOCK_ROWS
        first[p] = block
        block += count[p] - 1
        room = 0 if count[p] > 1 else room - n
    return first, count


def _place(ids: np.ndarray, of: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 below ``of`` for each id, by a hash."""
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)).astype(np.int64)) % of


def search(embeddings: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 6000, rows_per_part: int = 512, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose vec_id is divisible by ``every``.

    Nearness is the inner product in double precision. The router is fitted on about ``sample_rows``
    vectors, drawn by a hash of vec_id; all vectors are indexed. Parts grow with the table, in powers of two, as far as the sample has four rows for each; small tables
    have parts of fewer rows. A null vec_id and vectors that are null, zero, of null or
    non-finite components, or of another length than most take no part; rows of equal vec_id count
    once, with the least vector; a query isn't its own neighbour. Ties go to smaller vec_id. Other columns are left out,
    and an empty table gives none. A query tries parts until they hold more than k vectors, or all of them.
    """
    spark = embeddings.sparkSession
    valid = _valid(embeddings)
    n = valid.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 30)) / float(1 << 30)
    sample = valid.where(share < sample_rows / n).select("vec_id", "vector").toArrow()
    if not sample.num_rows:
        sample = valid.limit(1).toArrow()
    sample = sample.sort_by("vec_id")
    parts = 1 << max(0, min(max(n // rows_per_part, min(16, n // 16)), sample.num_rows // 4).bit_length() - 1)
    router = spark.sparkContext.broadcast(learn(_matrix(sample.column("vector")), parts, k, recall))

    def file():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.value.probabilities(_matrix(batch.column(1))).argmax(1), pa.int32())], ["vec_id", "vector", "part"])

        return work

    filed = map_slices(valid, file, "vec_id long, vector array<double>, part int")
    sizes = np.zeros(parts, np.int64)
    for r in filed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    first, count = _blocks(sizes)

    def route():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = router.value.probabilities(_matrix(batch.column(1)))
            order = np.argsort(-p, axis=1, kind="stable")
            p = np.take_along_axis(p, order, 1)
            held = sizes[order]
            tried = (np.cumsum(p, 1) - p < router.value.level) | (np.cumsum(held, 1) - held <= k)
            parts = [o[t] for o, t in zip(order.astype(np.int32), tried, strict=True)]
            blocks = [np.unique(np.concatenate([np.arange(first[p], first[p] + count[p]) for p in ps])).astype(np.int32) for ps in parts]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.int32()))], ["vec_id", "vector", "parts", "blocks"])

        return work

    queries = map_slices(valid.where(F.col("vec_id") % every == 0), route, "vec_id long, vector array<double>, parts array<int>, blocks array<int>").select("vec_id", "vector", "parts", F.explode("blocks").alias("block"))
    chunks = np.ones(int(first[-1] + count[-1]), np.int64)
    for r in queries.groupBy("block").count().collect():
        chunks[r["block"]] = max(1, -(-r["count"] // QUERY_ROWS))
    layout = spark.sparkContext.broadcast((first, count, chunks))

    def place_candidates():
        first, count, chunks = layout.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            part = batch.column(2).to_numpy()
            block = first[part] + _place(batch.column(0).to_numpy(), count[part], 1)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array([np.arange(c, dtype=np.int32) for c in chunks[block]], pa.list_(pa.int32()))], ["vec_id", "vector", "part", "block", "chunks"])

        return work

    def place_queries():
        chunks = layout.value[2]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(_place(batch.column(0).to_numpy(), chunks[batch.column(3).to_numpy()], 2), pa.int32())], ["vec_id", "vector", "parts", "block", "chunk"])

        return work

    left = map_slices(filed, place_candidates, "vec_id long, vector array<double>, part int, block int, chunks array<int>").select("vec_id", "vector", "part", "block", F.explode("chunks").alias("chunk"))
    right = map_slices(queries, place_queries, "vec_id long, vector array<double>, parts array<int>, block int, chunk int")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(lambda c, q: _rerank(c, q, k), _OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
