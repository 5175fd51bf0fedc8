"""Search entry points: lexical, dense and graph channels fused over batches of queries, in one pool or a pool a lane.

A corpus is given by tokens (doc_id, w, dl), vectors (doc_id, vector[, lane]), meta (doc_id, lane, authority_class, jurisdiction, …), edges, and chunks
(chunk_id, parent_node_id, document_id) whose chunk_id is the doc_id as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as T
from corpusmill.operators import fuzzy
from corpusmill.operators import graph as G
from corpusmill.operators import retrieval as R
from corpusmill.operators.lexical import Lexical
from corpusmill.sources.files import scratch, written

#: Arms of the ablation: which of the channels and of authority take part.
ARMS = {
    "A": {"lexical": False, "graph": False, "rerank": False},
    "B": {"dense": False, "graph": False, "rerank": False},
    "C": {"graph": False, "rerank": False},
    "D": {"graph": False},
    "E": {"rerank": False},
    "F": {},
}
#: Pooled configurations of one budget: id, alpha, beta, jurisdiction.
POOLED = ((1, 0.0, 1.0, False), (2, 0.0, 0.0, False), (3, 0.0, 0.4, False), (4, 0.1, 0.4, False), (5, 0.0, 0.4, True), (6, 0.1, 0.4, True))


@dataclass(frozen=True)
class Corpus:
    tokens: DataFrame
    vectors: DataFrame
    meta: DataFrame
    edges: DataFrame | None = None
    chunks: DataFrame | None = None


def anchors(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, node, position: each hit's chunk, parent node and document, in order of rank, each once. ids: query_id, chunk_id, rank."""
    nodes = F.array_compact(F.array("chunk_id", F.nullif("parent_node_id", F.lit("")), "document_id"))
    a = ids.join(chunks.select("chunk_id", "parent_node_id", "document_id"), "chunk_id").select("query_id", "rank", F.posexplode(nodes).alias("p", "node"))
    return a.groupBy("query_id", "node").agg((F.min(F.col("rank") * 3 + F.col("p"))).alias("position"))


def graph_channel(seeds: DataFrame, corpus: Corpus, hops: int = 1, per_hop: int = 40, relations: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """query_id, doc_id, graph: 1 / rank of the chunks that the seeds' anchors lead to, the old regime's and EU ones left out."""
    starts = anchors(seeds.select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), "rank"), corpus.chunks)
    reached = G.expanded(corpus.edges, starts.select("query_id", "node"), hops, per_hop, relations)
    found = G.nodes_to_chunks(reached, corpus.chunks, ("PCR2015",), ("EU",))
    ranked = R.top(found.withColumn("s", -F.col("graph_rank").cast("double")), ["query_id"], "s", cap or (1 << 30), tie="chunk_id")
    return ranked.select("query_id", F.col("chunk_id").cast("bigint").alias("doc_id"), (1.0 / F.col("rank")).alias("graph"))


def pool_of(corpus: Corpus, lexical: Lexical | None, query_vectors: DataFrame, candidates: int, dense: bool, by_lane: bool) -> DataFrame:
    """The union of both channels' best: query_id, doc_id."""
    by = ["query_id", "lane"] if by_lane else ["query_id"]
    parts = []
    if lexical is not None:
        parts.append(R.top(lexical.best(corpus.meta, candidates, by_lane), by, "bm25", candidates).select("query_id", "doc_id"))
    if dense:
        parts.append(R.dense_top(corpus.vectors, query_vectors, candidates, by_lane).select("query_id", "doc_id"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()


def _scored(ids: DataFrame, lexical: Lexical | None, corpus: Corpus, query_vectors: DataFrame, dense: bool) -> DataFrame:
    """ids with raw scores of either channel: no lexical hit is 0, dense scores are worked out for all."""
    p = ids.join(lexical.scores(ids), ["query_id", "doc_id"], "left").fillna(0.0, ["bm25"]) if lexical is not None else ids.withColumn("bm25", F.lit(0.0))
    if not dense:
        return p.withColumn("dense", F.lit(0.0))
    p = p.join(corpus.vectors.select("doc_id", F.col("vector").alias("dv")), "doc_id", "left").join(query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id")
    return p.withColumn("dense", F.coalesce(R.cosine(F.col("dv"), F.col("qv")), F.lit(0.0))).drop("dv", "qv")


def searched(
    corpus: Corpus, terms: DataFrame, query_vectors: DataFrame, top_k: int = 10, candidates: int = 40, lexical: bool = True, dense: bool = True, graph: bool = True, rerank: bool = True,
    by_lane: bool = False, hops: int = 1, per_hop: int = 40, relations: list[str] | None = None, graph_weight: float = C.GRAPH_WEIGHT, cap: int | None = None, alpha: float = C.ALPHA_DEFAULT, promote: bool = True,
) -> DataFrame:
    """query_id[, lane], doc_id, raw and normalised scores, fusion_score, final_score, via_graph_only and rank: the ``top_k`` best of each query (and lane).

    Means and deviations are those of the retrieved pool; chunks that only the graph finds are scored with them. Authority is scaled over both. Without ``rerank``
    the fused score is final. In one pool, the best legislation moves to the front if none is among the first three. The rows returned lie in a table of
    their own, and what was written on the way is deleted.
    """
    with scratch(corpus.tokens.sparkSession) as held:
        found = written(_found(corpus, terms, query_vectors, top_k, candidates, lexical, dense, graph, rerank, by_lane, hops, per_hop, relations, graph_weight, cap, alpha, promote), "found")
        held.pop()
    return found


def _found(
    corpus: Corpus, terms: DataFrame, query_vectors: DataFrame, top_k: int, candidates: int, lexical: bool, dense: bool, graph: bool, rerank: bool,
    by_lane: bool, hops: int, per_hop: int, relations: list[str] | None, graph_weight: float, cap: int | None, alpha: float, promote: bool,
) -> DataFrame:
    by = ["query_id", "lane"] if by_lane else ["query_id"]
    scores = Lexical(corpus.tokens, terms) if lexical else None
    ids = written(pool_of(corpus, scores, query_vectors, candidates, dense, by_lane))  # read for either channel's scores
    meta = corpus.meta.select("doc_id", "lane", "authority_class", "jurisdiction")
    pool = _scored(ids, scores, corpus, query_vectors, dense).join(meta, "doc_id").withColumn("core", F.lit(True))
    if graph:
        pool = written(pool)  # read for the seeds, for what the graph adds, and for the ranking
        ids = pool.select("query_id", "doc_id")
        first = pool.withColumns({c: R.normalised(c.removesuffix("_norm"), by) for c in ("bm25_norm", "dense_norm")}).withColumn("f", C.BM25_WEIGHT * F.col("bm25_norm") + C.DENSE_WEIGHT * F.col("dense_norm"))
        channel = written(graph_channel(R.top(first, by, "f", top_k).select("query_id", "doc_id", "rank"), corpus, hops, per_hop, relations, cap))
        more = _scored(channel.select("query_id", "doc_id").join(ids, ["query_id", "doc_id"], "left_anti"), scores, corpus, query_vectors, dense).join(meta, "doc_id").withColumn("core", F.lit(False))
        pool = pool.unionByName(more)
        channel = channel.withColumn("graph_norm", R.normalised("graph", ["query_id"]))
        pool = pool.join(channel, ["query_id", "doc_id"], "left")
    else:
        pool = pool.withColumn("graph_norm", F.lit(None).cast("double"))
    pool = pool.withColumns({"authority_weight": T.authority_weight(F.col("authority_class")), "jurisdiction_weight": T.jurisdiction_weight(F.col("jurisdiction"))})
    norm = lambda c, on: R.normalised(c, by, F.col("core")) if on else F.lit(0.0)
    pool = pool.withColumns({"bm25_norm": norm("bm25", lexical), "dense_norm": norm("dense", dense), "authority_norm": R.normalised("authority_weight", by)})
    fused = C.BM25_WEIGHT * F.col("bm25_norm") + C.DENSE_WEIGHT * F.col("dense_norm") + F.coalesce(graph_weight * F.col("graph_norm"), F.lit(0.0))
    pool = pool.withColumn("fusion_score", fused)
    final = (F.col("fusion_score") * (1 - alpha) + F.col("authority_norm") * alpha) * F.col("jurisdiction_weight") if rerank else F.col("fusion_score")
    ranked = R.top(pool.withColumn("final_score", final), by, "final_score", 1 << 30)
    if promote and not by_lane:
        ranked = R.promoted(ranked, by).withColumn("rank", F.col("promoted_rank")).drop("promoted_rank")
    return ranked.where(F.col("rank") <= top_k).select(*dict.fromkeys([*by, "lane"]), "doc_id", "bm25", "dense", "bm25_norm", "dense_norm", "graph_norm", "authority_norm", "fusion_score", "final_score", (~F.col("core")).alias("via_graph_only"), "rank")


def blended_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms for BM25 with what the vocabulary lacks replaced: query_id, phrase, term, weight.

    A term that is missing is looked for by its similar words, each as a prefix, in one phrase whose weight is the best ratio.
    """
    own = terms.select("query_id", F.col("term").alias("phrase"), "term", F.lit(1.0).alias("weight"))
    v = fuzzy.variants(terms, vocab)
    best = v.groupBy("term").agg((F.max("ratio") / 100).alias("weight"), F.collect_set("variant").alias("variants"))
    lengths = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: n)
    heads = vocab.select("term", F.explode(F.transform(lengths, lambda n: F.substring("term", F.lit(1), n))).alias("variant"))
    words = best.select(F.col("term").alias("missing"), "weight", F.explode("variants").alias("variant")).join(heads, "variant").select("missing", "weight", "term").distinct()
    fuzzy_terms = terms.withColumnRenamed("term", "missing").join(words, "missing").select("query_id", F.concat(F.lit("~"), "missing").alias("phrase"), "term", "weight")
    return own.union(fuzzy_terms)


def same_budget(pool: DataFrame, budget: int = 50, alpha: float = C.ALPHA_FROZEN) -> DataFrame:
    """config, query_id, lane, doc_id, rank of six pooled configurations at ``budget`` and three of two lanes at half of it each.

    pool: query_id, lane, doc_id, bm25, dense, authority_weight, jurisdiction_weight and, for the ninth, ce_score. Scores are normalised once in each
    pool, and a small table of settings is exploded over them.
    """
    def normed(by: list[str]) -> DataFrame:
        return pool.withColumns({f"{c}_n": R.normalised(s, by) for c, s in (("b", "bm25"), ("d", "dense"), ("a", "authority_weight"))})

    def score(a, b, j):
        return ((b * F.col("b_n") + (1 - b) * F.col("d_n")) * (1 - a) + F.col("a_n") * a) * F.when(j, F.col("jurisdiction_weight")).otherwise(1.0)

    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("config"), F.lit(a).alias("al"), F.lit(b).alias("be"), F.lit(j).alias("ju")) for i, a, b, j in POOLED)))
    p = normed(["query_id"]).withColumn("g", grid).select("*", "g.*").withColumn("score", score(F.col("al"), F.col("be"), F.col("ju")))
    pooled = R.top(p, ["config", "query_id"], "score", budget).select("config", "query_id", "lane", "doc_id", "rank")
    by = ["query_id", "lane"]
    lanes = normed(by).withColumns({"s7": score(F.lit(0.0), F.lit(C.BM25_WEIGHT), F.lit(True)), "final_score": score(F.lit(alpha), F.lit(C.BM25_WEIGHT), F.lit(True))})
    ranked = R.top(lanes, by, "final_score", 1 << 30)
    post = R.reranked(ranked, by)
    kept = [R.top(lanes, by, "s7", budget // 2).select(F.lit(7).alias("config"), *by, "doc_id", "rank"), ranked.where(F.col("rank") <= budget // 2).select(F.lit(8).alias("config"), *by, "doc_id", "rank"), post.where(F.col("post_rank") <= budget // 2).select(F.lit(9).alias("config"), *by, "doc_id", F.col("post_rank").alias("rank"))]
    out = pooled
    for k in kept:
        out = out.unionByName(k)
    return out
