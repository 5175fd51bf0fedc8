"""Citation graphs: edges, roll-up to chunked ancestors, resolution, bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def structural_edges(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """CONTAINS from parents to nodes and HAS_CHUNK from a chunk's node, or its document, to the chunk; each once."""
    contains = nodes.where(F.col("parent_node_id").isNotNull()).select(F.col("parent_node_id").alias("source_id"), F.lit("CONTAINS").alias("relation"), F.col("node_id").alias("target_id"))
    owner = F.coalesce(F.nullif("parent_node_id", F.lit("")), "document_id")
    has = chunks.select(owner.alias("source_id"), F.lit("HAS_CHUNK").alias("relation"), F.col("chunk_id").alias("target_id"))
    return contains.union(has).distinct()


def rolled_up(ids: DataFrame, known: DataFrame) -> DataFrame:
    """id, retrieval_id, how: the id itself where it is known, else its nearest known ancestor, else null.

    Ancestors are worked out from the ids, so an equality join finds them and no prefix is compared.
    """
    k = known.select(F.col("node_id").alias("k")).distinct()
    steps = ids.select("id", F.posexplode(F.concat(F.array("id"), T.ancestors(F.col("id")))).alias("depth", "k"))
    best = steps.join(k, "k").groupBy("id").agg(F.min(F.struct("depth", "k")).alias("b"))
    how = F.when(F.col("b").isNull(), "UNRESOLVABLE").when(F.col("b.depth") == 0, "DIRECT").otherwise("ANCESTOR")
    return ids.join(best, "id", "left").select("id", F.col("b.k").alias("retrieval_id"), how.alias("how"))


def densified(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges with retrieval_source_id, retrieval_target_id and retrieval_resolution; a roll-up onto the source itself is a SELF_LOOP without target."""
    ids = rolled_up(edges.select(F.col("source_id").alias("id")).union(edges.select(F.col("target_id").alias("id"))).distinct(), known)
    s = ids.select(F.col("id").alias("source_id"), F.col("retrieval_id").alias("retrieval_source_id"))
    t = ids.select(F.col("id").alias("target_id"), F.col("retrieval_id").alias("_t"), F.col("how").alias("_how"))
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    loop = (F.col("_how") == "ANCESTOR") & (F.col("_t") == F.coalesce("retrieval_source_id", "source_id"))
    return e.withColumns({"retrieval_target_id": F.when(~loop, F.col("_t")), "retrieval_resolution": F.when(loop, "SELF_LOOP").otherwise(F.col("_how"))}).drop("_t", "_how")


def expanded(edges: DataFrame, seeds: DataFrame, hops: int, per_hop: int, relations: list[str] | None = None) -> DataFrame:
    """query_id, node, hop, graph_rank: nodes reached from each query's seeds (query_id, node), the seeds left out.

    Each hop follows the ``per_hop`` surest distinct edges of a query's whole frontier; ids break ties. Nodes that were seen before aren't
    reached again. The loop runs over hops, not over data.
    """
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    e = e.select(F.coalesce("retrieval_source_id", "source_id").alias("s"), F.coalesce("retrieval_target_id", "target_id").alias("t"), "relation", "confidence") if "retrieval_source_id" in e.columns else e.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), "relation", "confidence")
    seen = seeds.select("query_id", "node").distinct()
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        steps = frontier.join(e, frontier["node"] == e["s"]).groupBy("query_id", "s", "t", "relation").agg(F.max("confidence").alias("confidence"))
        w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "s", "t", "relation")
        kept = steps.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_hop).groupBy("query_id", F.col("t").alias("node")).agg(F.min("r").alias("r"))
        new = kept.join(seen, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop))
        found = new if found is None else found.unionByName(new)
        frontier = new.select("query_id", "node")
        seen = seen.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "r"))
    return found.withColumn("graph_rank", rank).select("query_id", "node", "hop", "graph_rank")


def nodes_to_chunks(reached: DataFrame, chunks: DataFrame, exclude_regimes: tuple[str, ...] = (), exclude_jurisdictions: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of reached nodes by chunk, parent or document id, nearest discovery kept; excluded values drop, missing ones stay.

    A chunk is given three keys for one equality join instead of a join on either of three conditions.
    """
    c = chunks
    if exclude_regimes:
        c = c.where(F.col("legal_regime").isNull() | ~F.col("legal_regime").isin(*exclude_regimes))
    if exclude_jurisdictions:
        c = c.where(F.col("jurisdiction").isNull() | ~F.col("jurisdiction").isin(*exclude_jurisdictions))
    keys = c.select("chunk_id", F.explode(F.array_distinct(F.array_compact(F.array("chunk_id", "parent_node_id", "document_id")))).alias("node"))
    return reached.join(keys, "node").groupBy("query_id", "chunk_id").agg(F.min("graph_rank").alias("graph_rank"))


#: References in running text: the unit, and its locator with bracketed parts.
REFERENCE = r"(?i)\b(section|regulation|schedule|part)s?\s+([0-9]+[A-Za-z]*(?:\([0-9A-Za-z]+\))*)"


def references(texts: DataFrame) -> DataFrame:
    """source_node_id, ordinal, reference_type, locator, parts of every reference in texts (node_id, text)."""
    found = F.regexp_extract_all("text", F.lit(f"({REFERENCE})"), F.lit(1))
    rows = texts.select(F.col("node_id").alias("source_node_id"), F.posexplode(found).alias("ordinal", "matched_text"))
    locator = F.regexp_extract("matched_text", REFERENCE, 2)
    return rows.select("source_node_id", "ordinal", F.upper(F.regexp_extract("matched_text", REFERENCE, 1)).alias("reference_type"), locator.alias("locator"), T.locator_parts(locator).alias("parts"))


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (source_document_id, reference_type, parts) with status, target_node_id and confidence: exact, nearest ancestor or document only."""
    wanted = F.concat_ws("-", F.concat(F.col("source_document_id"), F.lit("__"), F.lower("reference_type")), "parts")
    r = refs.withColumn("id", wanted)
    ids = rolled_up(r.select("id").distinct(), nodes)
    unit = F.concat(F.col("source_document_id"), F.lit("__"), F.lower("reference_type"))
    exact, above = F.col("how") == "DIRECT", (F.col("how") == "ANCESTOR") & (F.col("retrieval_id") != unit)
    status = F.when(exact, "EXACT_INTERNAL").when(above, "NEAREST_ANCESTOR").otherwise("DOCUMENT_ONLY")
    confidence = F.when(exact, 0.95).when(above, 0.75).otherwise(0.4)
    return r.join(ids, "id", "left").withColumns({"status": status, "target_node_id": F.when(exact | above, F.col("retrieval_id")), "confidence": confidence}).drop("id", "retrieval_id", "how")
