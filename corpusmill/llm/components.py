"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, hot_keys, salted_join


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(work: Workspace, name: str, neighbours: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller) neighbours on the least node of its neighbourhood.

    The least node comes from a partial aggregate; in the join, a hub's edges are dealt out over many tasks.
    """
    least = work.keep(name, neighbours.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("degree")))
    joined = salted_join(neighbours, least.select("a", "m"), "a", hot_keys(least, "a", "degree"), by="b")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node with an edge (a, b): component is the least node reachable.

    Nodes are numbers; loops and repeated edges do no harm, edges with a null end are left out, no
    edges give no rows. Each round is cut from its lineage by a written table; those of earlier rounds are deleted.
    """
    work = Workspace(edges.sparkSession, "components")
    edges = work.keep("edges", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest, held = None, "edges"
    for turn in range(most_rounds):
        large = work.keep(f"large{turn}", _star(work, f"least{turn}l", _both(edges), large=True))
        edges = work.keep(f"small{turn}", _star(work, f"least{turn}s", large.where("b < a"), large=False))
        work.drop(held, f"large{turn}", f"least{turn}l", f"least{turn}s")
        held = f"small{turn}"
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if digest == (now["n"], now["h"]):
            break
        digest = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
