"""Judging of URLs by rules and, where none fits, by trust over the host graph; built-in functions only.

A page votes for the hosts that its HTML links to. A host is a trusted (blocked) seed if rules allow (block) over
half of its pages. Trust is a personalised PageRank that starts from the trusted seeds; distrust runs along the links
backwards, from blocked seeds to the hosts that link there. A host whose distrust exceeds its trust by a factor is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Workspace, hot_keys, salted_join


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z in lower case; empty if null or without ``://``."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty as above."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule (verdict, host, path) that fits, null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's; of equally long ones the first wins.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n) for links between different hosts; relative links and those without a host give none."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?((?:https?:)?//[^\s\"'<>]+)"), F.lit(1))
    ends = pages.select(host_of(F.col("url")).alias("source"), F.explode(links).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return ends.select("source", target.alias("target")).where("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def _propagated(work: Workspace, name: str, edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, mass): personalised PageRank along edges (source, target, n) from seeds (host, mass).

    Seeds are scaled to a sum of 1, and so are all masses: what lies at hosts without links onward goes back to the seeds. Rounds go on until no
    host's mass changes by more than ``tolerance`` of it; a newly reached host changes by all of it. A hub's links are dealt out over many tasks.
    """
    out = work.keep(f"{name}_out", edges.groupBy("source").agg(F.sum("n").alias("all"), F.count("*").alias("rows")))
    hot = hot_keys(out, "source", "rows")
    shares = work.keep(f"{name}_shares", salted_join(edges, out.select("source", "all"), "source", hot, by="target").select("source", "target", (F.col("n") / F.col("all")).alias("share")))
    total = seeds.agg(F.sum("mass")).first()[0] or 1.0
    start = work.keep(f"{name}_seeds", seeds.select("host", (F.col("mass") / total).alias("seed")))
    mass, turn, moving = start.select("host", "seed", F.col("seed").alias("mass")), 0, True
    while moving:
        from_host = mass.select(F.col("host").alias("source"), "mass")
        passed = salted_join(shares, from_host, "source", hot, by="target").select(F.col("target").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"), F.lit(0.0).alias("seed"), F.lit(0.0).alias("before"))
        kept = start.select("host", ((1 - damping) * F.col("seed")).alias("mass"), "seed", F.lit(0.0).alias("before")).union(mass.select("host", F.lit(0.0), F.lit(0.0), "mass"))
        turn += 1
        now = work.keep(f"{name}{turn}", kept.union(passed).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("mass", "seed", "before"))))
        rest = 1.0 - (now.agg(F.sum("mass")).first()[0] or 0.0)
        now = now.withColumn("mass", F.col("mass") + rest * F.col("seed"))
        moving = now.where(F.abs(F.col("mass") - F.col("before")) > tolerance * F.col("mass")).limit(1).count() > 0
        mass = now.select("host", "seed", "mass")
        if turn > 1:
            work.drop(f"{name}{turn - 1}")
    return mass.select("host", "mass")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, tolerance: float = 1e-6, factor: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page.

    The rule's verdict holds; without one a page is blocked if its host's distrust exceeds ``factor`` times its
    trust, else allowed. Both run until no host's mass changes by more than ``tolerance`` of it in a round. Seeds weigh by their pages that rules allow or block; trust and distrust each sum to 1, however many seeds they have. Hosts that no mass reaches have trust and distrust 0 and are
    allowed, as are empty hosts. Nulls in url or html count as empty; repeated rows give repeated results; an empty
    table gives none; other columns are left out.
    """
    work = Workspace(pages.sparkSession, "links")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = work.keep("edges", host_edges(pages))
    counts = (F.count(F.when(F.col("found.verdict") == v, 1)).alias(v) for v in ("allow", "block"))
    votes = work.keep("votes", urls.groupBy("host").agg(F.count("*").alias("pages"), *counts))
    trust, distrust = (votes.where((F.col("host") != "") & (2 * F.col(v) > F.col("pages"))).select("host", F.col(v).cast("double").alias("mass")) for v in ("allow", "block"))
    backwards = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust, distrust = _propagated(work, "trust", edges, trust, damping, tolerance), _propagated(work, "distrust", backwards, distrust, damping, tolerance)
    scores = trust.select("host", F.col("mass").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0).alias("trust"), F.col("mass").alias("distrust")))
    scores = work.keep("scores", scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    joined = salted_join(urls, scores, "host", hot_keys(votes, "host", "pages"), by="page_id", how="left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("found.verdict", F.when(F.col("distrust") > factor * F.col("trust"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
