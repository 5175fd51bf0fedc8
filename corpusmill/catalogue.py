"""All queries of the engine's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import evaluation, graphs, pages, retrieval, rules, texts

_PLANS = (retrieval, texts, evaluation, graphs, pages, rules)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLES.items()}
FLAGSHIP = "bm25_two_lane_topk"
