"""Queries whose results SQL can't give: fuzzy terms, HTML blocks, links and headings, a resumed stream."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import stemming
from corpusmill.operators import fuzzy
from corpusmill.operators import retrieval as R
from corpusmill.plans import corpus as K
from corpusmill.sources import html
from corpusmill.sources.files import shared_folder
from corpusmill.streaming.resume import resumable

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def fuzzy_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Query terms with two letters swapped, against the vocabulary."""
    t = F.col("term")
    swapped = F.concat(F.substring(t, 1, 2), F.substring(t, 4, 1), F.substring(t, 3, 1), F.expr("substring(term, 5)"))
    return fuzzy.variants(K.query_terms(spark, sf).where(F.length("term") >= C.FUZZY_MIN_LENGTH).select(swapped.alias("term")), R.vocabulary(K.tokens(spark, sf)))


@query
def stemmed_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    v = R.vocabulary(K.tokens(spark, sf)).withColumn("stem", stemming.stem("term"))
    return v.groupBy("stem").agg(F.count("*").alias("terms"), F.sum("df").alias("occurrences"))


@query
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.blocks(K.table(spark, sf, "pages"))


@query
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return html.links(K.table(spark, sf, "pages"))


@query
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return html.headings(html.blocks(K.table(spark, sf, "pages")))


@query
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of files, each user and type counted per batch."""
    base = shared_folder(spark, "stream")
    static = K.table(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parquet*")
    q = resumable(stream.select("event_id", "event_type", "value"), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), f"{base}/out", f"{base}/checkpoint", ["event_id"])
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


ORACLES["stream_resume"] = "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"
