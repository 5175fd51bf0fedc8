"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import delete_folder, shared_folder

#: Rows that Python handles at once; long texts make larger slices costly.
SLICE_ROWS = 512
#: Rows that Spark puts into one Arrow batch while a step is written, which both the JVM and Python hold.
BATCH_ROWS = 1024
#: A key is hot if it has more than this share of a table's rows, so that fewer keys than 1 / share are; a hot key is dealt out over so many tasks.
HOT_SHARE, SALTS = 1 / 1024, 256


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder, which is deleted as the driver's Python ends."""
    return Workspace(df.sparkSession, "step").keep("rows", df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session, with ``__`` for dots, that hold inside the block and are as before after it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables in the shared folder that cut the lineage of a job's steps, each deleted once its last reader is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_folder(spark, name)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read again; the shuffles that made it are deleted."""
        batches = min(BATCH_ROWS, int(self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")))
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(batches)):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete_folder(self.spark, f"{self.folder}/{name}")


def hot_keys(counted: DataFrame, key: str, rows: str) -> list:
    """The keys of a written table (key, rows a key) with over HOT_SHARE of all rows: fewer than 1 / HOT_SHARE."""
    total = counted.agg(F.sum(rows)).first()[0] or 0
    return [r[0] for r in counted.where(F.col(rows) > max(64.0, total * HOT_SHARE)).select(key).collect()]


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: list, by: str | Column, on: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on key (and the columns ``on``), the rows of hot keys dealt out by a hash of ``by``.

    ``one`` has few rows a key; those of hot keys are repeated for each salt. Columns stay as in a plain join.
    """
    on = (key, *on)
    if not hot:
        return many.join(one, list(on), how)
    is_hot = F.col(key).isin(hot)
    many = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    one = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(one, [*on, "_salt"], how).drop("_salt")


def id_crc32(column: str | Column) -> Column:
    """CRC-32 of an id's decimal text, by which rows are held out of learning; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")), "UTF-8"))


_worker_caches: dict[str, list] = {}


def kept_in_worker(build: Callable) -> Callable:
    """``build`` with its last two results kept in a Python worker until that serves a task of another module's operator."""
    cached = lru_cache(maxsize=2)(build)
    _worker_caches.setdefault(build.__module__, []).append(cached)
    return cached


@lru_cache(maxsize=1)
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim  # glibc keeps freed memory else, and an executor's workers add up
    except (AttributeError, OSError):
        return None


def hand_over(module: str) -> None:
    """Drops what operators of other modules keep in this worker, and returns free memory to the system."""
    for owner, caches in _worker_caches.items():
        if owner != module:
            for cached in caches:
                cached.cache_clear()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """df.mapInArrow with a function that ``make`` builds once a task, over slices of bounded rows."""

    module = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_over(module)  # workers are used again by other operators
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                out = work(batch.slice(start, SLICE_ROWS))
                if out is not None and out.num_rows:
                    yield out
        work = batch = out = None
        hand_over(module)

    return df.mapInArrow(run, schema)
