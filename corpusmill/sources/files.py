"""Readers and writers of the corpus's files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own_folders: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; only on one machine a temporary folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="corpusmill-")
    return _own_folders[app]


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_folder(spark, path)
    except Exception:  # noqa: BLE001 - the session or its JVM may be gone by now
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below ``shared_root``; what lies there is deleted as the driver's Python ends."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, folder)
    return folder


@contextmanager
def scratch(spark: SparkSession):
    """Gives the list of folders that ``written`` makes inside the block; those still on it at its end are deleted."""
    token = _scratch.set(held := [])
    try:
        yield held
    finally:
        _scratch.reset(token)
        for folder in held:
            _delete_quietly(spark, folder)


def written(df: DataFrame, name: str = "step", conf: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once; the shuffles that made it are deleted. conf: settings that hold as it is written."""
    spark, conf = df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (conf or {})
    path, before = shared_folder(spark, name), {k: spark.conf.get(k, None) for k in conf}
    if (held := _scratch.get()) is not None:
        held.append(path)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a missing path is empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, with the file's name in source_file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """folder and kind of every folder below ``root``, by its marker files; legislation before blocks, HTML and PDF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    order = F.when(name == "nodes.jsonl", 1).when(name == "blocks.jsonl", 2).when(name.rlike(r"\.(html|txt)$"), 3).when(name == "pdf_pages.jsonl", 4)
    kinds = F.array(*(F.lit(k) for k in ("LEGISLATION", "BLOCKS", "HTML", "PDF")))
    found = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), order.alias("o")).where("o IS NOT NULL")
    return found.groupBy("folder").agg(F.min("o").alias("o")).select("folder", F.get(kinds, F.col("o") - 1).alias("kind"))


def first_source(sources: DataFrame, by: str, least_bytes: int = 1000) -> DataFrame:
    """Each document's first source by priority that has more than ``least_bytes``."""
    w = Window.partitionBy(by).orderBy("priority")
    return sources.where(F.col("n_bytes") > least_bytes).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """TREC lines: query, 0, document, grade."""
    qrels.select(F.concat_ws(" ", "query_id", F.lit("0"), "chunk_id", F.col("relevance").cast("string"))).write.mode("overwrite").text(path)


def insert_or_ignore(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """held, and those of new whose key it lacks, one row a key."""
    return held.unionByName(new.join(held.select(*key), key, "left_anti").dropDuplicates(key))


def insert_or_replace(held: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """held, with new rows in place of those of equal key; of several new rows of a key the last by all columns stays, unless ``order`` names a column."""
    rest = [c for c in new.columns if c not in key]
    by = F.struct(*([order] if order else []), *rest)
    latest = new.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*") if rest else new.dropDuplicates(key)
    return held.join(latest.select(*key), key, "left_anti").unionByName(latest)


def flagged(rows: DataFrame, flags: DataFrame, key: str, column: str) -> DataFrame:
    """rows with ``column`` set where flags (key, value) say so, and else as it was."""
    f = flags.select(key, F.col("value").alias("_v"))
    old = F.col(column) if column in rows.columns else F.lit(None).cast(f.schema["_v"].dataType)
    return rows.join(f, key, "left").withColumn(column, F.coalesce("_v", old)).drop("_v")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_vectors(rows: DataFrame, path: str, id_column: str = "chunk_id", vector: str = "vector") -> None:
    """Vectors as float arrays with the other columns as payload; of equal ids one stays."""
    rows.withColumn(vector, F.col(vector).cast("array<float>")).dropDuplicates([id_column]).write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A cache of rows, such as the evaluation's candidates, as Parquet."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(rows: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Results with a header; ``fields`` fixes the columns and their order, missing ones are empty."""
    cols = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields] if fields else ["*"]
    rows.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def planned(plan: DataFrame, apply: bool, write) -> DataFrame:
    """The plan, after ``write(plan)`` if it is to be applied; else nothing is written."""
    if apply:
        write(plan)
    return plan


def changes_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of "changes affecting" tables that were saved as CSV, cells stripped, rows without any cell left out."""
    rows = read_csv(spark, path, schema)
    rows = rows.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    return rows.where(F.concat_ws("", *(F.col(c).cast("string") for c in rows.columns)) != "")
