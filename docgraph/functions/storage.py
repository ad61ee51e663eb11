"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's checkpoint folder.

    Where the folder is unset, a local session gets one of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: once a table is written, they would lie on disk till the driver collects garbage."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back: short lineage, one evaluation.

    ``row_group``: bytes of a Parquet row group, for wide rows, which readers hold many at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing(spark):
        (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stored``, dealt into a bucket by ``key`` for each shuffle partition: joins on it leave this side where it is."""
    spark = df.sparkSession
    path, buckets = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"dealt_{uuid.uuid4().hex}"
    with _freeing(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.read.table(table)


def drop(*tables: DataFrame) -> None:
    """Delete what ``stored`` or ``dealt`` wrote and nothing reads any more; files outside the checkpoint folder stay."""
    for df in tables:
        spark = df.sparkSession
        folder = urlparse(spark.conf.get("spark.checkpoint.dir")).path.rstrip("/") + "/"
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if urlparse(path).path.startswith(folder):
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    hits = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return sorted(h.getPath().toString() for h in hits or ())
