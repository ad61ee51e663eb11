"""Helpers shared by the corpus operators: shared scratch space and Arrow text buffers."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels work on at once, so that temporaries stay small.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, as
    executors would not see a folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths written inside the block, by this thread alone: what one run may release of its own."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield mine
    finally:
        _SCOPE.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, noted in the ``scratch`` block around it, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _SCOPE.get()) is not None:
        mine.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no query reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by a literal and SQL functions alone."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(':'.join(c.split(None, 1)) for c in schema.split(','))}>>")))


def join_hot(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted``, which has one row per key and says in ``n`` how many rows the key has.

    A key of more than an eighth of a task's fair share of rows is dealt over salts, taken from a
    hash of ``spread``; there are at most eight times as many such keys as shuffle partitions,
    so their list is broadcast. The most frequent key is always listed, which keeps the plan the
    same where no key is hot. ``counted`` should be a stored table: it is read three times.
    """
    parts = shuffle_partitions(rows.sparkSession)
    total, top = counted.agg(F.sum(n), F.max_by(F.struct(*keys), n)).first()
    share = max(1000, (total or 0) // (8 * parts))
    salt = fresh("salt", [*rows.columns, *counted.columns])
    listed = F.col(n) > share
    if top:
        listed = listed | reduce(and_, (F.col(k) == F.lit(top[k]) for k in keys))
    hot = counted.where(listed).select(*keys, F.ceil(F.col(n) / share).cast("long").alias(salt + "s"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(salt + "s")), F.lit(0).cast("long"))).drop(salt + "s")
    copies = counted.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(n) / share).cast("long") - 1, F.lit(0).cast("long")))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def offsets_of(counts: DataFrame, key: str, place: str, value: str, out: str) -> DataFrame:
    """(key, place, out): sum of ``value`` over the smaller places of each key.

    ``counts`` has one row per (key, place), places are whole numbers from 0. Sums run over
    stretches of 1,024 places and then over the stretches, so no task holds all of a key.
    """
    cut = counts.select(key, place, F.col(value).cast("long").alias("v"), F.floor(F.col(place) / 1024).alias("stretch"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("inner", F.coalesce(F.sum("v").over(before(key, "stretch").orderBy(place)), F.lit(0)))
    sums = cut.groupBy(key, "stretch").agg(F.sum("v").alias("v"))
    outer = sums.select(key, "stretch", F.coalesce(F.sum("v").over(before(key).orderBy("stretch")), F.lit(0)).alias("outer"))
    return inner.join(outer, [key, "stretch"]).select(key, place, (F.col("inner") + F.col("outer")).alias(out))


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column, without copying texts; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(wide):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``target`` bytes each, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
