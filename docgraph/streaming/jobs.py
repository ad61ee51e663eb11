"""Streaming: incremental upserts, windowed request totals, skipping seen ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docgraph.functions.storage import delete, found
from docgraph.operators.graph import upsert_nodes


PARTS = 64  # of an upserted table, by the hash of its key


def upsert_stream(rows: DataFrame, table_dir: str, checkpoint: str, key: str, seq: str, parts: int = PARTS, keep: int = 2) -> StreamingQuery:
    """Upsert each batch into the parts of a table that hold its keys; other parts keep their files.

    A part's rows lie in ``data/upsert_part=p/upsert_version=n``, n the batch that wrote them last; ``manifest/version=n``
    says which version of each part counts after batch n and is written last. A batch that failed or is
    replayed starts from the manifest before it and writes its own version anew, so it counts once. Files
    that no manifest of the last ``keep`` batches names are deleted.
    """
    if keep < 2:
        raise ValueError("a replayed batch needs the manifest before it: keep at least two")
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("upsert_part")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, table_dir, number - 1)
        touched = sorted(r["upsert_part"] for r in batch.select(part).distinct().collect())
        paths = [f"{table_dir}/data/upsert_part={p}/upsert_version={before[p]}" for p in touched if p in before]
        existing = spark.read.schema(batch.schema).parquet(*paths) if paths else batch.limit(0)
        merged = upsert_nodes(existing, batch, key, seq).select("*", part, F.lit(number).alias("upsert_version"))
        merged.repartition("upsert_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upsert_part", "upsert_version").parquet(f"{table_dir}/data")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(list(after.items()), "part int, at long").coalesce(1).write.mode("overwrite").parquet(f"{table_dir}/manifest/version={number}")
        old, first = _manifest(spark, table_dir, number - keep), _manifest(spark, table_dir, number - keep + 1)
        for p, version in old.items():
            if first.get(p) != version:
                delete(spark, f"{table_dir}/data/upsert_part={p}/upsert_version={version}")
        delete(spark, f"{table_dir}/manifest/version={number - keep}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, table_dir: str, number: int) -> dict[int, int]:
    """part -> version after a batch, ``PARTS`` rows at most; empty where there was none."""
    path = f"{table_dir}/manifest/version={number}"
    if not found(spark, f"{path}/_SUCCESS"):
        return {}
    return {r["part"]: r["at"] for r in spark.read.parquet(path).select("part", "at").collect()}


def read_upserted(spark: SparkSession, table_dir: str, schema: StructType | str) -> DataFrame:
    """The table as its last whole batch left it."""
    done = [int(p.split("version=")[1].split("/")[0]) for p in found(spark, f"{table_dir}/manifest/version=*/_SUCCESS")]
    versions = _manifest(spark, table_dir, max(done)) if done else {}
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{table_dir}/data/upsert_part={p}/upsert_version={n}" for p, n in versions.items()))


def request_totals(events: DataFrame, window: str = "60 seconds", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Requests and values per window and type; late rows within the bound still count."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def skip_seen(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Each id once, the first time it comes, over the whole history of the stream.

    The state holds every id; with ``late`` it forgets those older than the bound, which may then come again.
    A history beyond memory wants the RocksDB state store of the session.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else events.dropDuplicates([key])
