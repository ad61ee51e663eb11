"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule sits at the fractional part of i times the golden ratio; the
cumulative slot shares map that point to a source. Slots are ranked per source. Each
source's documents, shuffled by a hash of the id, form a stream of words that is cut
into equal blocks of its own, ``LEAST_BLOCKS`` at least (in a source of fewer words some
are empty); a source gets as many slots as its target holds of its blocks. The r-th slot
takes block r modulo the number of blocks, so a source over its size is read again from
the start, three times at most. Ranks and stream positions come from counts per hash bucket, so no task holds a
whole source.

The driver holds one row per source (name, size), ``MAX_SOURCES`` at most, nothing else. A
source's taken words differ from its target by less than one of its blocks, a share of
1 / ``LEAST_BLOCKS`` of its size at most.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own,
last in order; a source of size 0 has target 0; equal rows are interchangeable; an empty
table gives an empty result. Reruns agree: order and schedule depend on ids alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import materialise, offsets_of

GOLDEN = (math.sqrt(5) - 1) / 2
MAX_REPEATS = 3
BLOCKS = 20_000  # of the whole mix, until blocks reach MAX_BLOCK words
MAX_BLOCK = 1_000_000
LEAST_BLOCKS = 500  # of each source
CHUNK = 4096
MAX_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: list[float] | None = None, max_repeats: float = MAX_REPEATS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in code-point order, null last; what exceeds ``max_repeats`` times a size is reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [float((weights or (1, 2, 3))[i % len(weights or (1, 2, 3))]) for i in range(len(order))]
    target = [0.0] * len(order)
    rest, open_ = float(sum(n for _, n in order)), set(range(len(order)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if rest * weight[i] / total > max_repeats * order[i][1]}
        if not over:
            for i in open_:
                target[i] = rest * weight[i] / total
            break
        for i in over:
            target[i] = float(max_repeats * order[i][1])
        rest -= sum(target[i] for i in over)
        open_ -= over
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def schedule(spark, shares: list[float], n_slots: int) -> DataFrame:
    """(source number, rank): slots by golden-ratio points through the cumulative shares, ranked per source."""
    slots = spark.range(n_slots).withColumn("u", (F.col("id") + 1) * GOLDEN % 1.0)
    edges, run = [], 0.0
    for share in shares:
        run += share
        edges.append(run)
    # sources are found by bisection over the array of edges
    slots = slots.withColumn("n", F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("u"))), F.lit(len(shares) - 1)))
    slots = slots.withColumn("chunk", F.floor(F.col("id") / CHUNK))
    offsets = offsets_of(slots.groupBy("n", "chunk").agg(F.count("*").alias("k")), "n", "chunk", "k", "offset")
    inside = Window.partitionBy("n", "chunk").orderBy("id")
    return slots.withColumn("rn", F.row_number().over(inside)).join(offsets, ["n", "chunk"]).select("n", (F.col("offset") + F.col("rn") - 1).alias("rank"))


def mix(documents: DataFrame, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of each row, with its source and a hash of its text."""
    spark = documents.sparkSession
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    rows = materialise(documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("h"), F.xxhash64(text_col).alias("text_hash")), "mix-rows")
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = targets([(r["source"], int(r["size"])) for r in stats], weights)
    total, n_rows = sum(n for _, n, _ in plan), sum(r["n"] for r in stats)
    block = min(MAX_BLOCK, max(1, total // BLOCKS))
    sources, n_slots = [], []
    for i, (source, length, target) in enumerate(plan):
        blocks = max(LEAST_BLOCKS, -(-length // block))
        n_slots.append(round(target * blocks / length) if length else 0)
        sources.append((i, source, length, float(target), blocks, n_slots[-1]))
    known = F.broadcast(spark.createDataFrame(sources, "n int, name string, length long, target double, blocks long, slots long"))  # MAX_SOURCES rows
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name", "slots")
    # stream position of each document inside its source
    buckets = max(1, math.ceil(n_rows / 2000))
    rows = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(2.0**48) * buckets))
    offsets = offsets_of(rows.groupBy("n", "bucket").agg(F.sum("size").alias("k")), "n", "bucket", "k", "offset")
    inside = Window.partitionBy("n", "bucket").orderBy("h", "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["n", "bucket"]).withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    total_slots = sum(n_slots)
    shares = [k / max(1, total_slots) for k in n_slots] or [1.0]
    # slots of the schedule, ranked, fall on blocks; it runs on a while, until each source has had all of its slots
    slots = schedule(spark, shares, total_slots + total_slots // 10).join(known, "n").where(F.col("rank") < F.col("slots"))
    uses = slots.groupBy("n", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("times"))
    # block b of a source holds its words from b * length // blocks on
    held = stream.where(F.col("size") > 0)
    block_of = "((%s + 1) * blocks - 1) div length"
    parts = held.select("n", "size", "start", "length", "blocks", F.explode(F.expr(f"sequence({block_of % 'start'}, {block_of % '(start + size - 1)'})")).alias("block"))
    overlap = F.expr("least(start + size, (block + 1) * length div blocks) - greatest(start, block * length div blocks)")
    taken = parts.join(uses, ["n", "block"]).groupBy("n", "start").agg(F.sum(overlap * F.col("times")).alias("taken"))
    # (source, start) names a document that has words
    joined = stream.withColumn("key", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "key"), ["n", "key"], "left")
    return joined.select(F.col("id").alias(id_col), "size", F.col("length").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias(source_col), "text_hash")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")
