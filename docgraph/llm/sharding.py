"""Sharding by a k-d tree over document metadata.

Points are groups of equal texts. A node is split along its widest dimension (log size,
language, source; hashed names for the latter two) at the weighted quantile that gives
each side the bytes its leaves have room for. The quantile is found by distributed
histograms: one aggregation per pass, a few rows per node to the driver, each pass zooming
into the bucket that holds the cut. Splitting ends when each leaf holds the target bytes;
leaves are the shards. Groups heavier than ``tolerance`` of a shard would tip a split, so
they are placed first, the heaviest into the emptiest shard, and the leaves' room shrinks by
them; only a group that no shard has room for is dealt to several, by a hash of the ids.
Slots are numbered from counts per (shard, hash bucket), so no task ever holds a whole shard.

Only DataFrame functions are used. What the driver sees is bounded by the shard count.

Edge cases: null text has size 8 and the crc32 of nothing, 0; null metadata is a value of its own;
equal texts stay in one shard unless no shard has room for their group; an empty table gives
an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import materialise, offsets_of, small_table

DIMS = ("x_size", "x_lang", "x_source")
KEY_BITS = 60  # 30 bits of coordinate, 30 bits of group hash that order equal coordinates
PASS_BITS = 12


def _unit(c: Column) -> Column:
    """A name as a number in [0, 1)."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(F.crc32(c.cast("string").cast("binary")) / F.lit(4294967296.0))


def _by_node(values: dict[int, Column], otherwise: Column | None = None) -> Column | None:
    """``values[node]`` for the row's node."""
    chain = None
    for n, value in sorted(values.items()):
        chain = F.when(F.col("node") == n, value) if chain is None else chain.when(F.col("node") == n, value)
    return otherwise if chain is None else chain if otherwise is None else chain.otherwise(otherwise)


def _key(dim: str, low: float, high: float) -> Column:
    """Order along a dimension as a 60-bit number; points of equal coordinate are ordered by group."""
    scale = (high - low) or 1.0
    place = F.least(F.greatest((F.col(dim) - low) / scale, F.lit(0.0)), F.lit(1.0))
    return F.shiftleft((place * (2**30 - 1)).cast("long"), 30) + F.shiftrightunsigned(F.col("tie"), 34)


def grow_tree(points: DataFrame, room: list[float], tolerance: float = 0.001) -> DataFrame:
    """The points with their leaf as ``node``: leaves are numbered in tree order, leaf i gets the share ``room[i]`` of the weight.

    The driver holds a few numbers per node, at most as many nodes as leaves at a time.
    """
    n_shards = len(room)
    points = points.withColumn("node", F.lit(0))
    spans = {0: (0, n_shards)}  # node: first leaf, number of leaves
    spread: dict[str, float] | None = None
    while any(n > 1 for _, n in spans.values()):
        stats = {r["node"]: r for r in points.groupBy("node").agg(F.sum("w").alias("w"), *(f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        if not stats:
            break
        if spread is None:
            spread = {d: (stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) or 1.0 for d in DIMS}
        keys, want, total = {}, {}, {}
        for n, (_, leaves) in spans.items():
            if leaves > 1 and n in stats:
                r = stats[n]
                dim = max(DIMS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / spread[d])
                keys[n] = _key(dim, r[f"lo_{dim}"], r[f"hi_{dim}"])
                total[n] = int(r["w"])
                first = spans[n][0]
                own = sum(room[first : first + leaves])
                want[n] = total[n] * (sum(room[first : first + leaves // 2]) / own if own > 0 else 0.5)
        # Written once a level: the next level's expressions then start from plain columns.
        keyed = materialise(points.withColumn("k", _by_node(keys, F.lit(None).cast("long"))), "shard-level")
        prefix, before, width = dict.fromkeys(keys, 0), dict.fromkeys(keys, 0), KEY_BITS
        open_nodes, cuts = set(keys), {}
        while open_nodes and width > 0:  # each pass zooms into the bucket that holds the cut
            width -= PASS_BITS
            inside = _by_node({n: F.shiftright("k", width + PASS_BITS) == prefix[n] for n in open_nodes}, F.lit(False))
            hist = keyed.where(inside).groupBy("node", F.shiftright("k", width).alias("b")).agg(F.sum("w").alias("w"))
            w = Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            goal = _by_node({n: F.lit(float(want[n] - before[n])) for n in open_nodes})
            found = hist.withColumn("upto", F.sum("w").over(w)).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("b", "w", "upto")).alias("s")).collect()
            for r in found:
                n, b, bw, upto = r["node"], r["s"]["b"], int(r["s"]["w"]), int(r["s"]["upto"])
                start = before[n] + upto - bw
                if bw <= tolerance * total[n] / spans[n][1] or width == 0:
                    near_start = want[n] - start <= start + bw - want[n]
                    cuts[n] = (b if near_start else b + 1) << width
                    open_nodes.discard(n)
                else:
                    prefix[n], before[n] = b, start
        step, fresh, free = {}, {}, max(spans) + 1
        for n, (first, leaves) in spans.items():
            if leaves == 1:
                fresh[n] = (first, leaves)
                continue
            half = leaves // 2
            if n in cuts:
                step[n] = F.when(F.col("k") < cuts[n], F.lit(free)).otherwise(F.lit(free + 1))
            fresh[free], fresh[free + 1] = (first, half), (first + half, leaves - half)
            free += 2
        points = keyed.withColumn("node", _by_node(step, F.col("node"))).drop("k")
        spans = fresh
    return points.withColumn("node", _by_node({n: F.lit(first) for n, (first, _) in spans.items()}, F.lit(0)))


def place_heavy(groups: list[tuple], n_shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """(group, size, from, to, shard) of heavy groups, each whole where a shard has room for it, and the room that is left.

    ``groups``: (group, size, rows). The heaviest goes first, into the shard with most room; a group
    that exceeds all room is dealt to several shards, from and to being shares of its rows.
    """
    room, out = [target] * n_shards, []
    for group, size, rows in sorted(groups, key=lambda g: (-g[1] * g[2], g[0], g[1])):
        weight, at = size * rows, 0.0
        while at < 1:
            shard = max(range(n_shards), key=room.__getitem__)
            # a rounding error of a shard's room is no reason to split
            share = 1 - at if weight * (1 - at) <= room[shard] + 0.001 * target or room[shard] <= 0 else room[shard] / weight
            out.append((group, size, at, at + share, shard))
            room[shard] -= weight * share
            at = 1.0 if at + share > 1 - 1e-9 else at + share
    return out, [max(r, 0.0) for r in room]


def kd_shards(documents: DataFrame, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None, tolerance: float = 0.02) -> DataFrame:
    """Shard and slot of each row: (id, size, text_crc32, shard, slot). Law: near-equal bytes per shard.

    Leaves hold ``target_bytes`` each; ``n_shards`` sets the target to a share of the whole instead.
    """
    spark = documents.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = [F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    rows = materialise(
        documents.select(
            F.col(id_col).alias("id"),
            (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"),
            F.crc32(raw).alias("crc"),
            F.xxhash64(raw).alias("group"),
            _unit(meta[0]).alias("x_lang"),
            _unit(meta[1]).alias("x_source"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    n_shards = n_shards or max(1, math.ceil((total["b"] or 0) / target_bytes))
    target = max(1.0, (total["b"] or 0) / n_shards)
    # at most n_shards / tolerance groups are heavy
    heavy = rows.groupBy("group", "size").agg(F.count("*").alias("n")).where(F.col("n") * F.col("size") > target * tolerance).collect()
    dealt, room = place_heavy([tuple(r) for r in heavy], n_shards, target)
    placed = small_table(spark, dealt, "group long, size long, low double, high double, shard int")
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    light = rows.join(F.broadcast(placed.select("group", "size").distinct()), ["group", "size"], "left_anti")
    points = light.groupBy("group", "size").agg(F.sum("size").alias("w"), F.min("x_lang").alias("x_lang"), F.min("x_source").alias("x_source"))
    points = materialise(points.withColumn("x_size", F.log2(F.col("size").cast("double"))).withColumn("tie", F.col("group")), "shard-points")
    leaves = grow_tree(points, room).select("group", "size", F.col("node").alias("shard"))
    # no key of this join is hot: hot groups are heavy
    sharded = light.select("id", "size", "crc", "group").join(leaves, ["group", "size"]).select("id", "size", "crc", "shard")
    pinned = rows.join(F.broadcast(placed), ["group", "size"]).where((own >= F.col("low")) & (own < F.col("high")))
    sharded = sharded.unionByName(pinned.select("id", "size", "crc", "shard"))
    buckets = max(1, math.ceil((total["n"] or 0) / n_shards / 2000))
    sharded = sharded.withColumn("bucket", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)))
    offsets = offsets_of(sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard", "bucket", "n", "offset")
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return (
        sharded.withColumn("rn", F.row_number().over(inside))
        .join(offsets, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"))
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = kd_shards(documents, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
