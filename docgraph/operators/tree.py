"""Levels and interval labels of trees, and ancestors by one sweep over the labels.

A node's interval (pre, last) in preorder holds the intervals of all nodes below it. Levels are
found from the roots down, sizes from the leaves up, and places among siblings by prefix sums
over hash slices, so that neither a hot parent nor a forest of roots is one task. Each node is
joined once a pass, whatever the depth; passes are as many as levels. Leaves take no part in them:
they are dealt by their parents once, and placed behind them in the end.

Ancestors are then a range join for any depth: nodes are dealt over equal ranges of preorder,
together with the intervals that begin in an earlier range and reach into theirs, and a range
is swept once with the stack of open intervals.

Edge cases: repeated edges count once, edges with a null end are left out; a node with two
parents and a cycle are errors that name a node; no edges give no labels.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import dealt, drop, stored

SLICE = 1_000_000  # siblings a hash slice holds, where there are more than SLICES
SLICES = 64


def _nodes(edges: DataFrame) -> DataFrame:
    """(uid, parent, inner) of every node of a tree, dealt by parent; a root has none, an inner node has children."""
    kept = edges.select(F.col("src").alias("parent"), F.col("dst").alias("uid")).where("parent is not null and uid is not null")
    kind = kept.schema["parent"].dataType.simpleString()
    # every node with its parents by one shuffle: a parent comes once more, without one
    ends = kept.unionByName(kept.select(F.col("parent").alias("uid"), F.lit(None).cast(kind).alias("parent")))
    found = ends.groupBy("uid").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"), F.max(F.col("parent").isNull()).alias("inner"))
    nodes = dealt(found.select("uid", "parent", "inner", F.coalesce(F.col("parent") != F.col("other"), F.lit(False)).alias("twice")), "parent", "tree-nodes")
    twice = nodes.where("twice").select("uid").limit(1).collect()
    if twice:
        raise ValueError(f"not a tree: {twice[0]['uid']!r} has {kept.where(F.col('uid') == twice[0]['uid']).distinct().count()} parents")
    return nodes.drop("twice")


def _levels(nodes: DataFrame, inner: DataFrame, depth: int) -> list[DataFrame]:
    """Tables (uid, parent, above and the rest of inner) of the inner nodes, level by level from the roots down."""
    rest = [c for c in inner.columns if c not in ("uid", "parent")]
    kind = inner.schema["parent"].dataType.simpleString()
    e = inner.where("parent is not null")
    levels = [stored(inner.where("parent is null").select("uid", "parent", F.array().cast(f"array<{kind}>").alias("above"), *rest), "level")]
    n = reached = levels[0].count()
    while n:
        last = levels[-1].select(F.col("uid").alias("parent"), F.slice(F.concat(F.array("uid"), "above"), 1, depth).alias("above"))
        levels.append(stored(e.join(last, "parent").select("uid", "parent", "above", *rest), "level"))
        n = levels[-1].count()
        reached += n
    if reached < inner.count():
        known = reduce(DataFrame.unionByName, levels).select(F.col("uid").alias("parent"))
        lost = nodes.where("parent is not null").join(known, "parent", "left_anti").select(F.min("uid")).first()[0]
        raise ValueError(f"not a tree: {lost!r} is on a cycle or below one")
    return levels[:-1] or levels


def levels_of(edges: DataFrame, depth: int = 0) -> list[DataFrame]:
    """Tables (uid, parent, above) of the nodes of a tree: inner nodes level by level from the roots down, then all leaves.

    ``above`` holds the last ``depth`` ancestors, the nearest first. Every node is joined once, with its
    parent, whatever the depth of the tree; nodes lie dealt by their parents, so that a level moves its own rows alone.
    """
    nodes = _nodes(edges)
    levels = _levels(nodes, nodes.where("inner").drop("inner"), depth)
    last = reduce(DataFrame.unionByName, levels).select(F.col("uid").alias("parent"), F.slice(F.concat(F.array("uid"), "above"), 1, depth).alias("above"))
    leaves = stored(nodes.where("not inner").join(last, "parent").select("uid", "parent", "above"), "leaves")
    drop(nodes)
    return [*levels, leaves]


def _before(sizes: DataFrame, key: str, n: int) -> DataFrame:
    """sizes (uid, size and the key) with ``offset``, the sum of the sizes of what comes before in a group of its key: by slices of a hash."""
    cut = sizes.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(max(SLICES, n // SLICE))))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("inner", F.coalesce(F.sum("size").over(before(key, "slice").orderBy("uid")), F.lit(0)))
    sums = cut.groupBy(key, "slice").agg(F.sum("size").alias("s")).withColumn("outer", F.coalesce(F.sum("s").over(before(key).orderBy("slice")), F.lit(0)))
    sums = sums.select(F.col(key).alias("p"), F.col("slice").alias("sl"), "outer")
    joined = inner.join(sums, F.col(key).eqNullSafe(F.col("p")) & (F.col("slice") == F.col("sl")))
    return joined.select(*sizes.columns, (F.col("inner") + F.col("outer")).alias("offset"))


def interval_labels(edges: DataFrame) -> DataFrame:
    """(uid, parent, level, pre, last) of every node of edges (src, dst); roots have no parent and level 0.

    Children that have children come first. Leaves, most of a tree, are numbered where they lie and not written again.
    """
    nodes = _nodes(edges)
    leaf = nodes.where("not inner").select("uid", "parent")
    counts = leaf.groupBy(F.col("parent").alias("uid")).agg(F.count("*").alias("leaves"))
    inner = dealt(nodes.where("inner").join(counts, "uid", "left").select("uid", "parent", F.coalesce("leaves", F.lit(0)).alias("leaves")), "parent", "inner-nodes")
    levels = [x.drop("above") for x in _levels(nodes, inner, 0)]
    # kids: what the inner children of a node hold
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            sums = sized[-1].groupBy(F.col("parent").alias("uid")).agg(F.sum("size").alias("below"))
            level = level.join(sums, "uid", "left")
        kids = F.coalesce("below", F.lit(0)) if sized else F.lit(0)
        sized.append(stored(level.select("uid", "parent", "leaves", kids.cast("long").alias("kids"), (kids + F.col("leaves") + 1).cast("long").alias("size")), "sized"))
    sized.reverse()
    drop(inner, *levels)
    # places among siblings, of all levels at once
    every = reduce(DataFrame.unionByName, (x.withColumn("level", F.lit(i)) for i, x in enumerate(sized)))
    offsets = stored(_before(every, "parent", every.count()), "offsets")
    drop(*sized)
    placed: list[DataFrame] = []
    for depth in range(len(sized)):
        row = offsets.where(F.col("level") == depth)
        if placed:
            row = row.join(placed[-1].select(F.col("uid").alias("parent"), F.col("pre").alias("above")), "parent").withColumn("offset", F.col("above") + 1 + F.col("offset"))
        placed.append(stored(row.select("uid", "parent", "level", F.col("offset").cast("long").alias("pre"), (F.col("offset") + F.col("size") - 1).cast("long").alias("last"), (F.col("offset") + 1 + F.col("kids")).alias("first"), "leaves"), "placed"))
    drop(offsets)
    every = reduce(DataFrame.unionByName, placed)
    met = leaf.join(every.select(F.col("uid").alias("parent"), (F.col("level") + 1).alias("level"), "first", "leaves"), "parent")
    at = lambda rows, offset: rows.select("uid", "parent", "level", (F.col("first") + offset).cast("long").alias("pre")).withColumn("last", F.col("pre"))
    few = met.where(F.col("leaves") <= SLICE)
    out = every.select("uid", "parent", "level", "pre", "last").unionByName(at(few, F.row_number().over(Window.partitionBy("parent").orderBy("uid")) - 1))
    # a hot parent's leaves are dealt over slices
    most = every.agg(F.max("leaves")).first()[0] or 0
    if most > SLICE:
        many = met.where(F.col("leaves") > SLICE).withColumn("size", F.lit(1).cast("long"))
        out = out.unionByName(at(_before(many, "parent", most), F.col("offset")))
    return out


def ancestors(labels: DataFrame, depth: int | None = None) -> DataFrame:
    """(anc, dst, depth) of every node and each of its ancestors, at most ``depth`` steps up."""
    spark = labels.sparkSession
    n = labels.count()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, -(-n // parts))
    own = F.floor(F.col("pre") / width).cast("int")
    # an interval also comes to the later ranges it reaches into
    reaching = labels.select("uid", "pre", "last", F.explode(F.sequence(own, F.floor(F.col("last") / width).cast("int"))).alias("part"))
    uid_type = labels.schema["uid"].dataType.simpleString()

    def run(batches):
        now, stack = None, []
        for batch in batches:
            above, below, steps = [], [], []
            for uid, pre, last, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, stack = part, []
                while stack and stack[-1][0] < pre:
                    stack.pop()
                if pre // width == part:
                    found = stack if depth is None else stack[-depth:]
                    above += [s[1] for s in found]
                    below += [uid] * len(found)
                    steps += range(len(found), 0, -1)
                if last > pre:
                    stack.append((last, uid))
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(above, kind), pa.array(below, kind), pa.array(steps, pa.int32())], names=["anc", "dst", "depth"])

    return reaching.repartition(parts, "part").sortWithinPartitions("part", "pre").mapInArrow(run, f"anc {uid_type}, dst {uid_type}, depth int")
