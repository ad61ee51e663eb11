"""Interval labels and ancestors against walking up the parents."""

import random
from pathlib import Path

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from docgraph.functions.storage import FREE, dealt, drop, new_path, stored
from docgraph.operators import tree
from docgraph.operators.graph import closure


def plain(edges, depth):
    up = {d: s for s, d in edges}
    out = []
    for node in up:
        at, steps = node, 0
        while at in up and steps < depth:
            at, steps = up[at], steps + 1
            out.append((at, node, steps))
    return sorted(out)


def forest(seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randint(max(0, i - 40), max(0, i - 20))}", f"n{i}") for i in range(1, 120)]
    edges += [(f"deep{i}", f"deep{i + 1}") for i in range(9)]  # a chain
    edges += [("hub", f"leaf{i}") for i in range(400)]  # a parent of many
    return edges + [("a", "b"), ("a", "b")]


def test_labels_nest_and_ancestors_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(tree, "SLICE", 50)
    edges = forest(1)
    labels = tree.interval_labels(spark.createDataFrame(edges, "src string, dst string").repartition(3))
    rows = {r.uid: r for r in labels.collect()}
    assert sorted(r.pre for r in rows.values()) == list(range(len(rows))) and len(rows) == len({x for e in edges for x in e})
    for r in rows.values():
        assert r.pre <= r.last and (r.parent is None) == (r.level == 0)
        if r.parent is not None:
            p = rows[r.parent]
            assert p.pre < r.pre and r.last <= p.last and r.level == p.level + 1
    for depth in (1, 4, 100):
        assert sorted(map(tuple, tree.ancestors(labels, depth).collect())) == plain(edges, depth)
    assert sorted(map(tuple, tree.ancestors(labels).collect())) == plain(edges, 1000)


def test_cycles_and_second_parents_are_errors(spark):
    df = lambda e: spark.createDataFrame(e, "src string, dst string")
    with pytest.raises(ValueError, match="'x'.*cycle"):
        closure(df([("a", "b"), ("x", "y"), ("y", "z"), ("z", "x")]))
    with pytest.raises(ValueError, match="'b' has 2 parents"):
        closure(df([("a", "b"), ("c", "b")]))
    with pytest.raises(ValueError, match="cycle"):
        closure(df([("a", "a")]))
    assert closure(df([("a", None), (None, "b")])).collect() == []


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_closure_of_any_depth_without_a_chain_of_joins(spark, depth):
    found = closure(spark.createDataFrame(forest(2), "src string, dst string"), depth)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == plain(forest(2), depth)


def test_levels_leave_the_nodes_where_they_are(spark):
    """Nodes are dealt by parent once; a level's join shuffles the level above alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = dealt(spark.range(100).select(F.col("id").cast("string").alias("uid"), F.col("id").cast("string").alias("parent")), "parent", "nodes")
        plan = nodes.where("parent is not null").join(nodes.select(F.col("uid").alias("parent")).distinct(), "parent")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    closed = closure(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), (None, "x"), ("y", None)], "src string, dst string"))
    assert sorted(map(tuple, closed.collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


@pytest.fixture
def written(spark):
    """The tables that a test has left in the checkpoint folder."""
    folder = Path(new_path(spark, "any").removeprefix("file:")).parent
    before = set(folder.iterdir())
    return lambda: [p for p in folder.iterdir() if p not in before]


def test_labels_leave_a_leaf_written_once(spark, written):
    """Tables that nothing reads any more are deleted, and leaves are not written level by level."""
    labels = tree.interval_labels(spark.createDataFrame(forest(3), "src string, dst string"))
    found = [ds.dataset(str(p), format="parquet").to_table(columns=["uid"])["uid"].to_pylist() for p in written() if any(p.rglob("*.parquet"))]
    assert sum(uids.count("leaf7") for uids in found) == 1
    assert labels.where("uid = 'leaf7'").count() == 1


def test_stored_tables_leave_no_shuffle_files(spark, written):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*")}
    rows = spark.range(1000).groupBy((F.col("id") % 70).alias("k")).count()
    before = files()
    table, other = stored(rows, "counted"), dealt(rows, "k", "dealt")
    assert files() <= before and spark.conf.get(FREE, "false") == "false"
    assert table.count() == other.count() == 70
    nation = "/root/testdata/sf0.001/nation.parquet"
    drop(table, spark.read.parquet(nation))
    assert [p.name.split("-")[0] for p in written()] == ["dealt"] and Path(nation).exists()
