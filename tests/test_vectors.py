"""The pivot index against comparing every query with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.operators import vectors as vec


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def clustered(n, dims, centres, seed):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, dims))
    x = c[rnd.integers(0, centres, n)] + 0.05 * rnd.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, labels=3):
    return spark.createDataFrame([(f"u{i:05d}", f"L{i % labels}" if i % 7 else None, v.tolist()) for i, v in enumerate(x)], "uid string, label string, embedding array<double>").repartition(4)


def plain(queries, rows, k, per_label):
    out = []
    for key, q in queries:
        scored = [(round(float(np.dot(q, v)), 6), uid, label) for uid, label, v in rows]
        for g in {r[2] for r in scored} if per_label else {None}:
            own = sorted((r for r in scored if not per_label or r[2] == g), key=lambda r: (-r[0], r[1]))
            out += [(key, uid, label, score, rank) for rank, (score, uid, label) in enumerate(own[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_label", [True, False])
def test_search_is_exact_and_leaves_vectors_out(spark, per_label):
    x = clustered(3000, 16, 25, 1)
    x[100:400] = x[5]  # many equal vectors: ties
    df = table(spark, x)
    index = vec.build_index(df)
    queries = [(i, x[i * 50] + (0.01 if i % 2 else 0)) for i in range(60)]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id long, embedding array<double>")
    rows = [(r.uid, r.label, np.array(r.embedding)) for r in df.collect()]
    got = sorted((tuple(r) for r in index.search(q, 7, per_label).collect()), key=repr)
    assert got == plain(queries, rows, 7, per_label)
    keyed = q.select(F.struct("query_id").alias("key"), "embedding")
    first = index.visits(keyed, 7, per_label)
    label = F.col("label") if per_label else F.lit(None).cast("string")
    best = index.search(q, 7, per_label).where("rank = 7").groupBy(F.struct("query_id").alias("key")).agg(F.collect_list(F.struct(label.alias("label"), "score")).alias("least"))
    later = index.visits(keyed.join(best, "key"), 7, per_label)
    size = {(c[0], c[1]): c[2] for c in index.cells}
    compared = sum(size[r.label, r.pivot] for df_ in (first, later) for r in df_.select("label", "pivot").collect())
    print(f"share of vectors compared: {compared / (len(queries) * len(x)):.3f}")
    assert compared < 0.5 * len(queries) * len(x)


def test_index_is_read_again(spark, tmp_path):
    x = clustered(300, 8, 5, 2)
    vec.build_index(table(spark, x), f"{tmp_path}/index", 9)
    index = vec.load_index(spark, f"{tmp_path}/index")
    assert index.pivots.shape == (9, 8) and sum(c[2] for c in index.cells) == 300
    q = spark.createDataFrame([("a", 1, x[3].tolist())], "config string, query_id int, embedding array<double>")
    got = index.search(q, 1, False, ("config", "query_id")).collect()
    assert [(r.config, r.query_id, r.uid, r.score, r["rank"]) for r in got] == [("a", 1, "u00003", 1.0, 1)]


def test_odd_rows_and_empty_sides(spark):
    schema = "uid long, label string, embedding array<float>"
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, None, [0.0, 2.0]), (4, "a", None), (5, "a", [None, 1.0]), (6, "b", [1.0]), (7, "b", []), (7, "b", [3.0, 4.0])], schema)
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.uid, r.score) for r in vec.vector_search(q, df, 9, False).collect())
    assert got == [(1, 1, 7, 5.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, 3, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0), (4, 3, 3, 0.0), (4, 4, 7, 0.0)]
    assert vec.vector_search(q, df.limit(0), 3).collect() == [] and vec.vector_search(q.limit(0), df, 3).collect() == []


def test_twenty_thousand_queries_meet_cells_by_keys(spark):
    x = clustered(2000, 8, 40, 3)
    q = spark.createDataFrame([(i, x[i % 2000].tolist()) for i in range(20_000)], "query_id long, embedding array<double>")
    found = vec.build_index(table(spark, x, 1)).search(q, 1, False)
    plan = plan_of(found)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.where("rank = 1 and score > 0.999").count() == 20_000


def test_queries_are_sent_in_blocks_and_nothing_is_broadcast(spark):
    """Visits of single queries, or a join that broadcasts them, grow with queries times cells."""
    x = clustered(3000, 8, 300, 4)
    x = x[np.random.default_rng(5).permutation(len(x))] * np.random.default_rng(6).uniform(0.2, 3, (len(x), 1))
    index = vec.build_index(table(spark, x))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<double>").select(F.struct("query_id").alias("key"), "embedding").coalesce(1)
    sent = index.asked(q, 5, True)
    assert sent.count() <= 3 * len({(c[0], c[4]) for c in index.cells}) < index.visits(q, 5, True).count() / 100
    assert "Broadcast" not in plan_of(index.compare(sent, 5))


def test_equal_vectors_over_several_parts(spark):
    """One cell of more vectors than a part: every salt is visited, ties go by uid."""
    df = spark.range(5000).select(F.format_string("u%05d", F.col("id")).alias("uid"), F.lit("a").alias("label"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    index = vec.build_index(df, n_pivots=3)
    assert max(c[5] for c in index.cells) > 1
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.uid, r.score) for r in index.search(q, 1200).orderBy("rank").collect()] == [(f"u{i:05d}", 0.6) for i in range(1200)]


def test_rows_of_a_part_do_not_grow_with_its_cells(spark):
    """A part gives the k best of a query, not those of each of its cells."""
    x = np.random.default_rng(7).normal(size=(2000, 8))
    index = vec.build_index(table(spark, x, 1), n_pivots=200)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40] + 0.1)], "query_id long, embedding array<double>").select(F.struct("query_id").alias("key"), "embedding")
    everywhere = index.asked(q, 10_000, False)  # fewer vectors than that: each query visits all
    assert index.compare(everywhere, 5).count() <= 40 * 5 * len({(c[0], c[4]) for c in index.cells}) < 40 * 5 * len(index.cells) / 10
