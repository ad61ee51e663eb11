"""op13 against plain rounds of assignment and exact means."""

import hashlib
import math
import random

import pytest

from docgraph.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, id long, dots binary"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(cl.SCALE * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0))
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(cent)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cent[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cent


def rows_of(n, dims, seed):
    rnd = random.Random(seed)
    vec = lambda: [rnd.randint(-64, 64) / 64 for _ in range(dims)]
    rows = [(i, vec()) for i in range(n)]
    rows += [(1, rows[1][1]), (1, vec()), (900, rows[2][1]), (901, rows[2][1]), (None, vec())]  # repeated rows and ids, equal vectors
    return rows + [(910, None), (911, []), (912, vec()[1:]), (913, [None] + vec()[1:]), (914, [float("nan")] + vec()[1:]), (915, [float("inf")] + vec()[1:]), (916, [-0.001] * dims)]


@pytest.mark.parametrize(("n", "dims", "k"), [(60, 8, 7), (3, 4, 40), (40, 1, 5)])
def test_clusters_equal_plain_rounds(spark, n, dims, k):
    rows = rows_of(n, dims, n)
    df = spark.createDataFrame([(*r, 1, "x", 2, b"y") for r in rows], SCHEMA).repartition(3)
    found, centroids = cl.centroid_clusters(df, k=k, dims=dims)
    want, cent = plain(rows, k, cl.ROUNDS, dims)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == cent


def test_products_follow_the_components_that_move(spark):
    rows = spark.createDataFrame([(i, [float(i), float(-i), 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    whole = cl.whole_vectors(rows, 3, 1, "vec_id", "embedding")
    zero = cl.first_centroids(whole, 2, 3, "2") * 0
    a, b = zero + 1, zero + 1
    b[1, 2] = 7
    state = cl.reassign(cl.reassign(whole, zero, a), a, b)
    fresh = {r["id"]: (r["norm"], bytes(r["dots"]), r["cluster"], r["distance"]) for r in cl.reassign(whole, zero, b).collect()}
    assert {r["id"]: (r["norm"], bytes(r["dots"]), r["cluster"], r["distance"]) for r in state.collect()} == fresh


def test_query_on_empty_and_small_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert cl.op13_clustering(spark, f"{tmp_path}/a").collect() == []
    rows = rows_of(70, cl.DIMS, 3)
    spark.createDataFrame([(*r, 1, "x", 2, b"y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = cl.op13_clustering(spark, f"{tmp_path}/b").collect()
    want, cent = plain(rows, cl.K, cl.ROUNDS, cl.DIMS)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cent[r.cluster])).encode()).hexdigest()


def test_components_beyond_exact_distances_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not be exact"):
        cl.centroid_clusters(df, k=2, dims=2)
