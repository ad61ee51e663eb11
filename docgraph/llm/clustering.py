"""Centroid clustering with an incrementally kept matrix of dot products.

Vectors become whole numbers, so every product, sum and distance is exact and a rerun gives
the same clusters. Each vector's row carries its dot products with all centroids. A round
that moves centroids adds, for every component in which a centroid changed, the change times
the vector's component; nothing is multiplied again for components that stayed. Distances
follow from the products and the stored norms, and the nearest centroid is recomputed from
them. The rows are written to the shared folder after each round, so a lost executor costs
one round's task.

The driver holds the centroids alone: ``k`` x ``dims`` whole numbers.

Edge cases: null vectors, vectors of another length and vectors with a null or non-finite
component are left out; a component whose scaled value passes ``LARGEST`` has no exact
64-bit distance and is an error; with fewer than ``k`` vectors there are that many centroids;
ties go to the smaller centroid; a null id is hashed as an empty one and comes after a present
one, rows of one id are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import materialise, release, scratch, small_table

K = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
#: Scaled components up to this size have squared distances in 64 bits, for up to 64 components.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of ``dims`` finite components as 64-bit whole numbers floor(scale * x), in bytes."""
    x = F.col(vector_col)
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    good = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where((F.size("x") == dims) & finite)
    id_type = good.schema["id"].dataType.simpleString()
    limit = LARGEST * min(1.0, (64 / dims) ** 0.5)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
            scaled = np.floor(scale * flat)
            if len(scaled) and np.abs(scaled).max() > limit:
                raise ValueError(f"a component times {scale} passes {limit:.0f}: distances would not be exact")
            rows = scaled.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "v"])

    return good.mapInArrow(run, f"id {id_type}, v binary")


def first_centroids(rows: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of the seed and their id; equal ones by id, then components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(name.alias("hash"), "id", "v").orderBy("hash", F.col("id").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], np.int64) for r in found], np.int64).reshape(len(found), dims)


def reassign(rows: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(id, v, norm, dots, cluster, distance) once the centroids have moved from ``before`` to ``after``.

    ``dots`` are brought up to date by the components that changed, centroid by centroid.
    """
    k, dims = after.shape
    moved = [(c, np.flatnonzero(after[c] != before[c])) for c in range(k)]
    steps = [(c, at, (after[c] - before[c])[at]) for c, at in moved if len(at)]
    square = (after * after).sum(axis=1)
    id_type = rows.schema["id"].dataType.simpleString()
    old = "dots" in rows.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(n, dims)
            if old:
                norm = batch.column(2).to_numpy()
                dots = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(n, k).copy()
            else:
                norm = (v * v).sum(axis=1)
                dots = np.zeros((n, k), np.int64)
            for c, at, change in steps:
                dots[:, c] += v[:, at] @ change
            distance = norm[:, None] - 2 * dots + square[None, :]
            cluster = distance.argmin(axis=1)  # the first of equals
            least = distance[np.arange(n), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norm, pa.int64()), pa.array([d.tobytes() for d in dots], pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(least, pa.int64())], names=["id", "v", "norm", "dots", "cluster", "distance"]
            )

    given = rows.select("id", "v", "norm", "dots") if old else rows.select("id", "v")
    return given.mapInArrow(run, f"id {id_type}, v binary, norm long, dots binary, cluster int, distance long")


def cluster_sums(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and sizes of all clusters; tasks add up first, so k x dims numbers a task are shuffled."""

    def run(batches):
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, dims)
            cluster = batch.column(0).to_numpy()
            np.add.at(sums, cluster, v)
            count += np.bincount(cluster, minlength=k)
        c = np.repeat(np.flatnonzero(count), dims)
        j = np.tile(np.arange(dims), len(c) // dims)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[c, j]), pa.array(count[c])], names=["cluster", "component", "s", "n"])

    found = rows.select("cluster", "v").mapInArrow(run, "cluster int, component int, s long, n long").groupBy("cluster", "component").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in found:
        sums[r["cluster"], r["component"]] = r["s"]
        count[r["cluster"]] = r["n"]
    return sums, count


def _replaced(df: DataFrame, name: str, before: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` written to the shared folder, and its path; the tables it came from go, as nothing reads them any more."""
    with scratch() as mine:
        out = materialise(df, name)
    release(df.sparkSession, before)
    return out, mine


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every whole vector after ``rounds`` moves of the centroids, and the final centroids."""
    rows, held = _replaced(whole_vectors(vectors, dims, scale, id_col, vector_col), "vectors", [])
    centroids = first_centroids(rows, k, dims, seed)
    k = len(centroids)
    if not k:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state, held = _replaced(reassign(rows, np.zeros_like(centroids), centroids), "assigned", held)
    for _ in range(rounds):
        sums, count = cluster_sums(state, k, dims)
        moved = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)  # floors, for negative sums too
        state, held = _replaced(reassign(state, centroids, moved), "assigned", held)
        centroids = moved
    return state.select(F.col("id").alias(id_col), "cluster", "distance"), centroids


def op13_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, centroids = centroid_clusters(vectors)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row a centroid
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = small_table(spark, [(c, inertia.get(c, 0), total, d) for c, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2") -> str:
    """DuckDB SQL of ``op13_clustering``: each round is an assignment, then new centroids."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, vec_id, v FROM v) ORDER BY h, vec_id NULLS LAST, v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT row_id, vec_id, v, (min(struct_pack(d := d, c := cluster))).c AS cluster, min(d) AS distance FROM"
            f" (SELECT row_id, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY row_id, vec_id, v)"
        )
        if r < rounds:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM"
                f" (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY cluster, j) GROUP BY cluster) m USING (cluster))"
            )
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, a{rounds}.cluster, distance, (sum(distance) OVER (PARTITION BY a{rounds}.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    )
