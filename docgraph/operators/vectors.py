"""Exact vector search over a stored pivot index.

Vectors are assigned to the nearest of a set of pivots and stored in blocks of one label and
pivot, with their distances r to the pivot. The score of a query q and a vector v with pivot c
is q.v = q.c + q.(v - c), at most q.c + |q| r. A first pass scores the cells of the best pivots
that hold k vectors together; the k-th score found bounds what may be left out. A second pass
visits the cells and blocks whose bound reaches it.

Cells of a label form parts. Queries travel in blocks, a block once to each part in which one of
its queries visits a cell, with a bit a query and cell; a task holds one part and compares the
blocks that come to it by matrix products. So what is sent grows with queries times parts, whose
number is bounded while ``PART`` is not reached, and never with queries times cells.

The driver holds the pivots and one row per cell (label, pivot): ``MAX_CELLS`` at most while
labels, kinds of nodes, are fewer.

Edge cases: vectors and queries that are null, hold a null or are not of the most frequent
length are left out; scores are rounded to six places, equal ones go by ascending uid; fewer
than k vectors are all returned; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import new_path, stored

MAX_PIVOTS = 1024
MAX_CELLS = 65_536
BLOCK = 1024  # vectors
PART = 16_384  # vectors that a task holds, about
PARTS = 64  # parts of a smaller index
QUERY_BLOCK = 1024
ROW_GROUP = 8 << 20  # bytes: readers hold the rows of a group, and a block is half a megabyte wide
AT_ONCE = 1 << 20  # scores of queries and cells
SLACK = 1e-6  # scores are compared after rounding to six places


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _usable(df: DataFrame, dims: int) -> DataFrame:
    return df.where((F.size("embedding") == dims) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False)))


@dataclass
class PivotIndex:
    """blocks: (label, chunk, salt, pivot, n, r, uids, matrix), r the largest distance of a block; cells: (label, pivot, n, r, chunk, salts).

    A part is what has the same label, chunk and salt; a cell of more vectors than a part is dealt over several salts.
    """

    blocks: DataFrame
    pivots: np.ndarray
    cells: list[tuple] = field(repr=False)

    def visits(self, queries: DataFrame, k: int, per_label: bool) -> DataFrame:
        """(key, label, pivot) of the cells that each query (key, embedding) is compared with; ``least`` as in ``asked``."""
        asked = self.asked(queries, k, per_label).where("salt = 0")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    label, keys = batch.column(0)[i].as_py(), batch.column(1)[i].values
                    for pivot, bits in zip(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), strict=True):
                        use = np.flatnonzero(_unpacked(bits, len(keys)))
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(use)), pa.array([label] * len(use), pa.string()), pa.array(np.full(len(use), pivot, np.int32))], names=["key", "label", "pivot"])

        key = queries.schema["key"].dataType.simpleString()
        return asked.select("label", "keys", "visited", "who").mapInArrow(run, f"key {key}, label string, pivot int")

    def asked(self, queries: DataFrame, k: int, per_label: bool) -> DataFrame:
        """(label, chunk, salt, keys, queries, least, visited, who): blocks of queries, once for each part they visit.

        queries: (key, embedding), and ``least``: (label, least score) pairs found so far. Without
        them, cells of the best pivots up to k vectors; with them, the others that may reach the least score.
        ``visited`` has the pivots of the part's visited cells, ``who`` a bit for each query of the block.
        """
        labels = sorted({c[0] for c in self.cells}, key=lambda x: (x is None, x))
        groups = [[c for c in self.cells if c[0] == x] for x in labels] if per_label else [self.cells]
        tables = [(labels[g] if per_label else None, np.array([c[1] for c in cells]), np.array([c[2] for c in cells]), np.array([c[3] for c in cells]), _parts(cells)) for g, cells in enumerate(groups)]
        again = "least" in queries.columns
        sent = queries.sparkSession.sparkContext.broadcast((self.pivots, tables))  # MAX_PIVOTS vectors and MAX_CELLS cells

        def run(batches):
            pivots, tables = sent.value
            for whole in batches:
                for start in range(0, whole.num_rows, QUERY_BLOCK):
                    batch = whole.slice(start, QUERY_BLOCK)
                    q = _matrix(batch.column(1), pivots.shape[1])
                    dots, norms = q @ pivots.T, np.sqrt((q * q).sum(axis=1))
                    least = [{x["label"]: x["score"] for x in row or ()} for row in batch.column(2).to_pylist()] if again else [{}] * len(q)
                    for name, number, n, r, parts in tables:
                        low = np.array([x.get(name, -np.inf) for x in least])
                        visit = _visited(dots[:, number], norms, n, r, low, k, again)
                        for label, chunk, salts, cells in parts:
                            seen = cells[visit[:, cells].any(axis=0)]
                            if len(seen):
                                who = [np.packbits(visit[:, c]).tobytes() for c in seen]
                                for salt in range(salts):
                                    columns = [[label], [chunk], [salt], None, [q.tobytes()], [low.tobytes()], [number[seen]], [who]]
                                    arrays = [pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), batch.column(0)) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        kinds = [pa.string(), pa.int64(), pa.int64(), None, pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
        names = ["label", "chunk", "salt", "keys", "queries", "least", "visited", "who"]
        key = queries.schema["key"].dataType.simpleString()
        return queries.mapInArrow(run, f"label string, chunk long, salt long, keys array<{key}>, queries binary, least binary, visited array<int>, who array<binary>")

    def compare(self, asked: DataFrame, k: int) -> DataFrame:
        """(key, uid, label, score): of each query and part it visits, the k best that reach the least score; more where scores are equal."""
        dims, key = self.pivots.shape[1], asked.schema["keys"].dataType.elementType.simpleString()
        # a part's blocks come before the queries that visit it
        rows = self.blocks.select("label", "chunk", "salt", "pivot", "r", "uids", "matrix").unionByName(asked, allowMissingColumns=True)
        dealt = rows.repartition("label", "chunk", "salt").sortWithinPartitions("label", "chunk", "salt", F.col("pivot").asc_nulls_last())
        sent = asked.sparkSession.sparkContext.broadcast(self.pivots)

        def run(batches):
            part, held = None, []
            for batch in batches:
                col = {name: batch.column(c) for c, name in enumerate(batch.schema.names)}
                labels, chunks, salts, numbers, radii = (col[x].to_pylist() for x in ("label", "chunk", "salt", "pivot", "r"))
                for i, now in enumerate(zip(labels, chunks, salts, strict=True)):
                    if now != part:
                        part, held = now, []
                    if numbers[i] is not None:
                        held.append((numbers[i], radii[i], col["uids"][i].values, np.frombuffer(col["matrix"][i].as_buffer(), np.float64).reshape(-1, dims)))
                        continue
                    keys = col["keys"][i].values
                    q, least = np.frombuffer(col["queries"][i].as_buffer(), np.float64).reshape(-1, dims), np.frombuffer(col["least"][i].as_buffer(), np.float64)
                    who = dict(zip(col["visited"][i].as_py(), col["who"][i].as_py(), strict=True))
                    for rows, uids, score in _part_best(q, least, [h for h in held if h[0] in who], who, sent.value, k):
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), uids, pa.array([now[0]] * len(rows), pa.string()), pa.array(score)], names=["key", "uid", "label", "score"])

        uid = self.blocks.schema["uids"].dataType.elementType.simpleString()
        return dealt.mapInArrow(run, f"key {key}, uid {uid}, label string, score double")

    def search(self, queries: DataFrame, k: int, per_label: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
        """(*keys, uid, label, score, rank): the k best vectors of each query, or of each query and label."""
        q = stored(_usable(queries, self.pivots.shape[1]).select(F.struct(*keys).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")), "queries")
        blocks = max(1, -(-q.count() // QUERY_BLOCK))
        of = ["key", "label"] if per_label else ["key"]
        order = Window.partitionBy(*of).orderBy(F.desc("score"), "uid")
        first = stored(self.compare(self.asked(q.repartition(blocks), k, per_label), k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "first-found")
        label = F.col("label") if per_label else F.lit(None).cast("string")
        least = first.where(F.col("rank") == k).groupBy("key").agg(F.collect_list(F.struct(label.alias("label"), "score")).alias("least"))  # one pair a label
        later = self.compare(self.asked(q.join(least, "key", "left").select("key", "embedding", "least").repartition(blocks), k, per_label), k)
        every = first.drop("rank").unionByName(later)
        ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("key.*", "uid", "label", "score", "rank")


def _parts(cells: list[tuple]) -> list[tuple]:
    """(label, chunk, salts, places of its cells in the list) of each part; its cells have as many salts as the largest."""
    found: dict = {}
    for place, c in enumerate(cells):
        found.setdefault((c[0], c[4]), []).append(place)
    return [(label, chunk, max(cells[x][5] for x in places), np.array(places)) for (label, chunk), places in found.items()]


def _visited(dots: np.ndarray, norms: np.ndarray, n: np.ndarray, r: np.ndarray, low: np.ndarray, k: int, again: bool) -> np.ndarray:
    """Which cells each query visits: those of the best pivots up to k vectors or, again, the others that may reach ``low``."""
    visit = np.zeros(dots.shape, bool)
    step = max(1, AT_ONCE // dots.shape[1])
    for a in range(0, len(dots), step):
        dot = dots[a : a + step]
        order = np.argsort(-dot, axis=1, kind="stable")
        size = n[order]
        np.put_along_axis(visit[a : a + step], order, np.cumsum(size, axis=1) - size < k, axis=1)
        if again:
            visit[a : a + step] = ~visit[a : a + step] & (dot + norms[a : a + step, None] * r * (1 + 1e-9) >= low[a : a + step, None] - SLACK)
    return visit


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n)


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, rounded score) of each row's k best that reach its least score; equal ones by place, as blocks are in order of uid."""
    near = scores >= least[:, None] - SLACK
    row, place = np.nonzero(near)
    many = np.flatnonzero(np.bincount(row, minlength=len(near)) > k)
    if len(many):
        first = np.argsort(-np.round(scores[many], 6), axis=1, kind="stable")[:, :k]
        near[many] = False
        near[many[:, None], first] = True
        row, place = np.nonzero(near)
    score = np.round(scores[row, place], 6)
    keep = score >= least[row]
    return row[keep], place[keep], score[keep]


def _part_best(q: np.ndarray, least: np.ndarray, held: list[tuple], who: dict[int, bytes], pivots: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(rows, uids, scores) of the vectors of a part's blocks (pivot, r, uids, matrix) that may be among the k best of a query.

    The k-th score found in a part raises what the next block must reach. Rows wait until the part is
    done, or ``AT_ONCE`` of them have come, and those that it has left behind are dropped.
    """
    least, norms = least.copy(), np.sqrt((q * q).sum(axis=1))
    visits = {pivot: _unpacked(bits, len(q)).astype(bool) for pivot, bits in who.items()}
    dots = dict(zip(visits, pivots[list(visits)] @ q.T, strict=True))
    top = np.full((len(q), k), -np.inf) if k <= AT_ONCE // QUERY_BLOCK else None
    found: list[tuple] = []

    def kept():
        rows, uids, score = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
        use = np.flatnonzero(score >= least[rows])
        return rows[use], uids.take(pa.array(use)), score[use]

    for pivot, r, uids, v in held:
        use = np.flatnonzero(visits[pivot] & (dots[pivot] + norms * r * (1 + 1e-9) >= least - SLACK))
        row, place, score = _best(q[use] @ v.T, least[use], k)
        if not len(row):
            continue
        found.append((use[row], uids.take(pa.array(place)), score))
        if top is not None:
            hit, start, n = np.unique(row, return_index=True, return_counts=True)  # rows are in order, k of each at most
            more = np.full((len(hit), k), -np.inf)
            more[np.repeat(np.arange(len(hit)), n), np.arange(len(row)) - np.repeat(start, n)] = score
            hit = use[hit]
            top[hit] = np.partition(np.concatenate([top[hit], more], axis=1), k - 1, axis=1)[:, k:]
            least[hit] = np.maximum(least[hit], top[hit].min(axis=1))
        if sum(len(f[0]) for f in found) > AT_ONCE:
            yield kept()
            found = []
    if found:
        yield kept()


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of one cell and salt, the first four columns, ``most`` at a time."""
    cell, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = row[:4]
            if rows and (now != cell or len(rows) == most):
                yield cell, rows
                rows = []
            cell = now
            rows.append(row[4:])
    if rows:
        yield cell, rows


def build_index(vectors: DataFrame, path: str | None = None, n_pivots: int | None = None) -> PivotIndex | None:
    """Index of vectors (uid, label, embedding), written to ``path`` (by default in the checkpoint folder); None if there is none.

    Pivots are the vectors of the smallest uid hashes, about the square root of their number. Parts hold
    ``PART`` vectors or, in a small index, a ``PARTS``-th of all; twice that at most.
    """
    spark = vectors.sparkSession
    path = path or new_path(spark, "pivot-index")
    rows = vectors.select("uid", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = rows.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull()), F.lit(False)) & (F.size("embedding") > 0))
    dims = whole.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    if dims is None:
        return None
    whole = _usable(rows, dims)
    n, n_labels = whole.agg(F.count("*"), F.count_distinct(F.coalesce("label", F.lit("")))).first()
    if n_labels >= MAX_CELLS:
        raise ValueError(f"labels are kinds of nodes, fewer than {MAX_CELLS}; there are {n_labels}")
    n_pivots = max(1, min(n_pivots or int(n**0.5), MAX_PIVOTS, MAX_CELLS // (n_labels + 1)))
    chosen = whole.select(F.xxhash64("uid").alias("h"), "uid", "embedding").orderBy("h", "uid", "embedding").limit(n_pivots).collect()
    pivots = np.array([r["embedding"] for r in chosen], np.float64)
    uid = whole.schema["uid"].dataType.simpleString()
    square = (pivots * pivots).sum(axis=1)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            near = (square[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
            r = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(r), pa.array([v.tobytes() for v in x], pa.binary())], names=["uid", "label", "pivot", "r", "vector"])

    assigned = stored(whole.mapInArrow(assign, f"uid {uid}, label string, pivot int, r double, vector binary"), "assigned")
    share = max(BLOCK, min(PART, n // PARTS))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a cell
    cells = assigned.groupBy("label", "pivot").agg(F.count("*").alias("n"), F.max("r").alias("r"))
    cells.withColumn("chunk", F.floor(start / share).cast("long")).withColumn("salts", F.ceil(F.col("n") / share).cast("long")).write.parquet(f"{path}/cells")
    place = spark.read.parquet(f"{path}/cells").select(F.col("label").alias("l"), F.col("pivot").alias("p"), "chunk", "salts")
    dealt = assigned.join(F.broadcast(place), F.col("label").eqNullSafe(F.col("l")) & (F.col("pivot") == F.col("p"))).withColumn("salt", F.pmod(F.xxhash64("uid", "vector"), F.col("salts")))  # MAX_CELLS rows at most

    def chop(batches):
        for cell, rows in _runs(batches, BLOCK):
            rows.sort(key=lambda x: (x[0] is not None, x[0]))
            own = [pa.array([x], t) for x, t in zip(cell, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(rows)], pa.int32()), pa.array([max(x[1] for x in rows)]), pa.array([[x[0] for x in rows]], pa.list_(uid_type)), pa.array([b"".join(x[2] for x in rows)], pa.binary())], names=["label", "chunk", "salt", "pivot", "n", "r", "uids", "matrix"])

    uid_type = _arrow_type(whole, "uid")
    # inside a cell, blocks run from near vectors to far ones
    ordered = dealt.repartition("label", "chunk", "salt").sortWithinPartitions("label", "chunk", "salt", "pivot", "r", "uid").select("label", "chunk", "salt", "pivot", "uid", "r", "vector")
    ordered.mapInArrow(chop, f"label string, chunk long, salt long, pivot int, n int, r double, uids array<{uid}>, matrix binary").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pivots)], "pivot int, embedding array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> PivotIndex:
    """An index that ``build_index`` wrote."""
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    cells = spark.read.parquet(f"{path}/cells").select("label", "pivot", "n", "r", "chunk", "salts").collect()
    return PivotIndex(spark.read.parquet(f"{path}/blocks"), np.array([r["embedding"] for r in pivots], np.float64), [tuple(c) for c in cells])


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, per_label: bool = True, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, uid, label, score, rank) over an index built for the occasion."""
    index = build_index(vectors)
    if index is None:
        fields = [queries.schema[c] for c in keys]
        kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"uid {vectors.schema['uid'].dataType.simpleString()}, label string, score double, rank int"])
        return queries.sparkSession.createDataFrame([], kinds)
    return index.search(queries, k, per_label, keys)
