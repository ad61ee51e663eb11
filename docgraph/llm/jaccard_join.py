"""N-gram Jaccard self-join by chosen paths.

A text is its set of five-word shingles; texts of one set form a node. Each node embeds
its set as min-hash coordinates. A first path is one coordinate and its value; nodes that
share a path share a bucket. Buckets over ``bucket_limit`` are split again: the path
samples further coordinates and is extended by the node's value of each, until it is small
or its nodes are alike on average, which no split would part. Small buckets are compared by
brute force on sketches; an alike bucket is one candidate component as it is, and so is
what is large after the last split. Independent first paths repeat the run until the
expected recall at the threshold passes ``recall``, splits counted.

What the buckets connect are candidate components. Inside each, full shingle sets are
compared exactly, in blocks, which gives the number of links of every node and the
classes (connected components of the exact links). Only spanning edges and counts are
ever emitted, never all pairs.

Edge cases: null text reads as empty; texts with fewer than five words have one shingle of
all their words; texts without a word link to nothing but are copies of equal texts; rows
with equal text share a class; a class is named by its smallest doc_id (a null id stays
out of the minimum); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import fresh, join_hot, materialise, ranges, shuffle_partitions, slices, text_buffer
from docgraph.llm.decontaminate import FOLD
from docgraph.llm.substring_dedup import RollingHash, text_key

SHINGLE = 5
COORDINATES = 64
SKETCH_SLACK = 4.0  # standard deviations below the threshold at which sketches still count as alike
CHILDREN = 1.25  # expected coordinates that extend a path: one shared by a pair at the threshold 0.8
MAX_DEPTH = 16
LATE_FACTOR = 8  # buckets split twice are compared by brute force up to so many times the limit
LIKENESS_SAMPLE = 64  # nodes of a large bucket that show whether a split pays
BLOCK = 1024  # nodes of a component compared at once with as many others
BLOCK_SHINGLES = 1 << 20  # and shingles of them

_FOLD = np.frombuffer(FOLD, np.uint8)
_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_MULT = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 62, SHINGLE)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, row after row, and how many each row has."""
    low = _FOLD[data]
    word = low != 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    n = len(offsets) - 1
    if not word.any():
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    h = RollingHash(low).of(start, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(row, minlength=n)
    first = np.cumsum(words) - words
    count = np.where(words >= width, words - width + 1, (words > 0).astype(int))
    at = ranges(first, count)
    own = np.repeat(np.arange(n), count)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    code = np.zeros(len(at), np.uint64)
    last = (first + words)[own]
    for j in range(width):
        code += np.where(at + j < last, padded[at + j], np.uint64(0)) * _WORD_MULT[j]
    code = _mix(code)
    order = np.lexsort((code, own))
    code, own = code[order], own[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])]) if len(code) else np.empty(0, bool)
    return code[new], np.bincount(own[new], minlength=n)


def sketches(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash coordinates [rows, COORDINATES] and a hash of each whole set; rows without shingles get zeros."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), COORDINATES), np.uint64)
    key = np.zeros(len(sizes), np.uint64)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        for i in range(COORDINATES):
            out[full, i] = np.minimum.reduceat(sets * _MULT[i], first)
        key[full] = _mix(np.add.reduceat(_mix(sets), first) ^ (sizes[full].astype(np.uint64) << np.uint64(40)))
    return out, key


def repetitions(threshold: float, recall: float) -> int:
    """First paths needed so that a pair at the threshold meets with probability ``recall``, even if every bucket is split to the end.

    A split draws about ``CHILDREN`` coordinates, one at least; the pair is lost if it is lost under each one that both share.
    """
    lost = 0.0
    for _ in range(MAX_DEPTH):
        lost = math.exp(-CHILDREN * threshold * (1 - lost)) - math.exp(-CHILDREN) * threshold * (1 - lost)
    paths = max(4, math.ceil(math.log(1 - recall) / math.log(1 - threshold * (1 - lost))))
    if paths > COORDINATES:
        raise ValueError(f"a recall of {recall} at a similarity of {threshold} needs {paths} paths; sketches have {COORDINATES} coordinates")
    return paths


def sketch_documents(documents: DataFrame, id_col: str, text_col: str, paths: int, width: int) -> DataFrame:
    """(id, tk, k, size, paths, sketch): tk names the text, k its shingle set."""
    source = documents.select(F.col(id_col).alias("id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("tk"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in slices(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                coords, key = sketches(sets, sizes)
                first = _mix(coords[:, :paths] + np.arange(1, paths + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                short = (coords >> np.uint64(20)).astype(np.uint16)  # the low bits of an odd multiple are weak
                n = j - i
                path_array = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * paths).astype(np.int32)), pa.array(first.view(np.int64).ravel()))
                sketch = pa.array([row.tobytes() for row in short], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(key.view(np.int64)), pa.array(sizes.astype(np.int64)), path_array, sketch], names=["id", "tk", "k", "size", "paths", "sketch"])

    return source.mapInArrow(run, f"id {id_type}, tk long, k long, size long, paths array<long>, sketch binary")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            return label


def _least_agreement(threshold: float) -> float:
    return COORDINATES * threshold - SKETCH_SLACK * math.sqrt(COORDINATES * threshold * (1 - threshold))


def bucket_stars(rows: DataFrame, threshold: float) -> DataFrame:
    """Brute force on sketches inside each bucket: (k, root) edges that span the bucket's alike nodes, roots included."""
    least = _least_agreement(threshold)

    def solve(keys, sketch_rows):
        keys = np.array(keys)
        table = np.frombuffer(b"".join(sketch_rows), np.uint16).reshape(len(keys), COORDINATES)
        order = np.argsort(keys)
        keys, table = keys[order], table[order]
        same = np.zeros((len(keys), len(keys)), np.uint8)
        for i in range(COORDINATES):
            same += table[:, i, None] == table[None, :, i]
        a, b = np.nonzero(np.triu(same >= least, 1))
        return keys, keys[_components(len(keys), a, b)] if len(a) else keys

    def run(batches):
        bucket, keys, held, out_k, out_r, out_b = None, [], [], [], [], []

        def close():
            if keys:
                k, r = solve(keys, held)
                out_k.append(k)
                out_r.append(r)
                out_b.append(np.full(len(k), bucket))

        def flush():
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (out_b, out_k, out_r)]
            for c in (out_b, out_k, out_r):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["path", "k", "root"])

        for batch in batches:
            for path, k, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != bucket:
                    close()
                    bucket, keys, held = path, [], []
                keys.append(k)
                held.append(sketch)
            if len(out_k) > 2000:
                yield flush()
        close()
        yield flush()

    return rows.select("path", "k", "sketch").repartition(2 * shuffle_partitions(rows.sparkSession), "path").sortWithinPartitions("path").mapInArrow(run, "path long, k long, root long")


def extend_paths(rows: DataFrame, depth: int) -> DataFrame:
    """Each path samples coordinates, the same ones for all its nodes, and is extended by the node's value of each."""
    limit = np.uint64(int(CHILDREN / COORDINATES * 2**64))
    coordinate = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_numpy().view(np.uint64)
            table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(paths), COORDINATES)
            draw = _mix(_mix(paths[:, None] + coordinate[None, :]) + np.uint64(depth))
            chosen = draw < limit
            chosen[np.arange(len(paths)), draw.argmin(axis=1)] = True  # one at least
            row, i = np.nonzero(chosen)
            new = _mix(_mix(paths[row] ^ coordinate[i]) + table[row, i].astype(np.uint64))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), batch.column(1).take(taken), batch.column(2).take(taken)], names=["path", "k", "sketch"])

    return rows.select("path", "k", "sketch").mapInArrow(run, "path long, k long, sketch binary")


def alike_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """(path, n) of the buckets whose nodes agree as often as alike ones on average; a sample tells, and decides about cost alone."""
    least = _least_agreement(threshold)

    def judge(frame):
        table = np.frombuffer(b"".join(frame["sketch"]), np.uint16).reshape(len(frame), COORDINATES)
        same = sum((table[:, i, None] == table[None, :, i]).sum() for i in range(COORDINATES)) - COORDINATES * len(table)
        return frame[["path", "n"]].head(int(len(table) > 1 and same >= least * len(table) * (len(table) - 1)))

    sample = rows.where(F.pmod(F.xxhash64("k"), "n") < LIKENESS_SAMPLE)
    return sample.select("path", "n", "sketch").groupBy("path").applyInPandas(judge, "path long, n long")


def candidate_edges(nodes: DataFrame, threshold: float, bucket_limit: int) -> DataFrame:
    """(k, root) edges whose components hold every pair that some bucket finds alike, and all of a bucket that stays large."""
    placed = nodes.select("k", F.explode("paths").alias("path"))
    shared = materialise(placed.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = materialise(join_hot(placed, shared, ["path"], "n", ["k"]).join(nodes.select("k", "sketch"), "k").select("path", "n", "k", "sketch"), "buckets")
    small, together = [], []
    for depth in range(1, MAX_DEPTH + 2):
        limit = bucket_limit if depth <= 2 else LATE_FACTOR * bucket_limit
        small.append(rows.where(F.col("n") <= limit).select("path", "k", "sketch"))
        large = rows.where(F.col("n") > limit)
        if not large.limit(1).count():
            break
        # no pair of a bucket that stays together is left to chance: its full sets are compared
        whole = materialise(alike_buckets(large, threshold) if depth <= MAX_DEPTH else large.groupBy("path").agg(F.count("*").alias("n")), "alike")
        together.append(join_hot(large.drop("n"), whole, ["path"], "n", ["k"]).select("path", "k"))
        if depth > MAX_DEPTH:
            break
        longer = materialise(extend_paths(join_hot(large.drop("n"), whole, ["path"], "n", ["k"], "left_anti"), depth), "longer")
        counts = materialise(longer.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        rows = materialise(join_hot(longer, counts, ["path"], "n", ["k"]).select("path", "n", "k", "sketch"), "buckets")
    edges = [bucket_stars(reduce(DataFrame.unionByName, small), threshold).select("k", "root")]
    if together:
        kept = reduce(DataFrame.unionByName, together)
        roots = materialise(kept.groupBy("path").agg(F.min("k").alias("root"), F.count("*").alias("n")), "roots")
        edges.append(join_hot(kept, roots, ["path"], "n", ["k"]).select("k", "root"))
    return reduce(DataFrame.unionByName, edges).where("k <> root").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(k, label) of every node with an edge: the smallest node its component, by rounds of minima and label jumps."""
    edges = materialise(edges.select("k", "root").unionByName(edges.select(F.col("root").alias("k"), F.col("k").alias("root"))).distinct(), "edges")
    labels = materialise(edges.groupBy("k").agg(F.least(F.min("root"), F.min("k")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("k").alias("root"), "label"), "root").groupBy("k").agg(F.min("label").alias("heard"))
        step = labels.join(heard, "k").select("k", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = step.groupBy("label").agg(F.count("*").alias("c")).join(labels.select(F.col("k").alias("label"), F.col("label").alias("up")), "label").select("label", "up")
        done = materialise(step.join(jump, "label", "left").select("k", F.least("label", F.coalesce("up", "label")).alias("label"), (F.least("label", F.coalesce("up", "label")) < F.col("was")).alias("moved")), "labels")
        labels = done.select("k", "label")
        if not done.where("moved").limit(1).count():
            return labels


def exact_links(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Exact comparison inside each component: (k, links, root).

    ``members``: (comp, parts, k, texts, shingles). ``threshold`` = (p, q): linked if p * common >= q * (|a| + |b|).
    ``links`` counts the texts linked to a node in one block pair, ``root`` spans what the block pair links.
    """
    p, q = threshold

    def solve(pair, rows):
        rows.sort(key=lambda r: r[1])
        block = np.array([r[0] for r in rows])
        keys = np.array([r[1] for r in rows])
        texts = np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(inverse, kind="stable")
        inverse, owner = inverse[order], owner[order]
        common = np.zeros((len(rows), len(rows)), np.float32)
        width = max(256, (8 << 20) // len(rows))
        for start in range(0, len(every), width):
            a, b = np.searchsorted(inverse, [start, start + width])
            table = np.zeros((len(rows), min(width, len(every) - start)), np.float32)
            table[owner[a:b], inverse[a:b] - start] = 1
            common += table @ table.T
        linked = p * common >= q * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if pair[0] != pair[1]:  # pairs of one block are counted where it meets itself
            linked &= block[:, None] != block[None, :]
        count = linked @ texts
        a, b = np.nonzero(np.triu(linked, 1))
        root = keys[_components(len(keys), a, b)] if len(a) else keys
        return keys, count, root

    def run(batches):
        now, rows, out = None, [], []

        def flush():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["k", "links", "root"])

        for batch in batches:
            for comp, x, y, block, k, texts, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, x, y) != now:
                    if rows:
                        out.append(solve(now[1:], rows))
                    now, rows = (comp, x, y), []
                rows.append((block, k, texts, shingles))
            if len(out) > 2000:
                yield flush()
        if rows:
            out.append(solve(now[1:], rows))
        yield flush()

    block = F.pmod(F.xxhash64("k"), F.col("parts"))
    spread = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = spread.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "k", "texts", "shingles")
    keys = ["comp", "x", "y"]
    return spread.repartition(4 * shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "k long, links long, root long")


def _classified(documents: DataFrame, threshold: float, recall: float, bucket_limit: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, class_id, n_links, class_size, kept) per row; ``kept`` (missing, id, tk) stands for the class."""
    docs = materialise(sketch_documents(documents, id_col, text_col, repetitions(threshold, recall), width), "sketched")
    # a node is a shingle set; texts without words, which have none, are nodes by their own key
    worded = F.col("size") > 0
    docs = docs.withColumn("worded", worded).withColumn("k", F.when(worded, F.col("k")).otherwise(F.col("tk")))
    named = F.struct(F.col("id").isNull().alias("missing"), "id", "tk")
    per_text = docs.groupBy("worded", "k", "tk").agg(F.min("id").alias("id"), F.count("*").alias("n_rows"), F.min(named).alias("kept"), F.max("size").alias("size"))
    nodes = materialise(per_text.groupBy("worded", "k").agg(F.count("*").alias("texts"), F.sum("n_rows").alias("n_rows"), F.min("id").alias("id"), F.min("kept").alias("kept"), F.max("size").alias("size")), "nodes")
    sketched = docs.where("worded").groupBy("k").agg(F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    components = connected(candidate_edges(materialise(sketched, "sketches"), threshold, bucket_limit)).withColumnRenamed("label", "comp")
    # full shingle sets of the nodes in components: one text of each is read again, found by the key of the row that stands for it
    members = components.join(nodes.where("worded").select("k", "texts", "size", "kept"), "k")
    sizes = materialise(members.groupBy("comp").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("parts")), "components")
    wanted = join_hot(members, sizes, ["comp"], "members", ["k"])
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    chosen = wanted.select("comp", "parts", "k", "texts", F.col("kept.tk").alias("tk"), F.col("kept.id").alias("id")).withColumn("name", name).drop("id")
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).select(name.alias("name"), text_key(F.col("text")).alias("tk"), "text")
    read = texts.join(chosen, ["name", "tk"])

    def sets(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(4))
            for i, j in slices(offsets):
                values, count = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                ends = np.cumsum(count)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(4)), pa.array([values[e - n : e].tobytes() for e, n in zip(ends, count, strict=True)], pa.binary())], names=["comp", "parts", "k", "texts", "shingles"])

    compared = read.select("comp", "parts", "k", "texts", "text").mapInArrow(sets, "comp long, parts long, k long, texts long, shingles binary").dropDuplicates(["k"])
    # J >= t  <=>  (1 + t) * common >= t * (|a| + |b|), in whole numbers
    scale = 10_000
    found = materialise(exact_links(compared, (round((1 + threshold) * scale), round(threshold * scale))), "links")
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    labels = connected(found.where("k <> root").select("k", "root"))
    # the rest is settled per node; rows only look up theirs in the end
    per_node = nodes.join(links.withColumn("worded", F.lit(True)), ["worded", "k"], "left").join(labels.withColumn("worded", F.lit(True)), ["worded", "k"], "left").withColumn("class", F.coalesce("label", "k"))
    per_node = materialise(per_node.select("worded", "k", "class", "n_rows", "id", "kept", (F.coalesce("links", F.lit(0)) + F.when(F.col("worded"), F.col("texts") - 1).otherwise(F.lit(0))).cast("long").alias("n_links")), "node-links")
    classes = materialise(per_node.groupBy("worded", "class").agg(F.count("*").alias("n"), F.min("id").alias("class_id"), F.sum("n_rows").alias("class_size"), F.min("kept").alias("kept")), "classes")
    settled = materialise(join_hot(per_node.drop("id", "kept"), classes, ["worded", "class"], "n", ["k"]).select("worded", "k", "n_rows", "n_links", "class_id", "class_size", "kept"), "settled")
    return join_hot(docs.select("id", "tk", "worded", "k"), settled, ["worded", "k"], "n_rows", ["id", "tk"])


def jaccard_classes(documents: DataFrame, threshold: float = 0.8, recall: float = 0.999, bucket_limit: int = 128, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) per row: class named by its smallest id, and how many different texts are linked to the row's text."""
    found = _classified(documents, threshold, recall, bucket_limit, width, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", "class_size")


def keep_one(documents: DataFrame, threshold: float = 0.8, recall: float = 0.999, bucket_limit: int = 128, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class stays, the one with the smallest id (a null id comes last, then the text's key decides); columns stay as they were.

    Of rows of one id and one text, one stays, whatever their other columns.
    """
    found = _classified(documents, threshold, recall, bucket_limit, width, id_col, text_col)
    tk, kept_id, kept_tk = (fresh(c, documents.columns) for c in ("tk", "kept_id", "kept_tk"))
    kept = found.select(F.col("kept.id").alias(kept_id), F.col("kept.tk").alias(kept_tk)).distinct()
    keyed = documents.withColumn(tk, text_key(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(kept, keyed[id_col].eqNullSafe(F.col(kept_id)) & (F.col(tk) == F.col(kept_tk)), "left_semi").dropDuplicates([id_col, tk]).select(*documents.columns)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(documents)
