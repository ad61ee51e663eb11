"""Ranked lexical search over FP-trees of documents.

Documents are restricted to the terms that some item asks for. Each one's terms, ordered by
document frequency, are a path; a chunk of documents becomes a trie in which equal beginnings
share nodes (chains without a branch are one edge, up to ``LEAF`` documents one leaf). A node
keeps, of all documents below it, the largest count of each term and the smallest length
factor m, which together bound every score below. Each item searches depth-first, the child of
the largest bound first, and leaves out what can't reach its ten best; leaves are scored
exactly. The ten best go from chunk to chunk inside a task, and those of all tasks meet in the
end: ten rows an item and task.

A chunk holds at most ``CHUNK_DOCS`` documents and about ``CHUNK_ENTRIES`` term counts. Items
reach the driver in blocks of about ``BLOCK_TERMS`` terms; a further block costs a pass over
the documents.

Edge cases: null and empty texts have no term, are not counted and never found; items without
a term find nothing; rows of one item id and text are one item, further texts of an id are
items of their own; equal scores go by ascending id, a null id last; rows of one id are
documents of their own; an empty table on either side gives an empty result; only id and text
columns are read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import materialise, ranges

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A-Z to lower case, and every byte that is in no term to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if TERM.fullmatch(bytes([b])) else 32 for b in range(256))
K = 10
LEAF = 128
CHUNK_DOCS = 8192
CHUNK_ENTRIES = 1 << 20
BLOCK_TERMS = 20_000
STRETCH_BYTES = 1 << 20


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, stretch by stretch."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > STRETCH_BYTES:
            low = raw[at : at + STRETCH_BYTES].translate(FOLD)
            end = at + (low.rfind(b" ") + 1 or len(low))
            while end == at + len(low) and end < len(raw) and FOLD[raw[end]] != 32 and low[-1:] != b" ":
                more = raw[end : end + STRETCH_BYTES].translate(FOLD)
                low += more
                end = at + (low.rfind(b" ") + 1 or len(low))
        yield raw[at:end].translate(FOLD).split()
        at = end


@dataclass
class Items:
    """A block of items: their ids, and (term, times) of each."""

    ids: list
    terms: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    block, size = Items([], [], {}), 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct().toLocalIterator():
        count = Counter(w for words in terms_of(r["text"].encode()) for w in words)
        if not count:
            continue
        if size and size + len(count) > BLOCK_TERMS:
            yield block
            block, size = Items([], [], {}), 0
        size += len(count)
        block.ids.append(r["id"])
        block.terms.append([(block.vocabulary.setdefault(w, len(block.vocabulary)), n) for w, n in count.items()])
    if size:
        yield block


def term_vectors(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf): number of terms of each text, and the counts of those in the vocabulary."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    id_type = source.schema["id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)  # about BLOCK_TERMS terms

    def run(batches):
        known = sent.value.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column(1):
                total, count = 0, Counter()
                for words in terms_of(text.as_buffer().to_pybytes()):
                    total += len(words)
                    count.update(map(known, words))
                count.pop(None, None)
                n.append(total)
                terms.append(np.fromiter(count.keys(), np.int32, len(count)).tobytes())
                tf.append(np.fromiter(count.values(), np.int32, len(count)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], names=["id", "n", "terms", "tf"])

    return source.mapInArrow(run, f"id {id_type}, n long, terms binary, tf binary").where("n > 0")


def document_frequencies(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a task counts first, so at most one row a term and task is shuffled."""

    def run(batches):
        count = np.zeros(n_terms, np.int64)
        for batch in batches:
            count += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Lookup:
    """Counts by (row, term), zero where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, n_terms: int):
        self.keys, self.values, self.n_terms = np.append(keys, np.iinfo(np.int64).max), np.append(values, 0), n_terms

    def of(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        want = rows[:, None] * self.n_terms + terms[None, :]
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.values[at], 0)


def impact(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of rows with counts ``tf`` [row, term]; it grows with tf and falls with m."""
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])) @ weight


class FPTree:
    """Trie over the frequency-ordered term paths of a chunk of documents.

    Nodes are numbered breadth-first, so the children of a node are a range of numbers; documents
    are sorted by path, so those below a node are a range too.
    """

    def __init__(self, size: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray):
        """``terms`` and ``tf`` of all documents one after the other, ``size`` of each; ``rank``: place of each term by frequency."""
        n_terms = len(rank)
        doc = np.repeat(np.arange(len(size)), size)
        path = rank[terms]
        inside = np.lexsort((path, doc))
        terms, tf, path = terms[inside], tf[inside], path[inside].astype(">u4")
        first = np.cumsum(size) - size
        paths = [path[a : a + k].tobytes() for a, k in zip(first.tolist(), size.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(size)), key=paths.__getitem__), np.int64)
        paths = [np.frombuffer(paths[i], np.uint32) for i in self.order]
        self.m = m[self.order]
        length = size[self.order]
        place = np.empty(len(size), np.int64)
        place[self.order] = np.arange(len(size))
        moved = np.argsort(place[doc], kind="stable")
        self.term, self.tf = terms[moved], tf[moved]
        self.start = start = np.concatenate([[0], np.cumsum(length)])
        shared = np.zeros(len(size), np.int64)  # length of the path that a document shares with the one before it
        for i in range(1, len(paths)):
            k = min(len(paths[i]), len(paths[i - 1]))
            other = np.flatnonzero(paths[i][:k] != paths[i - 1][:k])
            shared[i] = other[0] if len(other) else k
        low, high, kids = [0], [len(size)], []
        node = 0
        while node < len(low):
            a, b = low[node], high[node]
            depth = shared[a + 1 : b].min() if b - a > 1 else 0
            if b - a <= LEAF or depth == length[a:b].max():  # few documents, or all of one path
                kids.append((0, 0))
            else:
                cut = [a, *(np.flatnonzero(shared[a + 1 : b] == depth) + a + 1).tolist(), b]
                kids.append((len(low), len(low) + len(cut) - 1))
                low += cut[:-1]
                high += cut[1:]
            node += 1
        self.low, self.high, self.kids = np.array(low), np.array(high), kids
        # counts and m of subtrees, from the leaves up: children have larger numbers
        self.least_m = np.empty(len(low), np.int64)
        held: list = [None] * len(low)
        for node in range(len(low) - 1, -1, -1):
            c, d = kids[node]
            if c == d:
                a, b = start[low[node]], start[high[node]]
                t, v = self.term[a:b], self.tf[a:b]
                self.least_m[node] = self.m[low[node] : high[node]].min()
            else:
                t, v = (np.concatenate(x) for x in zip(*held[c:d], strict=True))
                self.least_m[node] = self.least_m[c:d].min()
            by_term = np.argsort(t, kind="stable")
            t, v = t[by_term], v[by_term]
            new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
            held[node] = (t[new], np.maximum.reduceat(v, new) if len(t) else v)
        keys = np.concatenate([t + node * n_terms for node, (t, _) in enumerate(held)])
        self.most = Lookup(keys, np.concatenate([v for _, v in held]), n_terms)

    def scores(self, rows: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of documents, ``weight_of`` by term and 0 for terms not asked for."""
        size = self.start[rows + 1] - self.start[rows]
        at = ranges(self.start[rows], size)
        weight = weight_of[self.term[at]]
        hit = np.flatnonzero(weight)
        row = np.repeat(np.arange(len(rows)), size)[hit]
        tf = self.tf[at[hit]]
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, row, weight[hit] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[rows[row]])))
        return out

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best, ids: list) -> int:
        """Offers every document that may be among the best; returns how many were scored."""
        scored = 0
        weight_of = np.zeros(self.most.n_terms, np.int64)
        weight_of[terms] = weight
        bound = impact(self.most.of(np.zeros(1, np.int64), terms), self.least_m[:1], weight)
        stack = [(int(bound[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.least:
                continue
            c, d = self.kids[node]
            if c == d:
                rows = np.arange(self.low[node], self.high[node])
                best.offer(self.scores(rows, weight_of), self.order[rows], ids)
                scored += len(rows)
                continue
            nodes = np.arange(c, d)
            bounds = impact(self.most.of(nodes, terms), self.least_m[c:d], weight)
            leaf = self.low[c:d] + LEAF >= self.high[c:d]
            # many small leaves: the most promising few set the least score for the rest
            near = np.flatnonzero(leaf & (bounds >= best.least))
            near = near[np.argsort(-bounds[near], kind="stable")]
            step = 8
            while len(near):
                now, near = near[:step], near[step:]
                now = now[bounds[now] >= best.least]
                if not len(now):
                    break
                rows = np.concatenate([np.arange(self.low[c + x], self.high[c + x]) for x in now])
                best.offer(self.scores(rows, weight_of), self.order[rows], ids)
                scored += len(rows)
                step *= 2
            deep = np.flatnonzero(~leaf & (bounds >= best.least))
            stack += [(int(bounds[x]), int(c + x)) for x in deep[np.argsort(bounds[deep], kind="stable")]]
        return scored


class Best:
    """The k best (score, id) so far: by score, then ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.kept, self.least = k, [], 1

    def offer(self, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= self.least)
        if not len(at):
            return
        new = [(-s, ids[r] is None, ids[r] if ids[r] is not None else 0) for s, r in zip(scores[at].tolist(), rows[at].tolist(), strict=True)]
        self.kept = heapq.nsmallest(self.k, self.kept + new)
        if len(self.kept) == self.k:
            self.least = -self.kept[-1][0]  # an equal score may still have a smaller id


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def search_block(documents: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score): the k best of each task for each item of a block, by the item's number."""
    vectors = materialise(term_vectors(documents, items.vocabulary, id_col, text_col), "term-vectors")
    n_terms = len(items.vocabulary)
    n_docs, n_all = vectors.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(vectors, n_terms)
    weight = weights(df, n_docs)
    rank = np.empty(n_terms, np.int64)
    rank[np.lexsort((np.arange(n_terms), -df))] = np.arange(n_terms)
    asked = [(np.array([t for t, _ in terms], np.int64), np.array([n for _, n in terms], np.int64) * weight[[t for t, _ in terms]]) for terms in items.terms]
    id_type = vectors.schema["id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast((rank, asked))

    def run(batches):
        rank, asked = sent.value
        best = [Best(k) for _ in asked]
        ids, n, terms, tf, arrow_id = [], [], [], [], None

        def close():
            size = np.array([len(t) // 4 for t in terms], np.int64)
            m = np.array([25 + 75 * x * n_docs // n_all for x in n], np.int64)
            tree = FPTree(size, np.frombuffer(b"".join(terms), np.int32).astype(np.int64), np.frombuffer(b"".join(tf), np.int32).astype(np.int64), m, rank)
            for (t, w), b in zip(asked, best, strict=True):
                tree.search(t, w, b, ids)

        entries = 0
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for held, x in zip((ids, n, terms, tf), row, strict=True):
                    held.append(x)
                entries += len(row[2]) // 4
                if len(ids) == CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    close()
                    ids, n, terms, tf, entries = [], [], [], [], 0
        if ids:
            close()
        out = [(item, None if missing else i, -s) for item, b in enumerate(best) for s, missing, i in b.kept]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], arrow_id), pa.array(columns[2], pa.int64())], names=["item", "id", "score"])

    return vectors.where(F.length("terms") > 0).mapInArrow(run, f"item long, id {id_type}, score long")


def ranked_search(items: DataFrame, documents: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, id, score): the k best documents of each item with a score above 0."""
    spark = documents.sparkSession
    item_type = items.schema[item_id].dataType
    out = None
    for block in item_blocks(items, item_id, item_text):
        found = search_block(documents, block, k, id_col, text_col)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, i in enumerate(block.ids)], f"item long, item_id {item_type.simpleString()}")
        top = top.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score")  # the ids of one block
        out = top if out is None else out.unionByName(top)
    if out is None:
        return spark.createDataFrame([], f"{item_id} {item_type.simpleString()}, rank int, {id_col} {documents.schema[id_col].dataType.simpleString()}, score long")
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
stat AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), stat),
s AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), stat GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
