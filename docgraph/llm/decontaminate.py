"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of the benchmark items form one suffix automaton. Words of every
document stream through it; the automaton tracks the longest match that ends at each
word. A match of ``window`` words (or a whole item of fewer) marks its words as hit.
Spans of hit words can be removed, and documents over a coverage limit dropped.

The automaton is built from blocks of bounded size (``block_chars``): equal texts are one
entry with all their ids, and a long item is cut into pieces that overlap by a window less
one word. Blocks reach the driver one at a time, and the rows are written between passes,
so a worker holds one automaton however large the benchmark is.

Edge cases: null and empty texts have no words and no hits; items without words match
nothing; repeated items with one id count once; an empty benchmark hits nothing; an
item with null id still hits and counts under the empty id; a column called like a new one
is replaced where hits are marked and kept where they are removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import fresh, materialise

RESULTS = ("n_words", "hits", "item_ids", "longest_match")
PIECE_WORDS = 20_000  # of a long item
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, and every byte that is in no word to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if WORD.fullmatch(bytes([b])) else 32 for b in range(256))


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items behind each full window."""

    def __init__(self, items: list[tuple[tuple[str, ...], list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for ids, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((ids, numbers))
            last = 0
            for x in numbers:
                last = self._extend(last, x)
        # the state that holds a state's suffix of `window` words; -1 where its words are fewer
        self.anchor = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.length[up] >= window else s if self.length[s] >= window else -1
        # whole items shorter than a window, at the state of the item
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.items: dict[int, set[str]] = {}
        for ids, numbers in coded:
            state = size = 0
            for x in numbers:
                state, size = self.step(state, size, x)
                if size >= window:
                    self.items.setdefault(self.anchor[state], set()).update(ids)
            if 0 < len(numbers) < window:
                self.short.setdefault(state, (len(numbers), set()))[1].update(ids)
        self.min_words = min([window, *(n for n, _ in self.short.values())])
        # nearest state at or above that is a short item
        self.short_up = [-1] * len(self.link)
        if self.short:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.short_up[s] = s if s in self.short else self.short_up[self.link[s]]

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, x, q)
        new = self._add(self.length[last] + 1, {})
        p = last
        while p != -1 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, x, q)
        return new

    def _add(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, x: int, q: int) -> int:
        copy = self._add(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, size: int, x: int) -> tuple[int, int]:
        """Longest suffix of the words read so far that occurs in an item."""
        while state and x not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(x)
        return (0, 0) if to is None else (to, size + 1)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit runs of words [start, end), ids of items with an occurring window, longest match."""
        if len(words) < self.min_words:
            return [], set(), 0
        numbers = np.array(list(map(self.vocabulary.get, words, _NONE)), np.int64)
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.min_words
        runs, found, longest, window = [], set(), 0, self.window
        follow, link, length = self.next, self.link, self.length
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = size = 0
            for i, x in enumerate(numbers[a:b].tolist(), a):
                edges_here = follow[state]
                while state and x not in edges_here:
                    state = link[state]
                    size = length[state]
                    edges_here = follow[state]
                state = edges_here.get(x, -1)
                if state < 0:
                    state = size = 0
                    continue
                size += 1
                if size > longest:
                    longest = size
                back = 0
                if size >= window:
                    back = window
                    found |= self.items[self.anchor[state]]
                if self.short:
                    s = state if size >= length[state] else link[state]
                    s = self.short_up[s]
                    while s > 0:
                        n, ids = self.short[s]
                        found |= ids
                        back = max(back, n)
                        s = self.short_up[link[s]]
                if back:
                    if runs and runs[-1][1] >= i + 1 - back:
                        runs[-1] = (min(runs[-1][0], i + 1 - back), i + 1)
                        while len(runs) > 1 and runs[-2][1] >= runs[-1][0]:
                            last = runs.pop()
                            runs[-1] = (min(runs[-1][0], last[0]), last[1])
                    else:
                        runs.append((i + 1 - back, i + 1))
        return runs, found, longest


class _Minus:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_NONE = _Minus()
_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, items: list[tuple[tuple[str, ...], bytes]], window: int) -> SuffixAutomaton:
    """One automaton per worker process and block."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton([(i, t.translate(FOLD).split()) for i, t in items], window)
    return _BUILT[name]


def benchmark_blocks(benchmark: DataFrame, block_chars: int, window: int) -> Iterator[list[tuple[tuple[str, ...], bytes]]]:
    """(ids, text) in blocks of about ``block_chars`` characters each, dealt by a hash of the text; one block at least."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(PIECE_WORDS))
    pieces = items.select("i", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k, PIECE_WORDS + window - 1), " "))).alias("t"))
    entries = materialise(pieces.groupBy("t").agg(F.sort_array(F.collect_set("i")).alias("ids")), "benchmark")
    chars = entries.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        yield [(tuple(r.ids), r.t.encode()) for r in entries.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("t").collect()]


def mark_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_chars: int = 2_000_000, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """The documents with n_words, hits (word runs [start, end)), item_ids and longest_match, or as ``names`` calls them."""
    spark = documents.sparkSession
    out = documents.select(*(c for c in documents.columns if c.lower() not in names))
    base, text_at = len(out.columns), out.columns.index(text_col)
    kinds = ("long", "array<struct<start:long,end:long>>", "array<string>", "long")
    out = out.select("*", *((F.array() if "array" in kind else F.lit(0)).cast(kind).alias(name) for name, kind in zip(names, kinds, strict=True)))
    columns_out = out.columns
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for k, block in enumerate(benchmark_blocks(benchmark, block_chars, window)):
        if k:
            out = materialise(out, "marked")
        sent = spark.sparkContext.broadcast(block)  # at most about block_chars
        name = hashlib.sha256(repr((window, block)).encode()).hexdigest()

        def run(batches, sent=sent, name=name):
            automaton = _automaton(name, sent.value, window)
            for batch in batches:
                n_words, hits, items, longest = [], [], [], []
                before = zip(batch.column(base + 1).to_pylist(), batch.column(base + 2).to_pylist(), batch.column(base + 3).to_pylist(), strict=True)
                for text, (old, old_items, old_longest) in zip(batch.column(text_at), before, strict=True):
                    buffer = text.as_buffer() if text.is_valid else None
                    words = buffer.to_pybytes().translate(FOLD).split() if buffer else []
                    runs, found, best = automaton.match(words)
                    if old:
                        runs = _merge([(r["start"], r["end"]) for r in old] + runs)
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in runs])
                    items.append(sorted(found | set(old_items)))
                    longest.append(max(best, old_longest))
                columns = [*(batch.column(k) for k in range(base)), pa.array(n_words, pa.int64()), pa.array(hits, run_type), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=columns_out)

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))
    return out


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words and what stands between their words."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, pos = [], 0
    for a, b in runs:
        out.append(raw[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*out, raw[pos:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Remove hit spans; drop documents of which more than ``max_coverage`` of the words is hit. Columns stay as they were."""
    columns = documents.columns
    names = tuple(fresh(c, columns) for c in RESULTS)
    marked = mark_hits(documents, benchmark, window, names=names)
    covered = F.aggregate(names[1], F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    kept = marked.where(covered <= F.col(names[0]) * max_coverage)
    at, hits = columns.index("text"), len(columns) + 1

    def run(batches):
        for batch in batches:
            runs = batch.column(hits)
            texts = batch.column(at)
            touched = np.flatnonzero(np.diff(runs.offsets.to_numpy()) > 0) if len(runs) else []
            if len(touched):
                values = texts.to_pylist()
                for k in touched:
                    values[k] = cut_words(values[k], [(r["start"], r["end"]) for r in runs[int(k)].as_py()])
                texts = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(columns))], names=columns)

    return kept.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema]))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_hits(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "longest_match",
    )
