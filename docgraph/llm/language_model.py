"""Language-model scoring by prediction by partial matching (PPM).

Counts of every six-byte string of the training texts (lower-cased, with start and end
marks) are gathered by Spark; shorter contexts are their marginals. Together they are a
trie of byte contexts up to order five, kept whole: it grows with the corpus. Escapes follow
method C with symbol exclusion. With a pretrained trie the cost of a symbol depends on the
five bytes before it alone, so Spark computes one cost per different six-byte string of the
texts to score: strings are dealt by the last two bytes of their context, which all their
contexts of order two and more share, and orders one and none are small tables for all.

Texts sum the costs of their strings. The cost table is sorted and sent to the workers while
it has at most ``table_rows`` rows; beyond that the strings of the texts, counted per slice
of texts, are joined with it. Both give the same sums.

The baseline of each text is an add-0.1 unigram model over all training words, counted
exactly. Words of at least one in ``WORD_SHARE`` occurrences (so many words at most) are
looked up in a table that is sent to the workers; all others are joined, and none of them is
frequent enough to be a hot key.
Words are known by a 64-bit hash.

Edge cases: null text reads as empty and has the end mark alone; with no training rows
every symbol is uniform over 256; a row with null id is scored and not learned from;
repeated rows count and score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import crc_mod, fresh, materialise, ranges, shuffle_partitions, slices, text_buffer
from docgraph.llm.substring_dedup import RollingHash

ORDER = 5
WORD_SHARE = 1_000_000  # a word of at least one in so many occurrences is looked up, not joined
COLLECT_ROWS = 400_000  # rows that reach the driver at a time
TABLE_ROWS = 8_000_000
SCORE_BYTES = 4 << 20  # of text whose strings are looked up at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0] = 1  # 0 is the start and end mark
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def marked_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ORDER start marks before and one end mark after each, and where each starts (at its marks)."""
    size = np.diff(offsets)
    start = offsets[:-1] + np.arange(len(size)) * (ORDER + 1)
    out = np.zeros(len(data) + len(size) * (ORDER + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(start + ORDER - offsets[:-1], size)] = _LOWER[data]
    return out, start


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each symbol with its ORDER predecessors, packed into one number."""
    stream, start = marked_stream(data, offsets)
    at = ranges(start, np.diff(offsets) + 1)
    wide = stream.astype(np.int64)
    code = wide[at]
    for j in range(1, ORDER + 1):
        code = (code << 8) | wide[at + j]
    return code


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    low = _LOWER[data]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    word = ~_SPACE[data]
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1])) if len(low) else np.empty(0, int)
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1 if len(low) else np.empty(0, int)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return RollingHash(low).of(start, end).view(np.int64), np.searchsorted(offsets, start, side="right") - 1


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    return key[new], np.add.reduceat(n, new) if len(key) else n


def _emit(kind: int, key: np.ndarray, n: np.ndarray):
    for i in range(0, len(key), 200_000):
        k = key[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + 200_000])], names=["kind", "key", "n"])


def corpus_counts(documents: DataFrame, text_col: str, train: str) -> DataFrame:
    """(kind, key, n): kind 0 six-byte strings of all texts and their count in training texts, kind 1 words of training texts, kind 2 words of the others.

    Each task sums up what it can hold before the shuffle.
    """

    def count(batches):
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], []), 2: ([], [])}

        def add(kind, key, weight, final=False):
            keys, counts = held[kind]
            if len(key):
                order = np.argsort(key)
                key, weight = key[order], weight[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                keys.append(key[new])
                counts.append(np.add.reduceat(weight, new))
            if sum(map(len, keys)) > 2_500_000 or (final and keys):
                key, n = _tally(keys, counts)
                if final or len(key) > 1_500_000:
                    held[kind] = ([], [])
                    yield from _emit(kind, key, n)
                else:
                    held[kind] = ([key], [n])

        nothing = np.empty(0, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield from add(0, gram_codes(part, at), np.repeat(learn[i:j], np.diff(at) + 1))
                h, row = word_hashes(part, at)
                taught = learn[i:j][row] > 0
                for kind, own in ((1, h[taught]), (2, h[~taught])):
                    yield from add(kind, own, np.ones(len(own), np.int64))
        for kind in (0, 1, 2):
            yield from add(kind, nothing, nothing, final=True)

    rows = documents.select(text_col, F.coalesce(F.col(train), F.lit(False)).alias("learn"))
    return rows.mapInArrow(count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _marginal(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context of ``order`` bytes, symbol), as sorted codes and their counts."""
    code = ((ctx & ((1 << (8 * order)) - 1)) << 8) | sym
    return _tally([code], [n])


def _level(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted codes, with their totals and numbers of symbols."""
    ctx = code >> 8
    new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, int)
    total = np.add.reduceat(n, new) if len(ctx) else n
    return ctx[new], total, np.diff(np.append(new, len(ctx)))


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def string_costs(code: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of the last byte of each six-byte string after the five before it.

    ``code``, ``n``: all strings whose contexts end in the same two bytes, and their training
    counts (0: to score alone). ``low``: sorted codes and counts of orders 0 and 1.
    """
    seen = n > 0
    ctx, sym = code[seen] >> 8, code[seen] & 255
    levels = [*low, *(_marginal(ctx, sym, n[seen], k) for k in range(2, ORDER + 1))]
    contexts = [_level(*level) for level in levels]
    ctx, sym = code >> 8, code & 255
    out = np.zeros(len(code))
    open_ = np.ones(len(code), bool)  # still escaping
    longer_d = longer_sum = np.zeros(len(code))  # symbols that the longer context had: how many, and their count here
    for k in range(ORDER, -1, -1):
        own, total, symbols = contexts[k]
        key = ctx & ((1 << (8 * k)) - 1)
        at, exists = _find(own, key)
        place, hit = _find(levels[k][0], (key << 8) | sym)
        hit &= exists
        have = np.where(exists, symbols[at], 0) if len(own) else np.zeros(len(key), np.int64)
        t = (np.where(exists, total[at], 0) if len(own) else 0) - longer_sum
        d = have - longer_d
        count = np.where(hit, levels[k][1][place] if len(own) else 0, 0)
        room = np.where(have < 256, d, 0)  # where all symbols have followed, nothing escapes
        use = open_ & (d > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(use & hit, np.log10(count / (t + room)), np.where(use, np.log10(room / (t + room)), 0.0))
        open_ &= ~(use & hit)
        if k:
            # of the symbols this context has seen: how often they follow the next shorter one
            shorter = _find(levels[k - 1][0], ((levels[k][0] >> 8 & ((1 << (8 * (k - 1))) - 1)) << 8) | (levels[k][0] & 255))[0]
            follow = levels[k - 1][1][shorter] if len(levels[k - 1][0]) else np.zeros(len(shorter))
            ends = np.cumsum(symbols)
            sums = np.concatenate([[0], np.cumsum(follow)])
            passed = sums[ends] - sums[ends - symbols] if len(own) else np.zeros(1)
            longer_sum = np.where(exists, passed[at] if len(own) else 0, 0)
            longer_d = have
        else:
            out += np.where(open_, -np.log10(np.maximum(1, 256 - have)), 0.0)
    return out


def cost_table(counts: DataFrame) -> DataFrame:
    """(code, cost) of every six-byte string: one task works on all strings whose contexts end in the same two bytes."""
    spark = counts.sparkSession
    strings = counts.where("kind = 0").select(F.col("key").alias("code"), "n", F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("pair"))
    # 65,536 rows at most
    rows = strings.where("n > 0").groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    one = rows.code.to_numpy(dtype=np.int64), rows.n.to_numpy(dtype=np.int64)
    none = _tally([one[0] & 255], [one[1]])
    sent = spark.sparkContext.broadcast([none, one])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve():
            table = pa.Table.from_batches(held)
            pair = table.column("pair").to_numpy()
            code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
            new = np.append(np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])), len(pair))
            for a, b in zip(new[:-1], new[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(code[a:b]), pa.array(string_costs(code[a:b], n[a:b], sent.value).astype(np.float32))], names=["code", "cost"])

        last = None
        for batch in batches:  # sorted by pair: whole pairs are solved as soon as the next one begins
            pair = batch.column(2).to_numpy()
            if not len(pair):
                continue
            if held and pair[0] != last:
                yield from solve()
                held.clear()
            last = pair[-1]
            cut = int(np.searchsorted(pair, last))
            if cut:
                held.append(batch.slice(0, cut))
                yield from solve()
                held.clear()
            held.append(batch.slice(cut))
        if held:
            yield from solve()

    return strings.repartition(2 * shuffle_partitions(spark), "pair").sortWithinPartitions("pair").mapInArrow(run, "code long, cost float")


def sorted_table(frame: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table as arrays sorted by key, fetched in parts so that the driver never holds it twice."""
    parts = 1 + frame.count() // COLLECT_ROWS
    keys, values = [], []
    for i in range(parts):
        part = frame.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).select(key, value).toArrow()
        keys.append(part.column(0).to_numpy())
        values.append(part.column(1).to_numpy())
    key_all, value_all = np.concatenate(keys).astype(np.int64), np.concatenate(values)
    order = np.argsort(key_all)
    return key_all[order], value_all[order]


def score_texts(documents: DataFrame, text_col: str = "text", train: str = "__train", table_rows: int = TABLE_ROWS) -> DataFrame:
    """The columns of ``documents`` (without text) with n_tokens, n_known, train_tokens, base_score, score.

    Rows with ``train`` true are learned from; all rows are scored. A column that is called like a new one is replaced.
    """
    spark = documents.sparkSession
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    counts = materialise(corpus_counts(documents, text_col, train), "corpus-counts")
    words = materialise(counts.where("kind > 0").groupBy(F.col("key").alias("h")).agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("all")), "words")
    occurrences = words.agg(F.sum("all")).first()[0] or 0
    frequent, frequent_n = sorted_table(words.where(F.col("all") * WORD_SHARE >= occurrences), "h", "c")  # WORD_SHARE rows at most
    costs = materialise(cost_table(counts), "string-costs")
    small = costs.count() <= table_rows
    sent = spark.sparkContext.broadcast((frequent, frequent_n, sorted_table(costs, "code", "cost") if small else None))  # table_rows rows at most
    columns = [c for c in documents.columns if c != text_col and c not in results]
    unique = columns + list(results)
    known, base, rare, strings, row_id = (fresh(c, unique) for c in ("known", "base", "rare", "strings", "row"))
    string = T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.IntegerType())])
    fields = [("n_tokens", T.LongType()), (known, T.LongType()), (base, T.DoubleType()), ("score", T.DoubleType()), (rare, T.ArrayType(T.LongType())), (strings, T.ArrayType(string))]
    schema = T.StructType([*(documents.schema[c] for c in columns), *(T.StructField(n, k) for n, k in fields)])

    def run(batches):
        words_at, words_n, costs_of = sent.value
        logs = np.log10(words_n + 0.1)
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(columns)))
            for i, j in slices(offsets, SCORE_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = j - i
                h, row = word_hashes(part, at)
                where, hit = _find(words_at, h)
                have = np.bincount(row[hit][words_n[where[hit]] > 0], minlength=n).astype(np.int64)
                sums = np.bincount(row[hit], weights=logs[where[hit]] if hit.any() else None, minlength=n).astype(float)
                code = gram_codes(part, at)
                length = np.diff(at) + 1
                first = np.cumsum(length) - length
                if costs_of is not None:
                    order = np.argsort(code)
                    value = np.empty(len(code))
                    value[order] = costs_of[1][_find(costs_of[0], code[order])[0]]
                    score = np.add.reduceat(value, first)
                    spelled = lists(np.zeros(n, int), pa.array([], pa.struct([("code", pa.int64()), ("times", pa.int32())])))
                else:
                    own = np.repeat(np.arange(n), length)
                    order = np.lexsort((code, own))
                    code, own = code[order], own[order]
                    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (own[1:] != own[:-1])]))
                    times = np.diff(np.append(new, len(code))).astype(np.int32)
                    score = np.zeros(n)
                    spelled = lists(np.bincount(own[new], minlength=n), pa.StructArray.from_arrays([pa.array(code[new]), pa.array(times)], names=["code", "times"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, n) for k in range(len(columns))), pa.array(np.bincount(row, minlength=n) + 1), pa.array(have), pa.array(sums), pa.array(score), lists(np.bincount(row[~hit], minlength=n), pa.array(h[~hit])), spelled], names=[f.name for f in schema.fields])

    rows = materialise(documents.select(*columns, text_col).mapInArrow(run, schema).withColumn(row_id, F.monotonically_increasing_id()), "scored")
    # all other words are rare: none makes up one in WORD_SHARE of all words
    loose = rows.select(row_id, F.explode(rare).alias("h")).join(words, "h")
    sums = loose.groupBy(row_id).agg(F.sum(F.log10(F.col("c") + 0.1)).alias("b"), F.sum((F.col("c") > 0).cast("long")).alias("k"))
    totals = rows.agg(F.sum(F.when(F.col(train), F.col("n_tokens"))).alias("n"), F.sum(F.col(train).cast("long")).alias("docs")).first()
    n_train, ends = int(totals["n"] or 0), int(totals["docs"] or 0)
    v = words.where("c > 0").count() + (ends > 0)
    log_all = float(np.log10(n_train + 0.1 * (v + 1)))
    sums = sums.select(F.col(row_id).alias(row_id + "b"), F.col("b").alias(base + "b"), F.col("k").alias(known + "b"))
    found = rows.join(sums, F.col(row_id) == F.col(row_id + "b"), "left")
    score = F.col("score")
    if not small:
        spelled = rows.select(F.col(row_id).alias(row_id + "s"), F.explode(strings).alias("s")).select(row_id + "s", "s.*").join(costs, "code")
        found = found.join(spelled.groupBy(row_id + "s").agg(F.sum(F.col("cost") * F.col("times")).alias(base + "s")), F.col(row_id) == F.col(row_id + "s"), "left")
        score = F.col(base + "s")
    return found.select(
        *columns,
        "n_tokens",
        (F.col(known) + F.coalesce(known + "b", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col(base) + F.coalesce(base + "b", F.lit(0.0)) + F.lit(float(np.log10(ends + 0.1))) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        score.alias("score"),
    )


def op9_lm(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.coalesce(crc_mod("doc_id", 10) != 0, F.lit(False))
    scored = score_texts(documents.select("doc_id", "text", train.alias("__train"), F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
