"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere.

Exact texts are collapsed first (a copied text is covered whole). Every 200-byte window of
a text is owned by one anchor: the leftmost place of the smallest k-gram hash in it, which
depends on the window's bytes alone, so equal windows meet at equal anchor hashes. The
windows of one anchor form a segment. Anchor hashes that occur once cannot repeat and go;
identical segments repeat whole; the other segments of an anchor hash come together in
suffix-array shards, where induced sorting and permuted common prefixes decide each window
exactly. An anchor hash with very many different segments is cut into narrower segments
keyed by their common core, and at last into single windows, so no shard is unbounded.
Where bytes stand for each other by hash (equal segments, equal narrow parts, single
windows) two 64-bit hashes must agree: the anchor's or group's, and one of all bytes.

Edge cases: null text reads as empty; texts shorter than the minimum length keep all bytes;
repeated rows are copies of each other; an empty table gives an empty result; one text
against itself counts (a string repeated inside one document is removed).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import join_hot, materialise, new_path, ranges, shuffle_partitions, slices, text_buffer
from docgraph.llm.suffix_array import permuted_lcp, suffix_array

MIN_BYTES = 200
GRAM = 32
PIECE = 2 << 20  # longer texts are read in pieces that overlap by one window
PLACE_BITS = np.uint64(26)
SHARD_BYTES = 512 << 10
GROUP_LIMIT = 1024  # segments of one anchor hash in one shard
NARROW = 16  # windows of a narrower segment

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class RollingHash:
    """Polynomial hashes of any substring of a buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_B_INV), np.uint64)]))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(_B), np.uint64)]))[:n]
        self.run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.run[end] - self.run[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.run[k:] - self.run[:-k]) * self.inverse[: len(self.run) - k])


def owned_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first window, last window, anchor hash, segment hash) for texts ``data[starts[i]:ends[i]]``."""
    span = length - GRAM + 1
    ok = ends - starts >= length
    count = np.where(ok, ends - starts - length + 1, 0)
    windows = ranges(starts, count)
    if not len(windows):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),) * 2
    rolling = RollingHash(data)
    gram = rolling.grams(GRAM)
    n = len(gram)
    packed = (gram & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(n, dtype=np.uint64)
    # sliding minimum over `span` places by block prefixes and suffixes
    blocks = -(-n // span) + 1
    wide = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = packed
    table = wide.reshape(blocks, span)
    prefix = np.minimum.accumulate(table, axis=1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suffix[windows], prefix[windows + span - 1])
    anchor = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    piece = np.repeat(np.arange(len(starts)), count)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.append(new[1:], len(windows)) - 1
    first_w, last_w, at = windows[new], windows[last], anchor[new]
    content = rolling.of(first_w, last_w + length) + (at - first_w).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return piece[new], at, first_w, last_w, gram[at], _mix(content)


def text_pieces(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of pieces of at most PIECE bytes that overlap by ``length - 1``: each window is in exactly one."""
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-np.maximum(size - length + 1, 1) // PIECE))
    row = np.repeat(np.arange(len(size)), pieces)
    k = ranges(np.zeros(len(size), np.int64), pieces)
    start = offsets[:-1][row] + k * PIECE
    return row, start, np.minimum(start + PIECE + length - 1, offsets[1:][row])


def _segments_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """Yields (row, anchor, first, last window, hashes) of whole texts, positions counted from the text's start."""
    row, start, end = text_pieces(offsets, length)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        base = start[i]
        piece, at, lo, hi, fp, seg = owned_segments(data[base : end[j - 1]], start[i:j] - base, end[i:j] - base, length)
        own = row[i:j][piece]
        shift = base - offsets[:-1][own]
        yield own, at + shift, lo + shift, hi + shift, fp, seg
        i = j


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(fp, seg, k, at, lo, hi, many) for each anchor; ``many`` marks texts that occur more than once."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            key = batch.column(0).to_numpy()
            many = batch.column(2).to_numpy() > 1
            for own, at, lo, hi, fp, seg in _segments_of(data, offsets, length):
                for i in range(0, len(own), 100_000):
                    s = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[s].view(np.int64)), pa.array(seg[s].view(np.int64)), pa.array(key[own[s]]), pa.array(lo[s].astype(np.int32)), pa.array((hi - lo)[s].astype(np.int16)), pa.array((at - lo)[s].astype(np.int16)), pa.array(many[own[s]])],
                        names=["fp", "seg", "k", "lo", "more", "off", "many"],
                    )

    return texts.select("k", "text", "n").mapInArrow(run, "fp long, seg long, k long, lo int, more short, off short, many boolean")


def anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """(fp, n) of the anchor hashes that occur at least twice, by counting (fp, n) of each Arrow batch first."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            many = batch.column(2).to_numpy() > 1
            for own, _, _, _, fp, _ in _segments_of(data, offsets, length):
                order = np.argsort(fp)
                sorted_fp = fp[order]
                new = np.flatnonzero(np.concatenate([[True], sorted_fp[1:] != sorted_fp[:-1]])) if len(fp) else np.empty(0, int)
                n = np.add.reduceat(1 + many[own][order].astype(np.int64), new) if len(fp) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(sorted_fp[new].view(np.int64)), pa.array(n.astype(np.int32))], names=["fp", "n"])

    return texts.select("k", "text", "n").mapInArrow(run, "fp long, n int").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment of one shard, which of its windows start a string that starts in another place of the shard too.

    Segments are joined with separators that no match can cross; one suffix array of the shard decides all.
    """
    parts, starts, n = [], [], 0
    for raw in segments:
        starts.append(n)
        parts += [np.frombuffer(raw, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
        n += len(raw) + 1
    data = np.concatenate(parts)
    # a separator reads as 0xFF, which never occurs in UTF-8
    lcp, phi = permuted_lcp(np.where(data == 0, 255, data - 1).astype(np.uint8), suffix_array(data))
    twice = lcp >= length
    twice[phi[twice]] = True
    return [twice[s : s + max(0, len(raw) - length + 1)] for s, raw in zip(starts, segments, strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SEGMENT = "grp long, fp long, seg long, base int, raw binary"
FOUND = "fp long, seg long, a int, b int"


def resolve_shards(segments: DataFrame, length: int) -> DataFrame:
    """Suffix-array shards: rows of one group stay together, many groups share a shard. Returns repeated window runs [a, b)."""

    def solve(groups):
        flat = [x for g in groups for x in g]
        masks = repeated_windows([raw for *_, raw in flat], length)
        return [(fp, seg, base + a, base + b) for (fp, seg, base, _), mask in zip(flat, masks, strict=True) for a, b in _runs(mask)]

    def run(batches):
        groups, size, last = [], 0, None
        out: list[tuple] = []
        for batch in batches:
            for grp, fp, seg, base, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != last:
                    if size >= SHARD_BYTES:
                        out += solve(groups)
                        groups, size = [], 0
                    groups.append([])
                    last = grp
                groups[-1].append((fp, seg, base, raw))
                size += len(raw)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if groups:
            out += solve(groups)
        yield _batch(out)

    return segments.repartition(4 * shuffle_partitions(segments.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(run, FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["fp", "seg", "a", "b"])


def narrow(segments: DataFrame, length: int, width: int) -> DataFrame:
    """Cut segments into ones of ``width`` windows at most, regrouped by anchor hash, place and common core."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, fp, seg, base, off, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                windows = len(raw) - length + 1
                # places are counted from the anchor, so that cuts agree between segments
                first = (off - base) // width
                for block in range(first, (off - base - windows + 1) // width - 1, -1):
                    lo, hi = max(0, off - base - block * width - width + 1), min(windows - 1, off - base - block * width)
                    if lo <= hi:
                        part = raw[lo : hi + length]
                        whole = off - base - block * width
                        core = raw[whole : whole - width + 1 + length]  # lies in every window of the block
                        name = hashlib.blake2b(core + b"%d %d" % (fp, block), digest_size=8).digest()
                        rows.append((int.from_bytes(name, "little", signed=True), fp, seg, base + lo, off, part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "fp", "seg", "base", "off", "raw"])

    return segments.mapInArrow(run, "grp long, fp long, seg long, base int, off int, raw binary")


def distinct_texts(documents: DataFrame, text_col: str) -> DataFrame:
    """One row per different text (k, text, n), bucketed by k in the shared folder: later joins on k move no text.

    k is 64 bits of the md5 of the text. The catalog keeps no entry: the table is dropped once
    its files are known, which leaves the files.
    """
    spark = documents.sparkSession
    path = new_path(spark, "texts")
    name = "docgraph_texts_" + path.rsplit("-", 1)[-1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    (
        documents.select(text_key(text).alias("k"), text.alias("text"))
        .groupBy("k")
        .agg(F.first("text").alias("text"), F.count("*").alias("n"))
        .write.bucketBy(max(8, shuffle_partitions(spark)), "k")
        .option("path", path)
        .saveAsTable(name)
    )
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def text_key(text):
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def repeated_spans(texts: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """(k, spans) with every byte range [a, b) covered by a repeated string; ranges may touch or overlap."""
    # hash-repeated anchors only
    counted = materialise(anchor_counts(texts, length), "anchor-counts")
    common = materialise(join_hot(anchor_rows(texts, length), counted, ["fp"], "n", ["k", "lo"]).drop("n"), "anchors")
    twin = F.sum(F.when(F.col("many"), 2).otherwise(1))
    segs = materialise(common.groupBy("fp", "seg").agg(twin.alias("m"), F.min(F.struct("k", "lo", "more", "off")).alias("rep")), "segments")
    # anchors with more than one kind of segment, where some segment is single, need the suffix arrays
    groups = materialise(segs.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    open_ = join_hot(segs, groups, ["fp"], "kinds", ["seg"])
    fetch = open_.select("fp", "seg", "kinds", "rep.*").groupBy("k").agg(F.collect_list(F.struct("fp", "seg", "kinds", "lo", "more", "off")).alias("want"))

    def cut(batches):
        for batch in batches:
            rows = []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                rows += [(w["fp"], w["fp"], w["seg"], 0, w["off"], w["kinds"], raw[w["lo"] : w["lo"] + w["more"] + length]) for w in want]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "fp", "seg", "base", "off", "kinds", "raw"])

    cutting = texts.select("k", "text").join(fetch, "k").select("text", "want").mapInArrow(cut, "grp long, fp long, seg long, base int, off int, kinds long, raw binary")
    cutting = materialise(cutting, "open-segments")
    plain = cutting.where(F.col("kinds") <= GROUP_LIMIT).select("grp", "fp", "seg", "base", "raw")
    found = resolve_shards(plain, length)
    hot = cutting.where(F.col("kinds") > GROUP_LIMIT).select("grp", "fp", "seg", "base", "off", "raw")
    if hot.limit(1).count():
        thin = materialise(narrow(hot, length, NARROW), "narrow-segments")
        # equal parts repeat whole; the rest of a group is small, or cut once more into single windows
        hashed = thin.withColumn("h", F.xxhash64("raw"))
        kinds = hashed.groupBy("grp", "h").agg(F.count("*").alias("same"))
        kinds = materialise(join_hot(materialise(kinds, "parts"), materialise(kinds.groupBy("grp").agg(F.count("*").alias("kinds")), "part-kinds"), ["grp"], "kinds", ["h"]), "sized-parts")
        tagged = materialise(join_hot(hashed, kinds, ["grp", "h"], "same", ["fp", "seg", "base"]), "tagged-parts")
        whole = tagged.where("same > 1").select("fp", "seg", F.col("base").alias("a"), (F.col("base") + F.length("raw") - length + 1).alias("b"))
        single = tagged.where("same = 1 and kinds > 1 and kinds <= %d" % GROUP_LIMIT)
        shared = tagged.where("same > 1 and kinds > 1 and kinds <= %d" % GROUP_LIMIT).dropDuplicates(["grp", "h"])
        found = found.unionByName(whole).unionByName(resolve_shards(single.unionByName(shared).select("grp", "fp", "seg", "base", "raw"), length))
        last = narrow(tagged.where("kinds > %d" % GROUP_LIMIT).select("grp", "fp", "seg", "base", "off", "raw"), length, 1)
        last = materialise(last.select("grp", F.xxhash64("raw").alias("h"), "fp", "seg", "base"), "windows")
        twice = materialise(last.groupBy("grp", "h").agg(F.count("*").alias("n")).where("n > 1"), "repeated-windows")
        again = join_hot(last, twice, ["grp", "h"], "n", ["seg", "base"])
        found = found.unionByName(again.select("fp", "seg", F.col("base").alias("a"), (F.col("base") + 1).alias("b")))
    # identical segments repeat whole; single ones by what their shard found
    placed = common.select("fp", "seg", "k", "lo", "more", "many")
    twins = segs.where("m > 1").select("fp", "seg", "m")
    whole = join_hot(placed, twins, ["fp", "seg"], "m", ["k", "lo"]).select("k", F.col("lo").alias("a"), (F.col("lo") + F.col("more") + length).alias("b"))
    singles = segs.where("m = 1").select("fp", "seg", F.col("rep.k").alias("k"), F.col("rep.lo").alias("lo"))
    part = singles.join(found, ["fp", "seg"]).select("k", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + length - 1).alias("b"))
    return whole.unionByName(part).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def substring_dedup(documents: DataFrame, length: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) per row; ``removed`` are the byte runs taken out."""
    texts = distinct_texts(documents, text_col)
    spans = repeated_spans(texts, length)

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                buffer = text.as_buffer()
                raw = buffer.to_pybytes() if buffer else b""
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((key, len(raw), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    done = texts.select("k", "text").join(spans, "k", "left").mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
    keyed = documents.select(F.col(id_col), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("k"))
    return keyed.join(done, "k").drop("k")


def op8_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(documents).drop("removed")
