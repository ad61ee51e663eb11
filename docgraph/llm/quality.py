"""Quality classifier: a byte-level convolutional network in numpy.

Each learned filter is a table of weights per byte value and position. Filters run
over every position of a document; each overlapping chunk of 256 bytes (step 128)
keeps its largest response per filter. The mean and the maximum over the chunks feed
a small dense layer that gives one probability. Training fits the whole texts of a bounded
number of labelled rows on the driver, pooled as in scoring; scoring streams whole texts
through Arrow batches. Either way a text of any length passes through in pieces.

Edge cases: a null text reads as empty; an empty text gets the score of a document
whose chunks are all silent; a row with null id is scored, never learned from, and
counts as not held out. Ties and repeated rows get equal scores. An empty label table
gives the constant 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import crc_mod, fresh, slices, text_buffer

BLOCK = 128  # a chunk is two neighbouring blocks
PIECE = 4096  # blocks whose responses are held at once


@dataclass
class ConvNet:
    """Weights: ``table[j, byte, filter]``, bias per filter, dense weights of mean and max, dense bias."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float

    @property
    def width(self) -> int:
        return self.table.shape[0]


def pad_blocks(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each document zero-padded to whole blocks (``width - 1`` zeros at least), and blocks per document.

    Everything is moved by ``width - 1`` places: a filter at place i covers the bytes up to i, and the
    zeros that end a document stand before the next one.
    """
    sizes = np.diff(offsets)
    blocks = (sizes + width - 1 + BLOCK - 1) // BLOCK
    starts = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
    out = np.zeros(int(starts[-1]) + width, np.uint8)
    shift = np.repeat(starts[:-1] - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift + width - 1] = data
    return out, blocks


def responses(padded: np.ndarray, net: ConvNet) -> np.ndarray:
    """Filter responses at every position, [positions, filters]."""
    n = len(padded) - net.width
    total = np.take(net.table[0], padded[:n], axis=0)
    part = np.empty_like(total)
    for j in range(1, net.width):
        np.take(net.table[j], padded[j : n + j], axis=0, out=part, mode="clip")
        total += part
    return total


def block_peaks(padded: np.ndarray, net: ConvNet) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each block per filter, and its position; a piece of the text at a time."""
    blocks = (len(padded) - net.width) // BLOCK
    filters = net.table.shape[2]
    peaks, where = np.empty((blocks, filters), np.float32), np.empty((blocks, filters), np.int64)
    for i in range(0, blocks, PIECE):
        j = min(blocks, i + PIECE)
        at = responses(padded[i * BLOCK : j * BLOCK + net.width], net).reshape(-1, BLOCK, filters)
        place = at.argmax(axis=1)
        peaks[i:j] = np.take_along_axis(at, place[:, None], axis=1)[:, 0]
        where[i:j] = place + (np.arange(i, j) * BLOCK)[:, None]
    return peaks, where


def chunk_peaks(block_peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak of each overlapping chunk (a block and the next one of its document), the block it comes from, and chunks per document."""
    first = np.cumsum(blocks) - blocks
    last = first + blocks - 1
    following = np.minimum(np.arange(len(block_peaks)) + 1, len(block_peaks) - 1)
    following[last] = last
    later = block_peaks[following] > block_peaks
    source = np.where(later, following[:, None], np.arange(len(block_peaks))[:, None])
    keep = np.ones(len(block_peaks), bool)
    keep[last[blocks > 1]] = False
    source = source[keep]
    return np.take_along_axis(block_peaks, source, axis=0), source, np.maximum(blocks - 1, 1)


def pooled(peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and maximum over the chunks of each document, [documents, 2 x filters]; chunk peaks, their blocks, chunks per document."""
    chunks, source, count = chunk_peaks(peaks, blocks)
    first = np.cumsum(count) - count
    mean = np.add.reduceat(chunks, first, axis=0) / count[:, None]
    top = np.maximum.reduceat(chunks, first, axis=0)
    return np.concatenate([mean, top], axis=1), chunks, source, count


def forward(net: ConvNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each document."""
    padded, blocks = pad_blocks(data, offsets, net.width)
    peaks = np.maximum(block_peaks(padded, net)[0] + net.bias, 0)
    z = pooled(peaks, blocks)[0] @ net.dense + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batches(order: np.ndarray, sizes: np.ndarray, rows: int, size: int):
    """Consecutive rows of ``order``: ``rows`` at most and about ``size`` bytes, one row at least."""
    now, held = [], 0
    for r in order:
        if now and (len(now) == rows or held + sizes[r] > size):
            yield np.array(now)
            now, held = [], 0
        now.append(r)
        held += sizes[r]
    if now:
        yield np.array(now)


def train(texts: list[bytes], labels: np.ndarray, filters: int = 8, width: int = 5, epochs: int = 5, seed: int = 7) -> ConvNet:
    """Fit the network by Adam on weighted cross-entropy; each epoch sees each whole text once."""
    rng = np.random.default_rng(seed)
    net = ConvNet((rng.normal(size=(width, 256, filters)) * 0.3).astype(np.float32), np.zeros(filters, np.float32), (rng.normal(size=2 * filters) * 0.3).astype(np.float32), 0.0)
    net.table[:, 0] = 0
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.dense[:] = 0
        net.offset = 0.0 if not len(labels) else float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        return net
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    params = [net.table, net.bias, net.dense, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    sizes = np.array([len(t) for t in texts])
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for rows in _batches(rng.permutation(len(texts)), sizes, 32, 1 << 20):
            parts = [np.frombuffer(texts[r], np.uint8) for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            padded, blocks = pad_blocks(np.concatenate(parts), offsets, width)
            raw, where = block_peaks(padded, net)
            peaks = np.maximum(raw + net.bias, 0)
            x, chunks, source, count = pooled(peaks, blocks)
            p = 1 / (1 + np.exp(-np.clip(x @ net.dense + params[3][0], -30, 30)))
            d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dx = d[:, None] * net.dense
            owner = np.repeat(np.arange(len(rows)), count)
            is_top = chunks == x[owner, filters:]
            ties = np.maximum(np.add.reduceat(is_top, np.cumsum(count) - count, axis=0, dtype=np.float32), 1)
            dchunk = dx[owner, :filters] / count[owner, None] + dx[owner, filters:] * is_top / ties[owner]
            # a chunk's gradient goes to the block its peak comes from, and from there to the bytes under the filter
            column = np.broadcast_to(np.arange(filters), source.shape)
            dpeak = np.zeros_like(peaks)
            np.add.at(dpeak, (source, column), dchunk)
            dpeak *= raw + net.bias > 0
            at, f = np.nonzero(dpeak)
            dtable = np.zeros_like(net.table)
            for j in range(width):
                np.add.at(dtable[j], (padded[where[at, f] + j], f), dpeak[at, f])
            dtable[:, 0] = 0
            step += 1
            for value, grad, (m, v) in zip(params, (dtable, dpeak.sum(0), x.T @ d, np.array([d.sum()], np.float32)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.offset = float(params[3][0])
    return net


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, **options) -> ConvNet:
    """Fit on the whole texts of a bounded sample of labelled rows, which the driver holds.

    ``max_rows`` rows at most are taken, half of each class where there are enough, in the order of a
    hash of the id. Rows whose crc32(doc_id) mod 5 is 0 are left out.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod("doc_id", 5) != 0))
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("quality") == value).orderBy(h, "doc_id").limit(max_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")  # max_rows rows of two numbers
        .select(F.col("quality").cast("int").alias("quality"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
        .orderBy("h", "text")
        .limit(max_rows)
        .collect()
    )
    return train([r.text.encode() for r in rows], np.array([r.quality for r in rows]), **options)


def score_quality(documents: DataFrame, net: ConvNet, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """Probability of good quality for each whole text, as ``score_col``; ``keep`` names further columns to carry along."""
    columns = [c for c in dict.fromkeys([id_col, *(keep or [])]) if c != score_col]
    carried = documents.select(*columns, F.col(text_col).alias(fresh("text", columns)))
    schema = T.StructType([*carried.select(*columns).schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(columns)))
            score = np.zeros(batch.num_rows)
            for i, j in slices(offsets, 1 << 20):
                score[i:j] = forward(net, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array(score)], names=[*columns, score_col])

    return carried.mapInArrow(run, schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(documents, fit_quality(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
