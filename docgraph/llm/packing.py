"""Best-fit packing of tokenised documents into sequences, online and in bounded space.

Documents become token ids with an end id after each; those longer than a sequence are cut
into full pieces and a rest. Pieces stream, in the order of a hash, through packers that keep
a fixed number of bins open. A bitset over free space names the open bins: the best fit of a
piece is the lowest set bit at its length or above. Where none fits and all places are taken,
the fullest bin closes for a new one. Pieces are dealt over parts of about ``PART_PIECES``, one
packer each; bins still open when a part ends are packed once more as pieces of their own,
in ever fewer parts until one is left, so parts cost no space. Full pieces are sequences as
they are and are not shuffled.

Tokens of a text are those of its stretches without ASCII white space, one after the other:
the tokenizer's pattern never matches white space and its normaliser composes nothing across
it. Each worker keeps the ids of the stretches it has met, ``STRETCHES_HELD`` and as many of their words.

Edge cases: null text reads as empty; an empty text is the end id alone; names of special
tokens in a text are ordinary text; equal rows are packed one by one, whatever their ids; an
empty table gives an empty result; only the id and text columns are read. Sequence ids are
unique, not gapless.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import materialise, shuffle_partitions

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 128
PART_PIECES = 16_384
#: What a worker remembers: entries of some 150 bytes for words of natural length.
STRETCHES_HELD = 1 << 19
PARTS_HELD = 1 << 20
LONG = 100  # bytes; longer stretches are not remembered
STRETCH_BYTES = 1 << 20  # text that is cut into stretches at once
_SPACE = re.compile(rb"[ \t-\r]")
#: The tokenizer's own pattern, for lower-cased ASCII.
_ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, stretch by stretch, remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.whole: dict[bytes, bytes] = {}  # of stretches
        self.parts: dict[bytes, bytes] = {}  # of words and marks in them
        # a tokenizer whose words depend on what stands around them reads whole texts
        proof = "It's The cat,an\tx2 élan. (Ab)"
        self.apart = self.of(proof.encode()) == _packed(self._whole(proof))

    apart = True

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def cut(stretch: bytes) -> list[bytes]:
        """The stretch in parts whose ids are independent of each other: all words of an ASCII one, else what follows a last letter."""
        if stretch.isascii():
            return _ASCII_WORD.findall(stretch.lower())
        body = stretch.rstrip(b".,;:!?")
        if len(body) < len(stretch):
            last = body[-2:].decode(errors="ignore")[-1:]
            if last.isalpha() and ord(last) < 0x600:
                return [body, stretch[len(body) :]]
        return [stretch]

    def learn(self, stretches: set[bytes]) -> None:
        if len(self.parts) > PARTS_HELD:
            self.parts = {}
        new = [(s, self.cut(s)) for s in stretches]
        found = {p for _, cut in new for p in cut}
        parts = [p for p in found if p not in self.parts]
        # words of a-z pass the normaliser and the byte alphabet as they are
        word = [p for p in parts if p.isalpha() and p.isascii() and p.islower()]
        tokenize = self.tokenizer.model.tokenize
        for p in word:
            self.parts[p] = _packed([t.id for t in tokenize(p.decode())])
        rest = [p for p in parts if p not in self.parts]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
            self.parts[p] = _packed(e.ids)
        for s, cut in new:
            self.whole[s] = b"".join([self.parts[p] for p in cut])
        for p in parts:
            if len(p) > LONG:
                del self.parts[p]

    def of(self, raw: bytes) -> bytes:
        if not self.apart:
            return _packed(self._whole(raw.decode()))
        out, at = [], 0
        while at < len(raw):
            end = len(raw)
            if end - at > STRETCH_BYTES and (space := _SPACE.search(raw, at + STRETCH_BYTES)):
                end = space.end()
            words = raw[at:end].split()
            found = list(map(self.whole.get, words))
            missing = [i for i, x in enumerate(found) if x is None]
            if missing:
                if len(self.whole) > STRETCHES_HELD:
                    self.whole = {}
                self.learn({words[i] for i in missing})
                for i in missing:
                    found[i] = self.whole[words[i]]
                for i in missing:
                    if len(words[i]) > LONG:
                        self.whole.pop(words[i], None)
            out += found
            at = end
        return b"".join(out)


_TOKENISERS: dict[str, TokenIds] = {}


def _ids_of(path: str) -> TokenIds:
    """One per worker process, which serves many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core
    if path not in _TOKENISERS:
        _TOKENISERS[path] = TokenIds(path)
    return _TOKENISERS[path]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(unit, id, piece, start, length, ids_crc32) of every document's pieces; ``with_ids`` adds their ids. ``unit`` numbers the pieces."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids = _ids_of(tokenizer_path)
        unit = TaskContext.get().partitionId() << 38
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            names = batch.column(0)

            def close(rows=rows, names=names):
                columns = list(zip(*rows, strict=True)) or [()] * 7
                arrays = [pa.array(columns[0], pa.int64()), names.take(pa.array(columns[1], pa.int64())), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[3:6])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in columns[6]], pa.list_(pa.int64())))
                return pa.RecordBatch.from_arrays(arrays, names=["unit", "id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                data = ids.of(raw) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((unit, i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                    unit += 1
                size += len(data)
                if with_ids and size > (8 << 20):
                    yield close()
                    rows.clear()
                    size = 0
            yield close()

    schema = f"unit long, id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return source.mapInArrow(run, schema)


class OpenBins:
    """Best fit over a fixed number of open bins, found by a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if some open bin has f places left
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.free >> length
        if fits:
            space = (fits & -fits).bit_length() - 1 + length
            found = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            found, space = self.made, self.capacity
            self.made += 1
        left = space - length
        if left:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(found)
            self.open += 1
        return found, self.capacity - space

    def still_open(self) -> list[tuple[int, int]]:
        """(bin, fill) of the bins with room."""
        return [(b, self.capacity - space) for space, held in enumerate(self.bins) for b in held]


def pack_parts(units: DataFrame, parts: int, level: int, capacity: int, open_bins: int) -> DataFrame:
    """(unit, sequence, offset, fill) of units (unit, length); ``fill`` is over 0 where the bin was still open at the end of its part."""

    def run(batches):
        now, unit, length = None, [], []

        def close():
            bins = OpenBins(capacity, open_bins)
            placed = np.array([bins.place(x) for x in length], np.int64).reshape(-1, 2)
            fill = np.zeros(bins.made, np.int64)
            for b, n in bins.still_open():
                fill[b] = n
            first = (level << 58) | (now << 20)
            return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(placed[:, 0] + first), pa.array(placed[:, 1]), pa.array(fill[placed[:, 0]])], names=["unit", "sequence", "offset", "fill"])

        for batch in batches:
            for part, u, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if unit:
                        yield close()
                    now, unit, length = part, [], []
                unit.append(u)
                length.append(n)
        if unit:
            yield close()

    dealt = units.select(F.pmod(F.xxhash64("unit"), F.lit(parts)).alias("part"), "unit", "length")
    tasks = max(1, min(parts, 4 * shuffle_partitions(units.sparkSession)))
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", F.xxhash64(F.lit(1), F.col("unit")), "unit")
    return dealt.select("part", "unit", "length").mapInArrow(run, "unit long, sequence long, offset long, fill long")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, part_pieces: int = PART_PIECES) -> DataFrame:
    """(unit, sequence_id, offset) of every piece; ``pieces`` (unit, length) should be a stored table, as it is read twice."""
    if not 0 < open_bins < part_pieces < 1 << 20:
        raise ValueError("open bins must be fewer than the pieces of a part, and those fewer than 2^20")
    whole = pieces.where(F.col("length") == capacity).select("unit", F.col("unit").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    units, level, packed = pieces.where(F.col("length") < capacity).select("unit", "length"), 0, []
    while True:
        parts = -(-units.count() // part_pieces)
        packed.append(materialise(pack_parts(units, max(parts, 1), level, capacity, open_bins), "packed"))
        if parts <= 1:
            break
        # bins left open are pieces of the next level; each holds one unit at offset 0
        units = packed[-1].where("fill > 0 and offset = 0").select(F.col("sequence").alias("unit"), F.col("fill").alias("length"))
        level += 1
    moves = None  # where bins left open went: (sequence, into, shift)
    for table in reversed(packed[1:]):
        step = table.select(F.col("unit").alias("sequence"), F.col("sequence").alias("into"), F.col("offset").alias("shift"))
        if moves is not None:
            later = moves.select(F.col("sequence").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            step = step.join(later, "into", "left").select("sequence", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = step
    done = packed[0].select("unit", F.col("sequence").alias("sequence_id"), "offset", "fill")
    if moves is not None:
        left = done.where("fill > 0").join(moves.withColumnRenamed("sequence", "sequence_id"), "sequence_id").select("unit", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
        done = done.where("fill = 0").drop("fill").unionByName(left)
    return whole.unionByName(done.select("unit", "sequence_id", "offset"))


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, part_pieces: int = PART_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    pieces = materialise(token_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    placed = place_pieces(pieces, capacity, open_bins, part_pieces)
    return pieces.join(placed, "unit").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, part_pieces: int = PART_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: (sequence_id, ids, pieces), ``pieces`` = (id, piece, offset, length) in order of their places."""
    pieces = materialise(token_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col, with_ids=True), "pieces")
    rows = pieces.join(place_pieces(pieces, capacity, open_bins, part_pieces), "unit")
    held = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "length", "ids"))).alias("p"))  # capacity ids a sequence
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"))
