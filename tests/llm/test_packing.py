"""op11: ids against the tokenizer itself, bins against a plain best fit, and the round trip."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docgraph.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
SCHEMA = "doc_id long, text string, piece int, unit long, start string, length long"


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


TEXTS = [None, "", " \n\t", "The quick Brown fox, don't!", "it''s 's 'S 'LL we'Re 'story", "a\x1cb \x85 \xa0c d\x0be\x0cf", "J̌ J̌, é! É? é.", "ΣΑΣ. ΟΔΟΣ ΣΣ", "İstanbul Iı. ß? ñ:", "漢字かな。交じり 한국어!? ไทย๑๒", "x≮ .̸ !̸", "１２ ½ ٣٤ 12,5", "<|endoftext|> <|startoftext|>a", "😀👍🏽 — … ,.;:!?", "word" * 3000, "́, á́."]


def test_ids_are_those_of_the_tokenizer():
    ids = pk.TokenIds(PATH)
    for _ in range(2):  # the second time from memory
        for t in TEXTS:
            assert np.frombuffer(ids.of((t or "").encode()), "<u4").tolist() == plain_ids(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("aBcéÉßΣ .,;!?'\n\t12<|>́"))), max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(pk._ids_of(PATH).of(text.encode()), "<u4").tolist() == plain_ids(text)


def test_long_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(pk, "STRETCH_BYTES", 50)
    monkeypatch.setattr(pk, "STRETCHES_HELD", 20)
    monkeypatch.setattr(pk, "PARTS_HELD", 10)
    monkeypatch.setattr(pk, "LONG", 8)
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("abcdéxyz.'") for _ in range(rnd.randint(1, 12))) for _ in range(800)) + "z" * 300
    assert np.frombuffer(pk.TokenIds(PATH).of(text.encode()), "<u4").tolist() == plain_ids(text)


def test_a_tokenizer_with_leading_spaces_reads_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids = pk.TokenIds(path)
    assert not ids.apart and pk.TokenIds(PATH).apart
    for t in TEXTS:
        assert np.frombuffer(ids.of((t or "").encode()), "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def plain_best_fit(lengths, capacity, most):
    """(bin, offset) by looking at every open bin."""
    open_, made, out = [], 0, []  # (free, order opened or touched, bin)
    for tick, n in enumerate(lengths):
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[1]))
            open_.remove(b)
        else:
            if len(open_) == most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
            b = (capacity, 0, made)
            made += 1
        out.append((b[2], capacity - b[0]))
        if b[0] > n:
            open_.append((b[0] - n, tick, b[2]))
    return out


@pytest.mark.parametrize(("capacity", "most"), [(30, 3), (100, 8), (2048, 1)])
def test_bitset_finds_the_best_fit(capacity, most):
    rnd = random.Random(capacity)
    lengths = [rnd.randint(1, capacity) if rnd.random() < 0.5 else rnd.randint(1, max(1, capacity // 6)) for _ in range(1500)]
    bins = pk.OpenBins(capacity, most)
    assert [bins.place(n) for n in lengths] == plain_best_fit(lengths, capacity, most)


def documents(spark, n=150, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeilmnorst") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(int(rnd.paretovariate(1.1) * 4) % 900 + 1))) for i in range(n)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(7, rows[7][1])] * 5 + [(None, "copy of one text")] * 60
    return rows, spark.createDataFrame([(*r, 5, 6, "s", 7) for r in rows], SCHEMA).repartition(3)


def check_pieces(rows, found, capacity):
    """Every document's ids once, whole sequences without gaps; returns how many sequences there are."""
    want = defaultdict(int)
    for i, text in rows:
        data = np.array([*plain_ids(text), 0], "<u4").tobytes()
        for p, at in enumerate(range(0, len(data), 4 * capacity)):
            part = data[at : at + 4 * capacity]
            want[i, p, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    got, held = defaultdict(int), defaultdict(list)
    for r in found:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize(("capacity", "open_bins", "part_pieces"), [(2048, 128, 16384), (64, 4, 32), (16, 2, 8)])
def test_pieces_fill_sequences(spark, capacity, open_bins, part_pieces):
    rows, df = documents(spark)
    found = pk.pack_documents(df, PATH, capacity, open_bins=open_bins, part_pieces=part_pieces).collect()
    n = check_pieces(rows, found, capacity)
    assert n <= 1.1 * math.ceil(sum(r.length for r in found) / capacity) + open_bins


def test_sequences_hold_the_ids(spark):
    rows, df = documents(spark, 40)
    seen = defaultdict(list)
    for s in pk.packed_sequences(df, PATH, 128, open_bins=4, part_pieces=32).collect():
        assert len(s.ids) == sum(p.length for p in s.pieces) <= 128
        for p in s.pieces:
            seen[p.doc_id, p.piece].append(tuple(s.ids[p.offset : p.offset + p.length]))
    for i, text in rows:
        ids = [*plain_ids(text), 0]
        for p in range(0, len(ids), 128):
            assert tuple(ids[p : p + 128]) in seen[i, p // 128]


def test_query_on_hostile_and_empty_tables(spark, tmp_path):
    rows, df = documents(spark, 60)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    check_pieces(rows, pk.op11_packing(spark, f"{tmp_path}/a").collect(), 2048)
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pk.op11_packing(spark, f"{tmp_path}/b").collect() == []
