"""Registered queries and pipeline stages on one hostile table, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docgraph.llm import decontaminate as dc
from docgraph.llm import mixing as mx
from docgraph.llm import quality as ql
from docgraph.llm import sharding as sh
from docgraph.llm import urlfilter as uf
from docgraph.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, n_words long, host string, __text string, text_hash long, tk long, label int, size long"


def rows_of(seed=9):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abdegilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [text(rnd.randint(5, 90)) for _ in range(60)] + [None, "", " \n", text(2500), "漢字" * 300, "x"]
    texts += [texts[3]] * 12 + [texts[4] + " more"]
    rows = [(i, t, ["en", None, "fr"][i % 3], None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[8], "en", "s1"), (None, texts[8], "en", "s1"), (7, text(30), "en", "s2")]
    return [(*r, None, 0.5, "h", 9, "h.com", "t", 1, 2, 3, 4) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [(1, " ".join(rows[10][1].split()[:12])), (2, rows[11][1]), (2, rows[11][1]), (3, rows[11][1]), (4, None), (None, "x")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_score(net, text):
    """The network by plain loops over positions, blocks and chunks."""
    data = [*text.encode()]
    n_blocks = (len(data) + net.width - 1 + ql.BLOCK - 1) // ql.BLOCK
    data = [0] * (net.width - 1) + data + [0] * (n_blocks * ql.BLOCK + net.width)
    peaks = [[max(0.0, max(sum(float(net.table[j, data[p + j], f]) for j in range(net.width)) for p in range(b * ql.BLOCK, (b + 1) * ql.BLOCK)) + float(net.bias[f])) for f in range(net.table.shape[2])] for b in range(n_blocks)]
    chunks = np.array([np.maximum(a, b) for a, b in zip(peaks, peaks[1:], strict=False)] if n_blocks > 1 else peaks)
    z = float(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.dense) + net.offset
    return 1 / (1 + math.exp(-z))


def test_quality_query(spark, folder, rows):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = ql.fit_quality(docs, labels)
    assert np.abs(net.table).sum() > 0
    got = QUERIES["op1_quality"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t or "")
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
        if len(min(texts[r.doc_id], key=len)) < 700:
            assert any(abs(r.score - plain_score(net, t)) < 1e-4 for t in texts[r.doc_id])


def test_long_texts_pass_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    net = ql.ConvNet(rng.normal(size=(5, 256, 3)).astype(np.float32), np.zeros(3, np.float32), rng.normal(size=6).astype(np.float32), 0.1)
    data = rng.integers(1, 256, 5000).astype(np.uint8)
    whole = ql.forward(net, data, np.array([0, 700, 5000]))
    monkeypatch.setattr(ql, "PIECE", 3)
    assert ql.forward(net, data, np.array([0, 700, 5000])) == pytest.approx(whole)


def test_sharding_query_keeps_groups_and_balance(spark, folder, rows):
    out = QUERIES["op3_sharding"](spark, folder).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(sizes) <= set(range(24))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    # copies weigh less than a shard: they stay together
    target = sum(sizes.values()) / 24
    for (crc, size), n in Counter((r.text_crc32, r.size) for r in out).items():
        if n * size <= target:
            assert len({r.shard for r in out if (r.text_crc32, r.size) == (crc, size)}) == 1


def test_groups_are_split_only_without_room():
    dealt, room = sh.place_heavy([(1, 10, 30), (2, 10, 5), (3, 10, 6)], 4, 110.0)
    assert [d for d in dealt if d[0] == 2] == [(2, 10, 0.0, 1.0, dealt[-1][4])] and sum(1 for d in dealt if d[0] == 1) == 3
    assert all(r >= 0 for r in room) and sum(room) == pytest.approx(440 - 410)
    parts = [d for d in dealt if d[0] == 1]
    assert parts[0][2] == 0 and parts[-1][3] == pytest.approx(1) and all(a[3] == b[2] for a, b in zip(parts, parts[1:], strict=False))


def test_balance_with_heavy_groups(spark):
    table = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 < 3 then 'the same text in a third of all rows' when id % 10 = 3 then concat('group ', id % 40) else concat('own text ', id, repeat('y', cast(id % 90 as int))) end as text")
    out = sh.kd_shards(table, 24).join(table, "doc_id").groupBy("shard").agg(F.sum("size").alias("b"), F.collect_set("text").alias("t")).collect()
    sizes = [r.b for r in out]
    assert len(out) == 24 and max(sizes) < 1.05 * sum(sizes) / 24
    homes = Counter(t for r in out for t in r.t)
    assert all(n == 1 for t, n in homes.items() if not t.startswith("the same"))
    by_bytes = sh.kd_shards(table, target_bytes=50_000).agg(F.max("shard")).first()[0]
    assert by_bytes + 1 == -(-sum(sizes) // 50_000)


def plain_decontamination(text, bench):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    split = lambda t: dc.WORD.findall((t or "").encode().translate(low))
    w, hit, items = split(text), set(), set()
    for i, t in bench:
        own = split(t)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                items.add("" if i is None else str(i))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("piece", [dc.PIECE_WORDS, 3])
def test_decontamination_query(spark, folder, rows, piece, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", piece)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_decontaminate"](spark, folder).collect())
    want = Counter()
    for i, t, *_ in rows:
        n, hit, items = plain_decontamination(t, bench)
        want[i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0] += 1
    assert got == want


def plain_mix(rows):
    """taken of each row by walking the schedule slot by slot."""
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words_of(t))
    plan = mx.targets(list(sizes.items()))
    total = sum(sizes.values())
    block = min(mx.MAX_BLOCK, max(1, total // mx.BLOCKS))
    blocks = [max(mx.LEAST_BLOCKS, -(-n // block)) for _, n, _ in plan]
    slots = [round(t * b / n) if n else 0 for (_, n, t), b in zip(plan, blocks, strict=True)]
    edges = np.cumsum([k / sum(slots) for k in slots])
    uses = [Counter() for _ in plan]
    ranks = [0] * len(plan)
    for i in range(sum(slots) + sum(slots) // 10):
        n = min(int(np.searchsorted(edges, (i + 1) * mx.GOLDEN % 1.0, side="right")), len(plan) - 1)
        if ranks[n] < slots[n]:
            uses[n][ranks[n] % blocks[n]] += 1
        ranks[n] += 1
    out = Counter()
    for n, (source, length, _) in enumerate(plan):
        own = [r for r in rows if r[3] == source]
        own.sort(key=lambda r: (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:12], 16), r[0] is not None, r[0] or 0))
        at = 0
        for r in own:
            k = len(words_of(r[1]))
            # the block of a word: block b starts at word b * length // blocks
            out[r[0], source, k] += sum(uses[n][((w + 1) * blocks[n] - 1) // length] for w in range(at, at + k))
            at += k
    return out, {s: t for s, _, t in plan}


def test_mixing_query_equals_the_schedule(spark, folder, rows):
    unlike = [r for i, r in enumerate(rows) if r not in rows[:i] and (r[0] != 7 or i == 7)]  # order among rows of one id is the text's hash's
    table = spark.createDataFrame(unlike, COLUMNS)
    want, goal = plain_mix(unlike)
    got = Counter()
    for r in mx.mix(table).collect():
        got[r.doc_id, r.source, r.size] += r.taken
        assert r.target == pytest.approx(goal[r.source]) and r.taken <= 3 * r.size
    assert +got == +want
    whole = QUERIES["op10_mixing"](spark, folder).collect()
    assert len(whole) == len(rows) and sorted(map(tuple, whole), key=str) == sorted(map(tuple, QUERIES["op10_mixing"](spark, folder).collect()), key=str)


def test_stages_keep_columns_and_take_effect(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = ql.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    as_rows = lambda frame: Counter(tuple(r) for r in frame.collect())

    kept = cp.quality(spark, docs, folder)
    scored = {t: plain_score(net, t or "") for t in {r[1] for r in rows} if len(t or "") < 700}
    left = as_rows(kept)
    assert kept.columns == docs.columns and all((left[r] > 0) == (scored[r[1]] >= 0.3) for r in rows if r[1] in scored)

    kept = cp.near_duplicates(spark, docs, folder)
    texts = Counter(r[1] or "" for r in as_rows(kept).elements())
    assert kept.columns == docs.columns and max(texts.values()) == 1
    assert {r[1] or "" for r in rows} - set(texts) == {rows[4][1] + " more"} if rows[4][1] in texts else True

    kept = cp.decontamination(spark, docs, folder)
    cleaned = as_rows(kept)
    assert kept.columns == docs.columns
    for r in rows:
        n, hit, _ = plain_decontamination(r[1], bench)
        if hit == 0:
            assert cleaned[r] == Counter(rows)[r]
        elif hit > n / 2:
            assert not any(c[0] == r[0] and c[1] == r[1] for c in cleaned)
    assert all(plain_decontamination(r[1], bench)[1] == 0 for r in cleaned)

    kept = cp.mixing(spark, docs, folder)
    taken = defaultdict(lambda: [0, 0])
    for r in mx.mix(docs).collect():
        taken[r.doc_id, r.source, r.text_hash][0] += r.taken
        taken[r.doc_id, r.source, r.text_hash][1] += r.size
    hashes = {(r.doc_id, r.source, r.text): r.text_hash for r in docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")).collect()}
    mixed = as_rows(kept)
    assert kept.columns == docs.columns
    for r, n in Counter(rows).items():
        t, s = taken[r[0], r[3], hashes[r[0], r[3], r[1]]]
        assert mixed[r] == n * (math.floor(t / s + 0.5) if s else 1), r

    final = cp.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(final.columns) and 0 < final.count() <= 3 * len(rows)


@pytest.mark.parametrize("name", ["op2_language", "op6_fingerprint", "op7_jaccard", "op8_dedup", "op9_lm"])
def test_other_queries_return_every_row(spark, folder, rows, name):
    assert Counter(r.doc_id for r in QUERIES[name](spark, folder).collect()) == Counter(r[0] for r in rows)


def test_captures_with_clashing_columns(spark):
    entries = spark.createDataFrame([("block", "a.com", "add", 1)], "list string, pattern string, action string, at long")
    table = spark.createDataFrame([(1, "http://a.com", 5, "x", "y", "z", 3)], "page_id int, url string, fetched_us long, host string, pattern string, verdict string, since long")
    got = uf.filter_captures(table, entries).collect()
    assert [(r.page_id, r.host, r.pattern, r.verdict, r.since) for r in got] == [(1, "a.com", "a.com", "block", 3)]


def test_pipelines_side_by_side_release_their_own_tables(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    from docgraph.llm.common import materialise, release, scratch

    other = materialise(spark.range(3), "other")
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: sorted(map(tuple, cp.run(spark, folder).collect()), key=repr), range(2)))
    assert runs[0] == runs[1] and other.count() == 3
    with scratch() as mine:
        materialise(spark.range(2), "a")
        with scratch() as inner:
            materialise(spark.range(2), "b")
    assert len(mine) == len(inner) == 1 and mine != inner
    release(spark, mine + inner)
