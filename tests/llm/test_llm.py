"""Operators against brute force on small hostile fixtures: nulls, empty and long texts, copies, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import decontaminate as dc
from docgraph.llm import jaccard_join as jj
from docgraph.llm import language as lg
from docgraph.llm import language_model as lm
from docgraph.llm import mixing as mx
from docgraph.llm import quality as ql
from docgraph.llm import sharding as sh
from docgraph.llm import substring_dedup as sd
from docgraph.llm import suffix_array as sa
from docgraph.llm import urlfilter as uf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k long, size long"


def corpus(seed=1):
    """Documents with copies, near copies, shared passages, repeats, nulls, empty and long texts; clashing extra columns."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "é", "ñ"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(60)
    texts = [text(rnd.randint(1, 120)) for _ in range(30)]
    texts += [texts[5]] * 4 + [texts[6] + " end"] + [passage + " " + text(50) for _ in range(6)] + [text(20) + "\n" + passage for _ in range(3)]
    near = text(100).split()
    for _ in range(8):
        w = list(near)
        w[rnd.randrange(100)] = "changed"
        texts.append(" ".join(w))
    texts += [None, None, "", "", " \n ", "x", "ab ab ab " * 200, "!!! ???", text(3000)]
    return [(i, t, "ab"[i % 2], None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}", None, 1.0, 1, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, empty):
    rnd = random.Random(0)
    good = [(i, " ".join(rnd.choice(["the", "and", "house", "green"]) for _ in range(80))) for i in range(60)]
    bad = [(100 + i, " ".join(rnd.choice(["BUY!!", "***", "NOW!!", "$$$"]) for _ in range(80))) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    net = ql.fit_quality(table, labels, epochs=8)
    got = {r.doc_id: r.score for r in ql.score_quality(table, net).collect()}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.3) == (i < 100) for i in held)
    scored = ql.score_quality(docs, net, keep=["text"]).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert ql.score_quality(empty, net).count() == 0
    assert ql.fit_quality(empty, labels.limit(0)).offset == 0.0


def test_quality_covers_the_whole_text():
    net = ql.train([b"aaaa " * 40, b"zz!! " * 40] * 40, np.array([1, 0] * 40), epochs=6)
    long = np.frombuffer(b"aaaa " * 4000 + b"zz!! " * 12000, np.uint8)
    whole = ql.forward(net, long, np.array([0, len(long)]))
    prefix = ql.forward(net, long[:20000], np.array([0, 20000]))
    assert whole[0] < prefix[0]


def test_language_spans(spark, docs, empty):
    rnd = random.Random(2)
    vocab = {"a": ["thing", "house", "with", "they"], "b": ["ñandu", "señor", "ción", "que"], "c": ["дом", "вода", "земля"]}
    make = lambda k, n: " ".join(rnd.choice(vocab[k]) for _ in range(n))
    table = spark.createDataFrame([(i, make("abc"[i % 3], 50), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, lang string")
    model = lg.fit_language(table)
    mixed = make("a", 30) + " " + make("b", 20) + " " + make("c", 10)
    test = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, make("c", 5)), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lg.label_spans(test, model).collect()}
    assert got[1].lang_pred in ("a", "b") and [s.lang for s in got[1].spans] == ["a", "b", "c"]
    cut = mixed.encode()[got[1].spans[1].start : got[1].spans[1].end].decode()
    assert cut.split()[0] in vocab["b"] and len(cut.split()) == 20
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und", "und", "c", "und"]
    assert lg.label_spans(docs, model).count() == docs.count() and lg.label_spans(empty, model).count() == 0
    none = lg.fit_language(table.limit(0))
    assert {r.lang_pred for r in lg.label_spans(test, none).collect()} == {"und"}


def test_viterbi_equals_dynamic_programming():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 0, 9, 1])
    score = rng.normal(size=(15, 3)).astype(np.float32) * 3
    got, at = lg.viterbi(score, sizes, 2.0), 0
    for n in sizes:
        best = {(k,): 0.0 for k in range(3)} if n else {}
        best = {p: score[at, p[0]] for p in best}
        for t in range(1, n):
            best = {p + (k,): v + score[at + t, k] - (2.0 if p[-1] != k else 0) for p, v in best.items() for k in range(3)}
            best = {max((p for p in best if p[-1] == k), key=best.get): max(v for p, v in best.items() if p[-1] == k) for k in range(3)}
        if n:
            assert tuple(got[at : at + n]) == max(best, key=best.get)
        at += n


def test_sharding(spark, docs, empty, rows):
    out = sh.kd_shards(docs, 5).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        text = rows[r.doc_id][1]
        assert r.size == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(5)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r.b for r in sh.kd_shards(even, 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) / (sum(sizes) / 24) < 1.05
    assert sh.kd_shards(empty, 5).count() == 0


def test_decontamination(spark, docs, empty, rows):
    bench = [(0, rows[30 + 5][1]), (1, " ".join(rows[3][1].split()[:6])), (2, None), (3, ""), (4, rows[40][1]), (None, "x")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = lambda t: dc.WORD.findall((t or "").encode().translate(low))
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    for limit in (20_000_000, 150):
        got = {r.doc_id: r for r in dc.mark_hits(docs, table, block_chars=limit).collect()}
        for i, t, *_ in rows:
            w, hit, items = words(t), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        items |= windows[tuple(w[k : k + n])]
                        hit.update(range(k, k + n))
            assert (got[i].n_words, sum(r.end - r.start for r in got[i].hits), got[i].item_ids) == (len(w), len(hit), sorted(items)), i
    clean = dc.decontaminate(docs, table)
    assert clean.columns == docs.columns
    assert all(not r.hits for r in dc.mark_hits(clean, spark.createDataFrame(bench[:1], "item_id long, text string")).collect())
    assert dc.mark_hits(empty, table).count() == 0 and dc.decontaminate(docs, table.limit(0)).count() == len(rows)


def test_url_filter(spark):
    entries = [("block", "a.com", "add", 10), ("block", "a.com", "remove", 20), ("allow", "x.a.com", "add", 12), ("block", "b.org/p", "add", 5), ("block", "a.com", "add", 30)]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, at long")
    caps = [(1, "http://x.a.com/q", 11), (2, "http://x.a.com/q", 15), (3, "http://A.com", 20), (4, "https://b.org/p/z", 6), (5, "https://b.org/q", 6), (6, None, 6), (7, "junk", 6), (8, "http://a.com", None), (9, "http://a.com:80/?x", 99)]
    c = spark.createDataFrame(caps, "page_id int, url string, fetched_us long")
    want = {1: "block", 2: "allow", 3: "none", 4: "block", 5: "none", 6: "none", 7: "none", 8: "none", 9: "block"}
    for limit in (100_000, 0):  # broadcast and salted
        got = uf.filter_captures(c.union(c.limit(1)), e, broadcast_rows=limit).collect()
        assert len(got) == 10 and {r.page_id: r.verdict for r in got} == want
    assert uf.filter_captures(c.limit(0), e).count() == 0 and {r.verdict for r in uf.filter_captures(c, e.limit(0)).collect()} == {"none"}


def shingles(t):
    w = (t or "").encode().translate(dc.FOLD).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("limit", [128, 2])
def test_jaccard(spark, docs, empty, rows, limit, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4 if limit == 2 else 256)
    got = {r.doc_id: r for r in jj.jaccard_classes(docs, bucket_limit=limit).collect()}
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = {t: shingles(t) for t in texts}
    parent = {t: t for t in texts}
    find = lambda t: t if parent[t] == t else find(parent[t])
    links = Counter()
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for i, t, *_ in rows:
        first[find(t or "")] = min(i, first.get(find(t or ""), i))
    for i, t, *_ in rows:
        assert (got[i].class_id, got[i].n_links) == (first[find(t or "")], links[t or ""]), i
    assert sorted(r.doc_id for r in jj.keep_one(docs, bucket_limit=limit).collect()) == sorted(first.values())
    assert jj.jaccard_classes(empty).count() == 0


def test_jaccard_compares_what_stays_large_under_a_hot_template(spark, monkeypatch):
    monkeypatch.setattr(jj, "MAX_DEPTH", 0)
    rnd = random.Random(5)
    make = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    template, texts = make(68), []
    for i in range(1200):
        own = make(32)
        texts.append(template + own)
        if i < 300:  # a near copy each, at 0.8 to 0.9
            at = rnd.randrange(5, 27)
            texts.append(template + own[:at] + make(1) + own[at + 1 :] + make(rnd.randrange(6)))
    rows = list(enumerate(map(" ".join, texts)))
    pairs = [(i, i + 1) for i in range(0, 600, 2)]
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a, b in pairs if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    got = {r.doc_id: r.class_id for r in jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=16).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 250 and found >= 0.99 * len(pairs), (found, len(pairs))
    assert sum(i != c for i, c in got.items()) == found


def test_jaccard_recall_at_the_threshold_behind_a_shared_passage(spark):
    rnd = random.Random(11)
    make = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, rows = make(50), []
    for i in range(700):  # each pair differs in one place: Jaccard 0.80 to 0.85, cross pairs share the passage
        own = make(40)
        at, cut = rnd.randrange(6, 30), rnd.choice([4, 5])
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:at] + make(cut) + own[at + cut :]))]
    sets = [shingles(t) for _, t in rows]
    likeness = [len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in range(0, 1400, 2)]
    pairs = [2 * i for i, x in enumerate(likeness) if x >= 0.8]
    assert len(pairs) > 250 and max(likeness) < 0.86
    got = {r.doc_id: r for r in jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a].class_id == got[a + 1].class_id == a for a in pairs)
    assert found >= 0.99 * len(pairs), (found, len(pairs))
    with pytest.raises(ValueError):
        jj.repetitions(0.2, 0.999)


def test_jaccard_without_and_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words)
    rows = [(None, near), (None, near + " end"), (7, "quite another text of seven words"), (7, "start " + near), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.n_links for r in jj.jaccard_classes(table).where("class_id = 7").collect()}
    assert got == {0, 2}
    # three classes, three rows: texts that share an id stay apart, copies without id go
    kept = jj.keep_one(table.union(table).withColumn("tk", F.lit(1)).withColumn("kept_id", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7, "start " + near), (7, rows[2][1]), (None, None)], key=str)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(150):
        a = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60)))
        order = sa.suffix_array(a).tolist()
        assert order == sorted(range(len(a) + 1), key=lambda i: a.tolist()[i:])
        lcp, before = sa.permuted_lcp(np.where(a == 0, 255, a).astype(np.uint8), np.array(order))  # 0 plays the separator
        for p, q in zip(order[2:], order[1:], strict=False):
            n = 0
            while max(p, q) + n < len(a) and a[p + n] == a[q + n] != 0:
                n += 1
            assert (before[p], lcp[p]) == (q, n)


@pytest.mark.parametrize("limit", [1024, 2])
def test_substring_dedup(docs, empty, rows, limit, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_LIMIT", limit)
    got = {r.doc_id: r for r in sd.substring_dedup(docs).collect()}
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    for i, b in raw.items():
        cover = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                cover[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()), i
    assert sd.substring_dedup(empty).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 500)
    row, start, end = sd.text_pieces(np.array([0, 2000, 2000, 2100]), 200)
    windows = sorted((r, s + i) for r, s, e in zip(row, start, end, strict=True) for i in range(max(0, e - s - 199)))
    assert windows == [(0, i) for i in range(1801)]


def plain_ppm(texts):
    """PPM of the training texts by dictionaries: probability of a symbol after five others."""
    tables = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    for t in texts:
        stream = [0] * lm.ORDER + [max(b, 1) for b in t] + [0]
        for i in range(lm.ORDER, len(stream)):
            for k in range(lm.ORDER + 1):
                tables[k][bytes(stream[i - k : i])][stream[i]] += 1

    def probability(history, symbol):
        excluded, p = set(), 1.0
        for k in range(lm.ORDER, -1, -1):
            seen = {s: m for s, m in tables[k].get(bytes(history[len(history) - k :]), {}).items() if s not in excluded}
            if not seen:
                continue
            total, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return p * seen[symbol] / (total + d)
            p *= d / (total + d)
            excluded |= set(seen)
        return p / (256 - len(excluded))

    return probability


@pytest.mark.parametrize("rows_sent", [lm.TABLE_ROWS, 0])
def test_language_model(docs, empty, rows, rows_sent, monkeypatch):
    monkeypatch.setattr(lm, "WORD_SHARE", 100)
    monkeypatch.setattr(lm, "COLLECT_ROWS", 1000)
    table = docs.select("doc_id", "text", "size", "score", F.lit(1).alias("known"), (F.col("doc_id") % 4 != 0).alias("__train"))
    out = lm.score_texts(table, table_rows=rows_sent)
    assert out.columns == ["doc_id", "size", "known", "__train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r.doc_id: r for r in out.collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = {i: (t or "").translate(lower) for i, t, *_ in rows}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    train = [i for i in tokens if i % 4]
    count = Counter(w for i in train for w in tokens[i])
    n = sum(count.values()) + len(train)
    total = math.log10(n + 0.1 * (len(count) + 2))
    for i, w in tokens.items():
        base = sum(math.log10(count[x] + 0.1) - total for x in w) + math.log10(len(train) + 0.1) - total
        assert got[i].base_score == pytest.approx(base, rel=1e-6) and got[i].train_tokens == n
        assert (got[i].n_tokens, got[i].n_known) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1)
    probability = plain_ppm([texts[i].encode() for i in train])
    for i in sorted(texts)[::3]:
        stream = [0] * lm.ORDER + list(texts[i].encode()[:4000]) + [0] * (len(texts[i].encode()) <= 4000)
        if len(texts[i].encode()) <= 4000:
            want = sum(math.log10(probability(stream[k - lm.ORDER : k], stream[k])) for k in range(lm.ORDER, len(stream)))
            assert got[i].score == pytest.approx(want, rel=1e-4), i
    untaught = {r.doc_id: r for r in lm.score_texts(table.withColumn("__train", F.lit(False)), table_rows=rows_sent).collect()}
    assert all(r.score == pytest.approx(-(len(texts[i].encode()) + 1) * math.log10(256), rel=1e-5) and r.n_known == 0 for i, r in untaught.items())
    assert lm.score_texts(empty.select("doc_id", "text", F.lit(True).alias("__train"))).count() == 0


def test_string_costs_are_a_distribution():
    texts = [b"abracadabra", b"banana bandana"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes, n = np.unique(lm.gram_codes(data, np.array([0, 11, 25])), return_counts=True)
    probability = plain_ppm(texts)
    one = lm._tally([codes & 0xFFFF], [n])
    none = lm._tally([one[0] & 255], [one[1]])
    for history in (b"abrac", b"xxban", b"zzzzq", b"\0\0\0\0\0"):
        context = int.from_bytes(history, "big")
        all_codes = np.concatenate([codes, (context << 8) | np.arange(256)])
        pair = context & 0xFFFF
        key, times = lm._tally([all_codes], [np.concatenate([n, np.zeros(256, np.int64)])])
        own = (key >> 8 & 0xFFFF) == pair
        cost = dict(zip(key[own].tolist(), lm.string_costs(key[own], times[own], [none, one]).tolist(), strict=True))
        got = [10 ** cost[(context << 8) | s] for s in range(256)]
        assert sum(got) == pytest.approx(1) and got == pytest.approx([probability(history, s) for s in range(256)])


def test_mixing(docs, empty, rows):
    plan = mx.targets([("a", 100), ("b", 10), (None, 90)])
    assert [s for s, *_ in plan] == ["a", "b", None] and sum(t for *_, t in plan) == pytest.approx(200) and dict((s, t) for s, _, t in plan)["b"] == 30
    out = mx.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out)) == sorted(map(tuple, mx.mix(docs).collect()))
    taken, goal = Counter(), {}
    for r in out:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1] or ""))
        assert r.size == n and 0 <= r.taken <= 3 * n
        taken[rows[r.doc_id][3]] += r.taken
        goal[rows[r.doc_id][3]] = r.target
    assert all(abs(taken[s] - t) <= max(12, 0.05 * t) for s, t in goal.items())
    assert mx.mix(empty).count() == 0


def test_mixing_serves_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCKS", 20)
    sizes = {"a": 40, "b": 3, "c": 7, "d": 4000, "e": 5}  # documents of ten words
    rows = [(i, "w " * 10, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    taken, goal = Counter(), {}
    for r, (_, _, s) in zip(sorted(mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), rows, strict=True):
        taken[s] += r.taken
        goal[s] = r.target
    assert all(abs(taken[s] - t) <= max(2, 0.02 * t) for s, t in goal.items()), (taken, goal)


def test_pipeline_keeps_columns(spark, docs, rows, tmp_path):
    import corpus_pipeline as cp

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, rows[35][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {"shard", "slot"} <= set(cp.run(spark, str(tmp_path)).columns)
