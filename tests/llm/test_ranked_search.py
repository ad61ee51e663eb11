"""op12 against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docgraph.llm import ranked_search as rs

PLAIN_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n long, score long, terms string, rank int, item_id long"
ITEMS = "item_id long, text string, doc_id long, item int"


def plain_terms(text):
    return PLAIN_TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(items, docs, k=10):
    docs = [(i, Counter(t)) for i, t in ((i, plain_terms(t)) for i, t in docs) if t]
    n_docs, n_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, c in docs:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if missing else i, -s) for rank, (s, missing, i) in enumerate(sorted(found)[:k], 1)]
    return out


def tables(seed, n=400):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(1, 7))) for _ in range(150)] + ["Éa", "漢字", "ñ9", "x_y", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: " ".join(rnd.choices(words, weights, k=k))
    docs = [(i, text(rnd.randint(1, 60))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(300)] + [(5, docs[5][1]), (5, text(9)), (None, docs[6][1]), (None, docs[6][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,"), (2003, text(30_000)), (2004, "a" * 5000), (2005, "Zz zZ ZZ")]
    items = [(i, text(rnd.randint(1, 40))) for i in range(25)] + [(30, docs[3][1]), (31, docs[3][1] + " " + docs[3][1]), (32, None), (33, ""), (34, "nowhere-at all"), (None, docs[6][1]), (35, "zz"), (36, docs[7][1]), (36, docs[7][1])]
    return items, docs


@pytest.mark.parametrize(("leaf", "chunk", "block", "stretch"), [(128, 8192, 20_000, 1 << 20), (4, 100, 60, 64), (1, 7, 1, 1)])
def test_every_item_gets_its_best_documents(spark, monkeypatch, leaf, chunk, block, stretch):
    for name, value in (("LEAF", leaf), ("CHUNK_DOCS", chunk), ("BLOCK_TERMS", block), ("STRETCH_BYTES", stretch)):
        monkeypatch.setattr(rs, name, value)
    items, docs = tables(leaf)
    if block == 1:
        items, docs = items[:3] + items[-2:], docs[:60]
    d = spark.createDataFrame([(*r, 1, 2, "t", 3, 4) for r in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(*r, 7, 8) for r in items], ITEMS)
    got = rs.ranked_search(q, d).collect()
    key = lambda r: repr(r)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=key) == sorted(plain_search(items, docs), key=key)


def test_trees_bound_scores_and_skip_documents():
    rnd = np.random.default_rng(3)
    n, v = 1500, 300
    size = rnd.integers(0, 25, n)
    terms = np.concatenate([rnd.choice(v, k, replace=False, p=np.arange(v, 0, -1) / (v * (v + 1) / 2)) for k in size])
    tf, m, weight = rnd.integers(1, 9, len(terms)), rnd.integers(25, 400, n), rnd.integers(1, 9000, v)
    df = np.bincount(terms, minlength=v)
    rank = np.empty(v, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(v)
    tree = rs.FPTree(size, terms, tf, m, rank)
    dense = np.zeros((n, v), np.int64)
    dense[np.repeat(np.arange(n), size), terms] = tf
    for node, (c, d) in enumerate(tree.kids):
        below = tree.order[tree.low[node] : tree.high[node]]
        assert (tree.most.of(np.array([node]), np.arange(v))[0] == dense[below].max(axis=0)).all()
        assert tree.least_m[node] == m[below].min()
        assert c == d or (tree.low[c], tree.high[d - 1]) == (tree.low[node], tree.high[node])
    skipped = 0
    for _ in range(30):
        asked = rnd.choice(v, 12, replace=False)
        best = rs.Best(10)
        skipped += n - tree.search(asked, weight[asked], best, list(range(n)))
        scores = rs.impact(dense[:, asked], m, weight[asked])
        assert best.kept == [(-s, False, i) for s, i in sorted(zip((-scores).tolist(), range(n), strict=True)) for s in [-s]][:10]
    assert skipped > 0


def test_query_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert rs.op12_search(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, "word")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert rs.op12_search(spark, f"{tmp_path}/b").collect() == []
