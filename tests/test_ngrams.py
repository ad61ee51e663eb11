"""Grams that run from one text into the next, against one list of all tokens."""

import random
import re
from collections import Counter

import pytest

from docgraph.operators import corpus as cp


@pytest.mark.parametrize("n", [2, 3, 4, 7])
def test_grams_cross_borders_of_texts_and_partitions(spark, n):
    rnd = random.Random(n)
    words = ["ab", "cd", "ef", "điều", "x", "gh2"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 30])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a b c"), (203, "Ab, CD!")]
    given = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    every = [w for _, t in sorted(rows) for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) > 1]
    grams = Counter(" ".join(every[i : i + n]) for i in range(len(every) - n + 1) if len(set(every[i : i + n])) == n)
    want = sorted(grams.items(), key=lambda g: (-g[1], g[0]))
    got = cp.top_ngrams_across(given, ["doc_id"], "text", n, 1000).collect()
    assert [(r.gram, r.n) for r in got] == want[:1000]
    followed = cp.followed_texts(given, ["doc_id"], "text", n)
    assert sum(len(r.t.split(" ")) for r in followed.collect()) == len(every)
    assert cp.top_ngrams_across(given.limit(0), ["doc_id"], "text", n).collect() == []


def test_ngrams_are_counted_as_numbers(spark):
    """Blocks of texts, many different words, blank and null texts, against plain counting."""
    rnd = random.Random(7)
    rows = [(i, " ".join(f"w{rnd.randrange(40 if i % 2 else 9000)}" for _ in range(rnd.randrange(0, 30)))) for i in range(3000)] + [(3000, None), (3001, "a b"), (3002, "Xx, yy xx")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    for n in (1, 2, 3, 5):
        want = Counter()
        for _, t in rows:
            w = [x.strip(",") for x in (t or "").lower().split() if len(x.strip(",")) > 1]
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if len(set(w[i : i + n])) == n)
        got = cp.top_ngrams(df, "text", n, 500)
        assert [(r.gram, r.n) for r in got.collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:500]
        assert "array_distinct" not in got._jdf.queryExecution().executedPlan().toString()
