"""op6 against a plain version: digests, successors, trees and likeness."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docgraph.llm import fingerprint as fp

rnd = random.Random(3)
TEXT = lambda n: " ".join("".join(rnd.choice("abcdeiolmnrst") for _ in range(rnd.randint(1, 9))) for _ in range(n))
HAN = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(4000))


def table():
    long = "\n".join(TEXT(12) for _ in range(60))
    words = long.split(" ")
    words[len(words) // 2] = "changed"
    texts = [TEXT(16)[:97], "ab", HAN, TEXT(80), None, "", "a\n\nb\n", long, " ".join(words), long, "ab ab " * 400, "one\ttwo\r\nthree", "😀" * 50 + "x", TEXT(2000), "\n\n", "last"]
    return list(enumerate(texts))


def leaves(spark, texts):
    """Leaves of each text in order, by the tree's own hashes; their cover of the text is checked in another test."""
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [[x & 0xFFFFFF for s in r.tree for p in s for x in p] for r in frame.orderBy("i").select(fp.merkle_tree(F.col("t")).alias("tree")).collect()]


def dice(a, b, same):
    return 1.0 if same else 0.0 if not a and not b else 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def test_query_equals_plain_version(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, "doc_id int, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.op6_fingerprint(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    nexts = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
    own, new, after = leaves(spark, texts), leaves(spark, edited), leaves(spark, nexts)
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[i].encode()).hexdigest()), i
        assert r.near_edited == pytest.approx(dice(own[i], new[i], t == edited[i])), i
        assert r.near_next == pytest.approx(dice(own[i], after[i], t == nexts[i])), i
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited[i])
    assert len({r.fingerprint for r in got.values()}) == len(set(texts))
    assert all(len({got[i].fingerprint for i, t in enumerate(texts) if t == x}) == 1 for x in texts)
    assert got[0].near_edited > 0.5 and got[2].near_edited > 0.6 and got[7].near_next > 0.98  # 97 characters, no blanks, one word


def test_leaves_cover_the_text_and_are_bounded(spark):
    texts = [t or "" for _, t in table()]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cut = F.transform(F.filter(F.regexp_extract_all("t", F.lit(fp.SECTION), F.lit(0)), lambda s: s != ""), lambda s: F.transform(F.split(s, "\n"), lambda p: F.regexp_extract_all(p, F.lit(fp.LEAF), F.lit(0))))
    for r in frame.select("i", cut.alias("c")).collect():
        assert "".join("\n".join("".join(p) for p in s) for s in r.c) == texts[r.i]
        assert all(0 < len(x) <= fp.LEAF_CHARS for s in r.c for p in s for x in p)
        assert len(r.c) >= math.ceil(len([x for x in texts[r.i].split("\n") if x]) / fp.SECTION_LINES)


def test_first_edit_names_the_branch(spark):
    frame = spark.createDataFrame([("a b\n\nc d\ne f", "a b\n\nc d\ne x"), ("same", "same"), ("a", "a\n\nb")], "p string, q string")
    got = [tuple(r.e) for r in frame.select(fp.first_edit(fp.merkle_tree(F.col("p")), fp.merkle_tree(F.col("q"))).alias("e")).collect()]
    assert got == [(1, 1, 0), (None, None, None), (0, 1, None)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_successors_with_repeated_null_and_string_ids(spark, kind):
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else i, f"text {i % 50}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    frame = frame.withColumn("place", F.lit("x"))
    key = lambda r: (r.id is not None, r.id if r.id is not None else type(r.text)() if kind == "string" else 0, r.tie)
    for size in (10_000, 20):
        got = [r for r in fp.with_successor(frame, bucket_rows=size).collect() if not r.ghost]
        assert Counter((r.id, r.text) for r in got) == Counter((i if i is None or kind == "long" else str(i), t) for i, t in rows)
        order = sorted(got, key=key)  # rows of equal id and tie have equal texts
        want = Counter((a.id, a.text, b.text) for a, b in zip(order, order[1:] + order[:1], strict=True))
        assert Counter((r.id, r.text, r.next_text) for r in got) == want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.with_successor(empty).count() == 0 and fp.merkle_fingerprints(empty).count() == 0
    one = fp.with_successor(spark.createDataFrame([(1, "x")], empty.schema)).where("not ghost").collect()
    assert [(r.id, r.text, r.next_text) for r in one] == [(1, "x", "x")]
