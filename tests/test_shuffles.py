"""How often rows are moved: steps whose shuffles would otherwise outgrow their input."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from docgraph.operators import context as ctx
from docgraph.operators import evaluation as ev
from docgraph.operators import graph as g
from docgraph.plans.fixtures import Tables
from docgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def lines(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().splitlines()


def count(df, *words):
    plan = lines(df)
    return [sum(word in line for line in plan) for word in words]


def test_points_stay_where_the_join_by_clause_left_them(spark, no_broadcast):
    point, raw = (count(x, "Exchange hashpartitioning", "ReusedExchange") for x in (Tables(spark, SF).point, Tables(spark, SF).point_raw))
    assert point == raw


def test_edges_to_points_move_no_contents(spark, no_broadcast):
    assert count(Tables(spark, SF).edge, "l_shipdate", "l_partkey") == [0, 0]


def test_edges_move_once_by_each_end(spark, no_broadcast):
    edges = spark.createDataFrame([("a", "b", "X")], "src string, dst string, type string").union(spark.createDataFrame([("a", "b", "X"), ("a", "c", "X"), ("c", "b", "X"), ("a", "b", "RELATED_TO")], "src string, dst string, type string"))
    nodes = spark.createDataFrame([("a",), ("b",)], "uid string")
    out = g.upsert_edges(edges, nodes)
    assert [tuple(r) for r in out.collect()] == [("a", "b", "X")]
    assert count(out, "Exchange hashpartitioning", "ReusedExchange") == [4, 1]  # edges by dst and by src, nodes by uid, used again


NODES = [
    ("D", "Document", None, "Doc", None),
    ("D::chapter::I", "Chapter", "I", "One", None),
    ("D::article::1", "Article", "1", "First", "body"),
    *((f"D::article::1::clause::{n}", "Clause", n, None, f"clause {n}") for n in ("5", "50")),
    *((f"D::article::1::clause::{n}::point::{p}", "Point", p, None, f"point {n}{p}") for n in ("5", "50") for p in "ab"),
    ("D::article::2::clause::7::point::a", "Point", "a", None, "alone"),
]


def tables(spark):
    nodes = spark.createDataFrame([(*r, "D") for r in NODES], "uid string, label string, number string, title string, content string, doc_identity string")
    edges = spark.createDataFrame([("D", "D::chapter::I", "HAS_CHAPTER"), ("D::chapter::I", "D::article::1", "HAS_ARTICLE")], "src string, dst string, type string")
    documents = spark.createDataFrame([("D", "Law", "2001-02-03")], "doc_identity string, doc_name string, effect_date string")
    return nodes, edges, documents


def wanted(spark, *uids):
    return spark.createDataFrame([(u,) for u in uids], "uid string")


def test_context_comes_from_families_in_order(spark, no_broadcast):
    nodes, edges, documents = tables(spark)
    head = "[Văn bản: D — Hiệu lực: 2001-02-03]"
    top = f"{head}\nChương I: One"
    article = f"{top}\nĐiều 1: First"
    point = "D::article::1::clause::5::point::b"
    asked = wanted(spark, point, point, "D::article::1::clause::50", "D::article::1", "D::chapter::I", "D::article::2::clause::7::point::a", "D::article::9")
    out = ctx.hierarchy_text(asked, nodes, edges, documents)
    assert sorted(map(tuple, out.collect())) == sorted(
        [
            (point, f"{article}\nKhoản 5.\nclause 5\nĐiểm b.\nNội dung: point 5b"),
            ("D::article::1::clause::50", f"{article}\nKhoản 50.\nNội dung: clause 50"),
            ("D::article::1", f"{article}\nNội dung: body"),
            ("D::chapter::I", top),
            ("D::article::2::clause::7::point::a", f"{head}\nĐiểm a.\nNội dung: alone"),
        ]
    )
    assert count(out, "Generate") == [0]  # no row for each target and ancestor


AMENDS = [
    ("D::article::1::clause::50", "D::article::1::clause::5", "bãi bỏ"),
    ("D::article::1::clause::50", "D::article::1::clause::5", "thay thế"),
    ("D::article::1::clause::50::point::a", "D::article::1::clause::5::point::b", "sửa đổi"),
    ("D::article::1::clause::5::point::a", "D::chapter::I", "sửa đổi"),
]


def final(spark, ranked):
    nodes, edges, documents = tables(spark)
    amends = spark.createDataFrame(AMENDS, "src_uid string, dst_uid string, amend_type string")
    points = nodes.where("label = 'Point'").select("uid", F.col("number").alias("letter"), "content")
    return ctx.final_context(spark.createDataFrame(ranked, "query_id int, rank int, uid string"), nodes, edges, documents, amends, True, points)


def test_final_context_of_every_kind(spark):
    point, clause = "D::article::1::clause::5::point::b", "D::article::1::clause::5"
    out = dict(map(tuple, final(spark, [(1, 2, point), (1, 1, clause), (2, 1, clause), (2, 1, clause), (3, 1, "D::article::9"), (4, 1, None), (5, 1, "D::article::1")]).collect()))
    law = "[Văn bản: D — Hiệu lực: 2001-02-03]\nChương I: One\nĐiều 1: First"
    by_clause = "Đã được sửa đổi/bổ sung bởi Khoản 50 Điều 1 D: clause 50"
    by_points = ["Đã được sửa đổi/bổ sung bởi Điểm a Khoản 50 Điều 1 D: point 50a", "Đã được sửa đổi/bổ sung bởi Điểm a Khoản 5 Điều 1 D: point 5a"]
    amended = "\n\n[LƯU Ý - NỘI DUNG SỬA ĐỔI]:\n" + "\n".join([by_clause, *by_points])
    whole = f"[ĐÃ BỊ BÃI BỎ bởi văn bản mới hơn]\n{law}\nKhoản 5.\nNội dung: clause 5\n\n[Nội dung chi tiết]:\n  Điểm a. point 5a\n  Điểm b. point 5b{amended}"
    assert out[1] == f"{whole}\n\n---\n\n{law}\nKhoản 5.\nclause 5\nĐiểm b.\nNội dung: point 5b\n\n[Các điểm khác cùng khoản]:\n  Điểm a. point 5a{amended}"
    assert out[2] == f"{whole}\n\n---\n\n{whole}" and out[3] == "" and 4 not in out
    assert out[5].startswith(f"{law}\nNội dung: body\n\n[Nội dung chi tiết]:\nKhoản 5. clause 5\n") and out[5].endswith(amended)


def test_final_context_meets_by_family(spark, no_broadcast):
    """Texts are moved once, when they are whole, and points only as children where no point is asked for."""
    plan = lines(final(spark, [(1, 1, "D::article::1::clause::5")]))
    assert not any("hashpartitioning(top" in x and "uid" in x.split("hashpartitioning")[1] for x in plan)
    grouped = next(i for i, x in enumerate(plan) if "Union" in x)
    assert sum("Exchange hashpartitioning" in x for x in plan[:grouped]) == 1


def test_amendments_above_and_below_each_target_once(spark, no_broadcast):
    nodes, edges, documents = tables(spark)
    amends = spark.createDataFrame([*AMENDS, ("D::article::1", "D::article::1", "sửa đổi")], "src_uid string, dst_uid string, amend_type string")
    uids = ("D::article::1::clause::5::point::b", "D::article::1::clause::5::point::a", "D::article::1::clause::50", "D::article::1", "D::chapter::I")
    found = ctx.amendments_of(wanted(spark, *uids, *uids), amends, edges, nodes, documents).collect()
    kept = sorted((uids.index(r.uid), AMENDS.index((r.src_uid, r.dst_uid, r.amend_type)) if r.src_uid != "D::article::1" else 4) for r in found)
    assert kept == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 3), (1, 4), (2, 3), (2, 4), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4), (4, 3)]
    # clauses alone, nothing amended above them: no row for each target and what stands above it
    plan = lines(ctx.amendments_of(wanted(spark, uids[2]), amends.where("dst_uid like '%clause%'"), edges, nodes, documents))
    assert sum("Generate" in x for x in plan) == 1


@pytest.mark.parametrize("name", ["e10_final_context", "e12_context_for_uids"])
def test_contexts_derive_their_nodes_once(spark, no_broadcast, name):
    out = QUERIES[name](spark, SF)
    assert not out.isEmpty() and count(out, "l_linenumber") == [0]


def test_law_text_reads_nodes_once_a_form(spark, no_broadcast):
    nodes, _, documents = tables(spark)
    out = ctx.law_text(wanted(spark, "D::article::1", "D::article::1::clause::5::point::a", "D::article::1::clause::50"), nodes, documents)
    head = "Law\nĐiều 1. First"
    assert dict(map(tuple, out.collect())) == {
        "D::article::1": f"{head}\nbody\n5. clause 5\na) point 5a\nb) point 5b\n50. clause 50\na) point 50a\nb) point 50b",
        "D::article::1::clause::5::point::a": f"{head}\n5. clause 5\na) point 5a",
        "D::article::1::clause::50": f"{head}\n50. clause 50",
    }
    assert count(out, "ExistingRDD")[0] <= 6  # nodes below for both forms, articles for both, documents for both


@pytest.mark.parametrize("name", ["e13_law_text", "e14_merged_law_text"])
def test_law_texts_derive_their_nodes_once(spark, no_broadcast, name):
    out = QUERIES[name](spark, SF)
    assert not out.isEmpty() and count(out, "l_linenumber") == [0]  # points come from the stored nodes


def test_merged_law_text_moves_nodes_once(spark, no_broadcast):
    nodes, _, documents = tables(spark)
    uids = [(1, "D::article::1::clause::5"), (1, "D::article::1::clause::5::point::a"), (2, "D::article::1"), (2, "D::article::1::clause::50"), (3, "D::article::2::clause::7::point::a"), (4, "D::article::1::clause::50::point::b")]
    out = ctx.merged_law_text(spark.createDataFrame(uids, "query_id int, uid string"), nodes, documents)
    head = "Law\nĐiều 1. First"
    assert dict(map(tuple, out.collect())) == {
        1: f"{head}\n5. clause 5\na) point 5a\nb) point 5b",
        2: f"{head}\nbody\n5. clause 5\na) point 5a\nb) point 5b\n50. clause 50\na) point 50a\nb) point 50b",
        4: f"{head}\n50. clause 50\nb) point 50b",
    }
    assert count(out, "ExistingRDD", "Generate") == [2, 1]  # nodes and documents; no row for each node and what stands above it


def test_children_meet_their_targets_once(spark, no_broadcast):
    nodes, _, _ = tables(spark)
    out = ctx.children_text(wanted(spark, "D::article::1::clause::5", "D::article::1", "D::article::1::clause::5::point::a", "D::chapter::I"), nodes)
    assert dict(map(tuple, out.collect())) == {
        "D::article::1::clause::5": "  Điểm a. point 5a\n  Điểm b. point 5b",
        "D::article::1": "Khoản 5. clause 5\nKhoản 50. clause 50\n  Điểm a. point 50a\n  Điểm b. point 50b\n  Điểm a. point 5a\n  Điểm b. point 5b",
    }
    assert count(out, "Generate") == [0]


@pytest.mark.parametrize("name", ["g6_ablation_grid", "g8_comparison_table", "g7_delta_to_baseline"])
def test_a_grid_searches_once(spark, name):
    """Metrics read the grid's rows twice, a delta reads the metrics twice: neither may repeat the search."""
    assert count(QUERIES[name](spark, SF), "MapInArrow") == [0]


def test_source_items_move_beginnings_of_texts(spark, no_broadcast):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["e16_source_items"](spark, SF).explain()
    lines = out.getvalue().splitlines()
    join = min(i for i, line in enumerate(lines) if "Join" in line)
    assert any("substring(text" in line for line in lines[join:])


def test_a_delta_computes_its_summaries_once(spark):
    rows = spark.createDataFrame([("full", *([0.5] * len(ev.METRICS))), ("other", *([0.75] * len(ev.METRICS)))], ["config", *ev.METRICS])
    out = ev.delta_to_baseline(ev.run_summary(rows), "full")
    assert count(out, "Aggregate") == [0]
    assert sorted((r.config, r.mrr) for r in out.collect()) == [("full", 0.0), ("other", 0.25)]
