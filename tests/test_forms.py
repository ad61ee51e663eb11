"""Printed forms, readers, writers and streams against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from docgraph.functions import storage
from docgraph.functions import text as tx
from docgraph.operators import context as ctx
from docgraph.operators import corpus as cp
from docgraph.operators import evaluation as ev
from docgraph.operators import graph as g
from docgraph.operators import search as srch
from docgraph.plans import retrieval
from docgraph.sources import readers as rd
from docgraph.streaming import jobs

NODES = [
    ("D", "Document", None, "Luật A", None, "D"),
    ("D::chapter::I", "Chapter", "I", "Chung", None, "D"),
    ("D::article::2", "Article", "2", " Phạm vi ", "mở đầu", "D"),
    ("D::article::10", "Article", "10", "Hiệu lực", "", "D"),
    ("D::article::2::clause::1", "Clause", "1", None, "mở đầu", "D"),
    ("D::article::2::clause::10", "Clause", "10", None, "mười", "D"),
    ("D::article::2::clause::9", "Clause", "9", None, "  ", "D"),
    ("D::article::2::clause::1::point::a", "Point", "a", None, "điểm a", "D"),
    ("D::article::2::clause::10::point::b", "Point", "b", None, "điểm b", "D"),
    ("D::article::10::clause::1", "Clause", "1", None, "", "D"),
    ("E::article::1", "Article", "1", "Khác", "nội dung", "E"),
    ("E::article::1::clause::1", "Clause", "1", None, "khoản", "E"),
]
EDGES = [("D", "D::chapter::I", "HAS_CHAPTER"), ("D::chapter::I", "D::article::2", "HAS_ARTICLE"), ("D::article::2", "D::article::2::clause::1", "HAS_CLAUSE"), ("D::article::2::clause::1", "D::article::2::clause::1::point::a", "HAS_POINT")]


@pytest.fixture(scope="module")
def tree(spark):
    return {
        "node": spark.createDataFrame(NODES, "uid string, label string, number string, title string, content string, doc_identity string"),
        "edge": spark.createDataFrame(EDGES, "src string, dst string, type string"),
        "document": spark.createDataFrame([("D", "Luật A", "2020-01-02T00:00"), ("E", None, None)], "doc_identity string, doc_name string, effect_date string"),
        "amends": spark.createDataFrame([("E::article::1::clause::1", "D::article::2::clause::1", "bãi bỏ"), ("E::article::1::clause::1", "D::chapter::I", "sửa đổi, bổ sung")], "src_uid string, dst_uid string, amend_type string"),
    }


def targets(spark, *uids):
    return spark.createDataFrame([(u,) for u in uids], "uid string")


def test_law_text(spark, tree):
    uids = ["D::article::2", "D::article::2::clause::10", "D::article::2::clause::1::point::a", "D::article::2::clause::10::point::b", "D::article::10::clause::1", "E::article::1::clause::1"]
    got = {r.uid: r.law_text for r in ctx.law_text(targets(spark, *uids), tree["node"], tree["document"]).collect()}
    assert got == {
        "D::article::2": "Luật A\nĐiều 2. Phạm vi\nmở đầu\n1. mở đầu\na) điểm a\n10. mười\nb) điểm b",
        "D::article::2::clause::10": "Luật A\nĐiều 2. Phạm vi\n10. mười",
        "D::article::2::clause::1::point::a": "Luật A\nĐiều 2. Phạm vi\na) điểm a",  # the clause repeats the article
        "D::article::2::clause::10::point::b": "Luật A\nĐiều 2. Phạm vi\n10. mười\nb) điểm b",
        "D::article::10::clause::1": "Luật A\nĐiều 10. Hiệu lực",
        "E::article::1::clause::1": "Điều 1. Khác\n1. khoản",
    }


def test_merged_law_text(spark, tree):
    wanted = spark.createDataFrame([(1, "D::article::10"), (1, "D::article::2::clause::10::point::b"), (1, "D::article::2::clause::1"), (1, "E::article::1"), (2, "D::article::2::clause::10"), (2, "Z::article::1")], "query_id int, uid string")
    got = {r.query_id: r.law_text for r in ctx.merged_law_text(wanted, tree["node"], tree["document"]).collect()}
    assert got == {
        1: "Luật A\nĐiều 2. Phạm vi\n1. mở đầu\na) điểm a\n10. mười\nb) điểm b\n\nĐiều 10. Hiệu lực\n\nĐiều 1. Khác\nnội dung\n1. khoản",
        2: "Luật A\nĐiều 2. Phạm vi\n10. mười\nb) điểm b",
    }


def test_context_blocks(spark, tree):
    point = "D::article::2::clause::1::point::a"
    found = ctx.amendments_of(targets(spark, point, "D::article::2"), tree["amends"], tree["edge"], tree["node"], tree["document"])
    assert {(r.uid, r.dst_uid) for r in found.collect()} == {(point, "D::article::2::clause::1"), (point, "D::chapter::I"), ("D::article::2", "D::chapter::I"), ("D::article::2", "D::article::2::clause::1")}
    one = found.where(F.col("uid") == point).where("amend_type = 'bãi bỏ'")
    assert ctx.amendment_lines(one).first().amendments == "      - Amended by: Khoản 1 Điều 1 E (applied to Khoản 1 Điều 2 D)\n        Content: khoản"
    assert ctx.amendment_lines(one.withColumn("effect_date", F.lit("2021-03-04T1"))).first().amendments.startswith("      - Amended by: Khoản 1 Điều 1 E (Effective: 2021-03-04) (applied")
    assert ctx.amendment_notes(one).first().amendments == "Đã được sửa đổi/bổ sung bởi Khoản 1 Điều 1 E: khoản"
    context = ctx.hierarchy_text(targets(spark, point), tree["node"], tree["edge"], tree["document"]).first().context
    assert context == "[Văn bản: D — Hiệu lực: 2020-01-02]\nChương I: Chung\nĐiều 2:  Phạm vi \nKhoản 1.\nmở đầu\nĐiểm a.\nNội dung: điểm a"
    kids = {r.uid: r.children for r in ctx.children_text(targets(spark, "D::article::2", "D::article::2::clause::1", "D::article::10"), tree["node"]).collect()}
    assert kids == {"D::article::2": "Khoản 1. mở đầu\nKhoản 10. mười\n  Điểm b. điểm b\n  Điểm a. điểm a", "D::article::2::clause::1": "  Điểm a. điểm a"}
    dates = ctx.effect_date_list(spark.createDataFrame([(1, "D::article::2"), (1, "E::article::1"), (1, "D")], "query_id int, uid string"), tree["document"]).first().dates
    assert dates == "Danh sách văn bản hiệu lực:\n- Luật D (Ngày hiệu lực: 2020-01-02)\n- E"


def test_catalogue(spark, tree):
    n = tree["node"]
    a = n.where("label = 'Article'").select("uid", "number", "title", "doc_identity")
    c = n.where("label = 'Clause'").select("uid", "number", "content", "doc_identity")
    p = n.where("label = 'Point'").select("uid", "number", "content", "doc_identity", F.lit(1).alias("clause_num"))
    q = spark.createDataFrame([(1, " ĐIỀU 10 "), (2, "luật"), (3, "mở đầu"), (4, "đ"), (5, ""), (6, "zzz")], "query_id int, needle string")
    got = {}
    for r in srch.catalogue_search(q, a, c, p, tree["document"]).orderBy("query_id", "kind", "rank").collect():
        got.setdefault((r.query_id, r.kind), []).append(r.uid)
    assert got[1, "article"] == ["D::article::10"]
    assert got[2, "article"] == ["D::article::10", "D::article::2"] and (2, "clause") not in got
    assert got[3, "clause"] == ["D::article::2::clause::1"]
    assert got[4, "clause"] == ["D::article::2::clause::1"] and got[4, "point"] == ["D::article::2::clause::1::point::a", "D::article::2::clause::10::point::b"]
    assert not {k for k, _ in got} & {5, 6}


def test_pipeline_equals_plain_ranking(spark, tree):
    results = spark.createDataFrame([(1, 0, "D::article::2::clause::10", "Clause", 2.0), (1, 0, "D::article::2::clause::1", "Clause", 1.0), (1, 1, "D::article::2::clause::1", "Clause", 3.0)], "query_id int, sub_query_idx int, uid string, label string, score double")
    queries = spark.createDataFrame([(1, "mười khoản")], "query_id int, query_text string")
    graph = {**tree, "point": tree["node"].where("label = 'Point'").select("uid", F.col("number").alias("letter"), "content")}
    text = retrieval.rank_and_render(results, queries, graph, retrieval.Settings(expand=True, as_of="2020-01-02")).first().text
    # both contexts hold one of the two words; the abolished clause falls behind by five
    blocks = text.split("\n\n---\n\n")
    assert [b.split("\n")[0] for b in blocks] == ["[Văn bản: D — Hiệu lực: 2020-01-02]", "[ĐÃ BỊ BÃI BỎ bởi văn bản mới hơn]"]
    assert blocks[1].endswith("[Nội dung chi tiết]:\n  Điểm a. điểm a\n\n[LƯU Ý - NỘI DUNG SỬA ĐỔI]:\nĐã được sửa đổi/bổ sung bởi Khoản 1 Điều 1 E: khoản\nĐã được sửa đổi/bổ sung bởi Khoản 1 Điều 1 E: khoản")


def test_points_without_their_clause_are_left_out(spark, tree):
    nodes = tree["node"].unionByName(spark.createDataFrame([("D::article::2::clause::7::point::c", "Point", "c", None, "điểm c", "D")], tree["node"].schema))
    wanted = spark.createDataFrame([(1, "D::article::2"), (2, "D::article::2::clause::7::point::c"), (3, "D::article::2::clause::1::point::a")], "query_id int, uid string")
    got = {r.query_id: r.law_text for r in ctx.merged_law_text(wanted, nodes, tree["document"]).collect()}
    assert all("điểm c" not in t for t in got.values()) and "điểm a" in got[1] and "điểm a" in got[3]


def test_context_for_given_uids(spark, tree):
    graph = {**tree, "point": tree["node"].where("label = 'Point'").select("uid", F.col("number").alias("letter"), "content")}
    wanted = spark.createDataFrame([(1, 0, "D::article::2::clause::1"), (1, 1, "D::article::2::clause::1::point::a"), (2, 0, "nowhere")], "query_id int, rank int, uid string")
    got = {r.query_id: r.text for r in retrieval.context_for_uids(wanted, graph, True).collect()}
    clause, point = got[1].split("\n\n---\n\n")
    assert clause.startswith("[ĐÃ BỊ BÃI BỎ bởi văn bản mới hơn]\n[Văn bản: D") and clause.count("Điểm a. điểm a") == 1 and "[Các điểm khác" not in clause
    assert point.startswith("[Văn bản: D") and "Điểm a." in point and got[2] == ""


@pytest.mark.parametrize("mode", ["keyword", "vector", "hybrid"])
def test_retrieval_in_each_mode(spark, tree, mode):
    graph = {**tree, "point": tree["node"].where("label = 'Point'").select("uid", F.col("number").alias("letter"), "content")}
    nodes = srch.searchable_text(tree["node"].where("label in ('Article', 'Clause')")).select("uid", "label", "text")
    asked = [(1, 0, "mười"), (1, 1, "không có gì"), (2, 0, "khác"), (2, 1, "khoản")]
    q = spark.createDataFrame([(*r, f"{r[0]}/{r[1]}") for r in asked], "query_id int, sub_query_idx int, query_text string, uid string")
    q = q.join(srch.embed_text(q.select("uid", F.col("query_text").alias("text")), "uid", "text", 32, nodes), "uid").drop("uid")
    vectors = nodes.select("uid", "label").join(srch.embed_text(nodes, "uid", "text", 32), "uid")
    got = {r.query_id: r.text for r in retrieval.retrieve(q, nodes, graph, retrieval.Settings(mode=mode, top_k=1, heuristic=False), vectors).collect()}
    assert "Khoản 10." in got[1] and "Nội dung: mười" in got[1] and "Điều 1: Khác" in got[2]


def test_embedded_texts(spark):
    rows = [(1, "a b b"), (2, "a c"), (3, ""), (4, None)]
    got = {r.id: r.embedding for r in srch.embed_text(spark.createDataFrame(rows, "id int, text string"), "id", "text", 16).collect()}
    assert got[3] is None and got[4] is None and all(abs(sum(x * x for x in got[i]) - 1) < 1e-6 for i in (1, 2))
    asked = spark.createDataFrame([(9, "c zz")], "id int, text string")
    alone = srch.embed_text(asked, "id", "text", 16, spark.createDataFrame(rows, "id int, text string")).first().embedding
    assert sum(1 for x in alone if x) == 1  # a term the corpus lacks has no weight


def test_replies(spark):
    raw = ['{"scores": {"legal_accuracy": 1.5, "structure": 2}, "reasoning": "r", "comparison": "c"}', '{"score": 7}', "- **Reasoning:** vì vậy\n- **Comparison:** so\n- Score: [8]", "```json\n{\"scores\": [1], \"score\": 3, \"reasoning\": \"x\"}\n```", None, "{broken", '{"scores": null, "score": "5"}', "{'no': json}", "**REASONING**: :a:\nb**score** ** 12/20", '{"scores": {"structure": null}}']
    rows = ev.parse_judge(spark.createDataFrame(list(enumerate(raw)), "id int, raw_eval string")).orderBy("id").collect()
    assert [r.score for r in rows] == [3.5, 0.0, 8.0, 3.0, None, None, 5.0, None, 12.0, 0.0]
    assert [(r.reasoning, r.comparison) for r in rows] == [("r", "c"), ("", ""), ("vì vậy", "so"), ("x", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("a:\nb**score** ** 12/20", ""), ("", "")]
    assert [r.legal_accuracy for r in rows] == [1.5, *[0.0] * 9] and [r.structure for r in rows] == [2.0, *[0.0] * 9]
    plan = ev.judge_summary(ev.parse_judge(spark.createDataFrame(list(enumerate(raw)), "id int, raw_eval string")), [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # the reply, and its scores
    votes = ['{"answer": "Có"}', '{"answer": "không rõ"}', '{"answer": "?"} yes', "No.", "maybe", None]
    got = spark.createDataFrame(list(enumerate(votes)), "id int, raw string").orderBy("id").select(ev.parse_vote(F.col("raw")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, True, False, None, None]


def test_samples_and_tokens(spark):
    rows = [("doc", "sub", "q", ["x", "y"], "1", "<think>r</think>"), (None, None, "q", ["x"], "4", None), (None, None, "q", None, "kết <answer>luận</answer>", None), (None, None, "q", ["x"], None, None)]
    table = spark.createDataFrame(rows, "legal_document string, specific_question string, question string, choices array<string>, answer string, reasoning string")
    got = cp.format_samples(cp.detect_task(table)).collect()
    assert [r.task for r in got] == ["task1", "task2", "task3", "task3"]
    assert got[0].assistant == "r\n\n<answer>y</answer>" and got[0].user.startswith("Tài liệu pháp lý:\ndoc\n\nCâu hỏi cụ thể: sub\n\nCâu hỏi: q\nCác lựa chọn:\n  1. x\n  2. y\n\n")
    assert got[1].assistant == "\n\n<answer>Không xác định</answer>" and got[2].assistant == "kết luận\n\n<answer>kết luận</answer>"
    turned = spark.range(1).select(tx.turn_tokens(F.lit("<|im_start|>user a<|im_end|><think>"), F.lit("my-Gemma")).alias("x")).first().x
    assert turned == "<|turn>user a<turn|><|channel>thought"
    assert cp.only_named(table, spark.createDataFrame([("q",)], "n string"), "question").count() == 4 and cp.only_named(table, table.select("question"), "absent").count() == 4


def test_graph_summaries(spark):
    edges = spark.createDataFrame([("a", "b", "X", None, "1"), ("a", "c", "X", "p", None), ("b", "c", "Y", None, None)], "src string, dst string, type string, p string, q string")
    assert {(r.type, tuple(r.properties)) for r in g.edge_properties(edges, ["q", "p"]).collect()} == {("X", ("p", "q")), ("Y", ())}
    assert {(r.year, r.n) for r in g.issued_per_year(spark.createDataFrame([("2020-01-01T",), ("2020-02-03",), ("x",), (None,)], "d string"), "d").collect()} == {(2020, 2), (None, 2)}
    assert [r.asDict() for r in cp.children_histogram(edges, 10).where("type = 'Y'").collect()] == [{"type": "Y", "bin": 5, "parents": 1}]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "amends.json").write_text(json.dumps({"doc_identity": "D", "amends": [{"amending_article": "1", "amend_type": "bãi bỏ"}, {"amending_article": "2"}]}))
    assert [(r.seq, r.amending_article, r.amend_type) for r in rd.read_amends(spark, str(tmp_path / "amends.json")).collect()] == [(0, "1", "bãi bỏ"), (1, "2", None)]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "row_results_full.csv").write_text("id,recall_5\n1,1\n2,0\n")
    (runs / "row_results.csv").write_text("id,recall_5\n3,1\n")
    (runs / "other.csv").write_text("id\n9\n")
    assert {(r.id, r.config) for r in rd.read_row_results(spark, str(runs)).collect()} == {("1", "full"), ("2", "full"), ("3", "")}
    assert rd.read_row_results(spark, str(runs), ["full"]).count() == 2
    details = spark.createDataFrame([("g", "<p>x</p>", "n")], "docGUId string, docContent string, docName string")
    text, rest = rd.split_details(details)
    assert text.first().text.strip() == "x" and rest.columns == ["docGUId", "docName"]
    meta = spark.createDataFrame([("D", "g", "n", "a", "b", "c", "d", "e")], "docIdentity string, docGUId string, docName string, issueDate string, effectDate string, expireDate string, gazetteNumber string, gazetteDate string")
    assert rd.metadata_document(meta).first().asDict() == {"doc_identity": "D", "doc_guid": "g", "doc_name": "n", "issue_date": "a", "effect_date": "b", "expire_date": "c", "gazette_number": "d", "gazette_date": "e"}
    samples = spark.range(25_000).selectExpr("id", "if(id % 5 = 0, 'task1', 'task2') as task")
    keys = {r.id: r.key for r in rd.numbered_output(samples, "id").collect()}
    assert (keys[0], keys[24_995], keys[1], keys[24_999]) == ("0001_task1", "5000_task1", "0001_task2", "20000_task2") and len(set(keys.values())) == 25_000
    payload = spark.createDataFrame([("1", "q", ["u"])], "id string, question string, uids array<string>")
    rd.append_payloads(payload, str(tmp_path / "payload"), "a")
    assert rd.read_payloads(spark, str(tmp_path / "none")).collect() == []
    for run in range(2):  # the first run dies after its files and before its marker
        rd.append_payloads(payload.withColumn("id", F.lit("2")), str(tmp_path / "payload"), "b")
        if not run:
            (tmp_path / "payload" / "batch=b" / "_SUCCESS").unlink()
            assert [r.id for r in rd.read_payloads(spark, str(tmp_path / "payload")).collect()] == ["1"]
    done = rd.read_payloads(spark, str(tmp_path / "payload"))
    assert {(r.id, r.question, tuple(r.uids), r.top_k) for r in done.collect()} == {("1", "q", ("u",), None), ("2", "q", ("u",), None)}
    todo = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert [r.id for r in rd.unprocessed(todo, done).collect()] == ["3"]
    rd.write_parsed(details, str(tmp_path / "parsed"))
    assert rd.read_parsed(spark, str(tmp_path / "parsed"), details.schema).collect() == details.collect()
    rd.write_chatml(spark.createDataFrame([("a\nb",)], "text string"), str(tmp_path / "chat"))
    assert rd.read_chatml(spark, str(tmp_path / "chat")).first().text == "a\nb"
    assert spark.range(1).select(tx.to_bool(F.lit(" TRUE ")).alias("x")).first().x is True


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:05", "a", 1.0), (2, "2024-01-01 00:00:50", "a", 2.0), (2, "2024-01-01 00:00:51", "a", 2.0), (3, "2024-01-01 00:01:10", "b", 4.0)]
    source = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) as ts", "event_type", "value")
    source.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = jobs.request_totals(stream()).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("totals").collect()} == {("a", 3, 5.0), ("b", 1, 4.0)}
    q = jobs.skip_seen(stream(), "event_id").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("seen").collect()) == [1, 2, 3]


def test_an_id_is_skipped_long_after_the_watermark(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    for i, day in enumerate(("2024-01-01", "2024-01-05", "2024-02-01")):
        spark.createDataFrame([(1, f"{day} 00:00:00"), (10 + i, f"{day} 00:00:01")], "event_id long, t string").selectExpr("event_id", "cast(t as timestamp) as ts").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.skip_seen(stream, "event_id").writeStream.format("memory").queryName("ever").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("ever").collect()) == [1, 10, 11, 12]


def test_gate_by_recall_or_by_references(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.5, 1.0), (3, None, None)], "query_id int, recall_3 double, recall_12 double")
    refs = spark.createDataFrame([(1, "D::article::1"), (1, "E"), (2, "D")], "query_id int, reference string")
    ranked = spark.createDataFrame([(1, "D::article::1::clause::2", 1), (1, "E::article::9", 2), (2, "F", 1), (2, "D::article::3", 3)], "query_id int, uid string, rank int")
    ids = lambda df: sorted(r.query_id for r in df.collect())
    assert ids(ev.recall_gate(rows, 5)) == [1] and ids(ev.recall_gate(rows, -1)) == [2]
    assert ids(ev.recall_gate(rows, 5, ranked, refs)) == [1, 3]  # the third has no reference
    bare = rows.select("query_id")
    assert ids(ev.recall_gate(bare, 2, ranked, refs)) == [1, 3] and ids(ev.recall_gate(bare, 3, ranked, refs)) == [1, 2, 3] and ids(ev.recall_gate(bare, 1, ranked, refs)) == [3]


def test_generated_replies(spark):
    schema = "task1 string, task2 string"
    raw = ['{"task1": "a", "task2": "b"}', '```json\n{"task1": "a", "task2": "b"}\n```', 'Here: {"task1": "x [1, 2].", "task2": "y"} done', '{"task1": "only"}', "nothing", None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(raw)), "id int, raw string").orderBy("id").select(cp.parse_generated(F.col("raw"), schema, ("task1", "task2")).alias("x")).collect()]
    assert [x and (x.task1, x.task2) for x in got] == [("a", "b"), ("a", "b"), ("x.", "y"), None, None, None]


def test_substrings_compare_equal_needles_and_texts_once(spark):
    """Six hundred queries for three needles over 6,000 rows of ten texts; each size of gram."""
    texts = [f"Ngày 1996-03-{i:02d} thuộc chương {i} của văn bản số {i % 3}" for i in range(10)]
    rows = spark.range(6000).select("id", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 10 + 1).cast("int")).alias("x"))
    needles = ["1996-03-07", "n", "03", "ày ", "1996", "thuộc chương 4 của", texts[5].lower(), "", "không có"]
    pairs = srch.substring_pairs(spark.createDataFrame([(n,) for n in needles[:-2] + needles[-1:]], "needle string"), spark.createDataFrame([(t.lower(),) for t in texts], "t string"))
    assert sorted((r.needle, r.t) for r in pairs.collect()) == sorted((n, t.lower()) for n in needles if n for t in texts if n in t.lower())
    q = spark.range(600).select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, needles[:3])), (F.col("id") % 3 + 1).cast("int")).alias("needle"))
    empty = lambda schema: spark.createDataFrame([], schema)
    clauses = rows.select(F.col("id").cast("string").alias("uid"), F.lit("1").alias("number"), F.col("x").alias("content"), F.lit("D").alias("doc_identity"))
    written = lambda: set(storage.found(spark, f"{spark.conf.get('spark.checkpoint.dir')}/pairs-*"))
    before = written()
    found = srch.catalogue_search(q, empty("uid string, number string, title string, doc_identity string"), clauses, empty("uid string, number string, content string, doc_identity string, clause_num int"), empty("doc_identity string, doc_name string"))
    assert found.count() == 600 * 20
    assert sum(spark.read.parquet(p).count() for p in written() - before) <= 30  # of different needles and texts
