"""Hand-computed cases of the operators that SQL does not check."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.operators import context as ctx
from docgraph.operators import corpus as cp
from docgraph.operators import evaluation as ev
from docgraph.operators import graph as g
from docgraph.operators import parsing as ps
from docgraph.operators import search as srch
from docgraph.sources import readers as rd
from docgraph.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parse_levels_quotes_and_content(spark):
    text = "Lời nói đầu\nCHƯƠNG iv. Quy định\nMục 1. Chung\nĐiều 5a. Phạm vi\n1. Khoản một\nnối tiếp\na) Điểm a\n“1. trong ngoặc\nĐiều 9. vẫn trong ngoặc”.\nĐiều 6. Khác\na) không phải điểm\nfoo"
    df = spark.createDataFrame([("d", text)], "id string, text string")
    rows = {(r.kind, r.number): r for r in ps.parsed_nodes(ps.lines(df, "id", "text")).collect()}
    assert set(rows) == {("Chapter", "IV"), ("Section", "1"), ("Article", "5a"), ("Clause", "1"), ("Point", "a"), ("Article", "6")}
    assert rows["Clause", "1"].content == "Khoản một\nnối tiếp"
    assert rows["Point", "a"].content == "Điểm a\n“1. trong ngoặc\nĐiều 9. vẫn trong ngoặc”."
    assert (rows["Point", "a"].in_article, rows["Point", "a"].in_clause, rows["Point", "a"].in_chapter) == ("5a", "1", "IV")
    assert rows["Article", "6"].content == "a) không phải điểm\nfoo" and rows["Article", "6"].order == 1
    assert ps.preambles(ps.lines(df, "id", "text")).first().preamble == "Lời nói đầu"


def test_containment_edges_and_bundles(spark):
    text = "đầu\nPhần thứ nhất x\nChương I. x\nMục 1. x\nĐiều 1. x\n1. x\na) x\nChương II. x\nĐiều 2. x"
    docs = spark.createDataFrame([("d", text), ("e", "Điều 1. x"), ("f", "")], "doc string, text string")
    rows = ps.lines(docs, "doc", "text")
    nodes = ps.parsed_nodes(rows)
    edges = ps.containment_edges(nodes)
    got = {(r.doc, r.type, r.from_label, r.from_id, r.to_id) for r in edges.collect()}
    assert got == {
        ("d", "HAS_PART", "Document", "d", "nhất"),
        ("d", "HAS_CHAPTER", "Part", "nhất", "nhất.I"),
        ("d", "HAS_SECTION", "Chapter", "nhất.I", "nhất.I.1"),
        ("d", "HAS_ARTICLE", "Section", "nhất.I.1", "1"),
        ("d", "HAS_CLAUSE", "Article", "1", "1"),
        ("d", "HAS_POINT", "Clause", "1.1", "a"),
        ("d", "HAS_CHAPTER", "Part", "nhất", "nhất.II"),
        ("d", "HAS_ARTICLE", "Chapter", "nhất.II", "2"),
        ("e", "HAS_ARTICLE", "Document", "e", "1"),
    }
    bundles = {r.doc: r for r in ps.document_bundles(docs.select("doc"), nodes, edges, ps.preambles(rows)).collect()}
    assert len(bundles["d"].nodes) == 8 and len(bundles["d"].relationships) == 8 and bundles["d"].preamble == "đầu"
    assert bundles["f"].nodes is None and bundles["f"].preamble == ""


def test_replies(spark):
    intent = lambda x: one(spark, ps.parse_intent(F.lit(x)))
    assert intent('```json\n{"intent": "Reject"}\n```') == "reject"
    assert intent("so 'intent': 'cypher_query' it is") == "cypher_query"
    assert intent('{"intent": "dance"}') == intent("none") == intent(None) == "retrieve"
    queries = lambda x: one(spark, ps.parse_sub_queries(F.lit(x)))
    assert queries('```\n[{"query": "a"}, {"q": 1}, {"query": 2}, "b"]\n```') == ["a", "2"]
    assert queries('Here: [{"query": "a"}] done') == ["a"]
    assert queries("nothing") == queries('{"query": "a"}') == queries(None) == []
    assert one(spark, ps.rerank_query(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a b"


def test_window_parser_equals_state_machine(spark):
    import random

    rnd = random.Random(3)
    pool = ["Phần thứ nhất x", "Chương I. x", "Mục 1. x", "Điều 1. x", "1. x", "a) x", "text", '"quoted', 'end"', '"both"']
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(30))) for i in range(60)]
    got = {}
    for r in ps.classify_lines(ps.lines(spark.createDataFrame(docs, "id int, text string"), "id", "text")).collect():
        got.setdefault(r.doc, {})[r.line] = r.kind
    for i, text in docs:
        quoted, article, clause = False, False, False
        for n, line in enumerate(text.split("\n")):
            kind, inside = None, quoted or line.startswith('"')
            if inside:
                quoted = not line.endswith('"')
            elif line.startswith(("Phần", "Chương", "Mục")):
                kind, article, clause = {"P": "Part", "C": "Chapter", "M": "Section"}[line[0]], False, False
            elif line.startswith("Điều"):
                kind, article, clause = "Article", True, False
            elif line.startswith("1.") and article:
                kind, clause = "Clause", True
            elif line.startswith("a)") and clause:
                kind = "Point"
            assert got[i][n] == kind, (text, n)


def test_footer_and_html(spark):
    body, footer = ps.split_footer(F.lit("a\nb\nNơi nhận: x\ny"))
    assert one(spark, body) == "a\nb\n" and one(spark, footer) == "Nơi nhận: x\ny"
    page = '<p>a &amp; b</p><script>var t="</p>x";</script><!-- c --><div>d</div>'
    assert one(spark, ps.html_to_text(F.lit(page))) == "\na & b\nd"
    assert one(spark, tx.nfc(F.lit("é"))) == "é"


def test_uids(spark):
    assert one(spark, g.build_uid("section", F.lit("d"), F.lit("1"), part=F.lit(None).cast("string"), chapter=F.lit("II"))) == "d::chapter::II::section::1"
    assert one(spark, g.resolve_structural_id(F.lit("d"), F.lit("Point"), F.lit("5.2.a"))) == "d::article::5::clause::2::point::a"
    assert one(spark, g.resolve_structural_id(F.lit("d"), F.lit("Clause"), F.lit("5.2"))) == "d::article::5::clause::2"
    assert one(spark, g.deepest_uid(F.lit("d"), F.lit("5"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "d::article::5"
    assert one(spark, tx.format_uid(F.lit("d::article::5::clause::2"))) == "Khoản 2 Điều 5 d"


def test_upserts(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (2, 1, "b", None)], "id int, seq int, p string, q string")
    assert {r.id: (r.p, r.q) for r in g.upsert_dimension(rows, "id", "seq").collect()} == {1: ("a", "x"), 2: ("b", None)}
    full = spark.createDataFrame([("k1", None), ("k2", "n2")], "key string, doc_name string")
    stub = spark.createDataFrame([("k1", "s1"), ("k2", "s2"), ("k3", "s3")], "key string, doc_name string")
    assert {r.key: r.doc_name for r in g.fill_stubs(full, stub, "key", ["doc_name"]).collect()} == {"k1": "s1", "k2": "n2", "k3": "s3"}


def test_metrics_keep_their_definitions(spark):
    ranked = spark.createDataFrame([(1, "d::article::10", 1), (1, "d::article::2", 2), (1, "x", 3)], "query_id int, uid string, rank int")
    refs = spark.createDataFrame([(1, "d::article::1"), (1, "d::article::2"), (1, "zz")], "query_id int, reference string")
    row = ev.retrieval_metrics(ranked, refs).first()
    assert (row.recall_1, row.recall_3, row.precision_3, row.mrr) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 1.0)
    assert ev.retrieval_metrics(ranked, refs, boundary=True).first().recall_1 == 0.0


def test_combination_of_parts(spark):
    # recall@5 of the four published parts and of their combination
    parts = spark.createDataFrame([("plain", 1.0, 50), ("plain", 0.5, 50)], "config string, recall_5 double, num_evaluated int")
    row = ev.combine_parts(parts).first()
    assert (row.recall_5, row.num_evaluated) == (0.75, 100)


def test_fusion_rejects_unknown(spark):
    with pytest.raises(ValueError):
        srch.fuse(spark.range(1), "other")


def test_answer_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b c d", "a c x d"), (3, "a b", "x y"), (4, "a", "")], "id int, reference_text string, candidate_text string")
    rows = {r.id: r for r in ev.rouge_meteor(pairs, ["id"]).collect()}
    assert rows[1].rouge_l == 1.0 and rows[2].rouge_l == 0.75 and rows[3].rouge_l == 0.0 and rows[4].meteor == 0.0
    assert rows[1].meteor == pytest.approx(1 - 0.5 * (1 / 5) ** 3, abs=1e-6)
    bleu = {r.id: r.bleu for r in ev.bleu(pairs, ["id"]).collect()}
    assert bleu[1] == 1.0 and 0 < bleu[2] < 1 and bleu[4] == 0.0
    vec = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "id int, ref array<array<double>>, cand array<array<double>>")
    assert ev.embedding_f1(vec, ["id"]).first().f1 == pytest.approx(2 / 3, abs=1e-6)


def test_votes(spark):
    for raw, want in (('{"answer": "yes"}', True), ("```json\n{\"answer\": \"không\"}\n```", False), ("không có", True), ("maybe", None)):
        assert one(spark, ev.parse_vote(F.lit(raw))) is want
    votes = spark.createDataFrame([(1, True), (1, False), (1, False), (2, False)], "id int, vote boolean")
    assert {r.id: r.verdict for r in ev.majority(votes, ["id"]).collect()} == {1: True, 2: True}
    assert {r.id: r.verdict for r in ev.majority(votes, ["id"], strict=True).collect()} == {1: False, 2: False}


def test_text_helpers(spark):
    assert one(spark, tx.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, tx.clean_id(F.lit(" 1.0 "))) == "1"
    assert one(spark, tx.parse_list(F.lit(" a; b ,,c"), 2)) == ["a", "b"]
    assert one(spark, tx.has_punctuation(F.lit("a_b"))) is False and one(spark, tx.has_punctuation(F.lit("a-b"))) is True
    assert one(spark, tx.short_name(F.lit("Nghị định số 1"), F.lit("1/NĐ"))) == "Nghị định 1/NĐ"
    assert one(spark, tx.bullets(F.array(F.lit("a"), F.lit("b")))) == "- a\n- b"
    assert one(spark, cp.strip_answer_tags(F.lit("<think>x</think> <answer>y</answer>"))) == "x y"
    assert one(spark, ev.guard(F.lit("ERROR: x"), F.lit(3.0))) == 0.0


def test_sources(spark, tmp_path):
    meta = {"docGUId": "g", "docName": "N", "docIdentity": "1/X", "effectDate": "2020-01-01T00:00:00", "docGroup": {"docGroupId": 1, "docGroupName": "G"}, "organs": [{"organId": 7, "organName": "O"}], "docListOther": [{"docGUId": "h", "docName": "M"}]}
    (tmp_path / "a.json").write_text(json.dumps(meta))
    (tmp_path / "a.txt").write_text("Điều 1. x")
    (tmp_path / "2-Y.txt").write_text("only text")
    m = rd.read_metadata(spark, str(tmp_path))
    pairs = {r.stem: r.doc_identity for r in rd.pair_documents(m, rd.read_texts(spark, str(tmp_path))).collect()}
    assert pairs == {"a": "1/X", "2-Y": "2/Y"}
    assert {(r.type, r.id) for r in rd.metadata_dimensions(m).collect()} == {("BELONGS_TO_GROUP", 1), ("ISSUED_BY", 7)}
    assert rd.related_stubs(m).first().target == "h"
    qa = tmp_path / "qa"
    qa.mkdir()
    (qa / "q.csv").write_text(" ID ,Question,answer,reference\n1,q,a,r\n")
    assert rd.read_qa(spark, str(qa)).columns == ["id", "question", "answer", "reference"]
    (qa / "q.csv").write_text("id,question\n1,q\n")
    with pytest.raises(ValueError):
        rd.read_qa(spark, str(qa))
    items = tmp_path / "items"
    items.mkdir()
    (items / "i.json").write_text(json.dumps({"x": {"document_name": "d", "noi_dung": "c", "aspects": ["p"]}}))
    row = rd.read_items(spark, str(items)).first()
    assert (row.document_name, row.content, row.aspects) == ("d", "c", ["p"])


def test_streaming_upsert_and_totals(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "uid int, seq int, v string"
    add = lambda i, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"f{i}"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    run = lambda: jobs.upsert_stream(stream(), str(out), str(tmp_path / "cp"), "uid", "seq", parts=8).awaitTermination(120)
    now = lambda: {r.uid: r.v for r in jobs.read_upserted(spark, str(out), schema).collect()}
    files = lambda: {str(p.relative_to(out)) for p in out.glob("data/*/*/*.parquet")}
    assert now() == {}
    add(0, [(i, 1, f"v{i}") for i in range(40)])
    run()
    assert now() == {i: f"v{i}" for i in range(40)}
    first = files()
    add(1, [(1, 2, "c"), (1, 0, "late")])
    run()
    want = {i: f"v{i}" for i in range(40)} | {1: "c"}
    assert now() == want and first <= files() and len(files()) == len(first) + 1  # one part is written anew
    shutil.rmtree(out / "manifest" / "version=1")  # the batch died before it was committed
    assert now() == want | {1: "v1"}
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert now() == want and len(files()) == len(first) + 1
    add(2, [(1, 3, "d")])
    run()
    assert now() == want | {1: "d"}
    add(3, [(1, 4, "e")])
    run()
    assert now() == want | {1: "e"} and len(files()) == len(first) + 1  # what no kept manifest names is gone


def test_context_layout(spark):
    rows = spark.createDataFrame([(1, 1, "u", "ctx", ["bãi bỏ"], None, "kids", None)], "query_id int, rank int, uid string, context string, flags array<string>, siblings string, children string, amendments string")
    assert ctx.assemble_context(rows).first().text == "[ĐÃ BỊ BÃI BỎ bởi văn bản mới hơn]\nctx\n\n[Nội dung chi tiết]:\nkids"


def test_stacked_text_plain_words_and_row_window(spark):
    nodes = spark.createDataFrame([("a", "Article", "Cá", None), ("b", "Clause", " ", "X")], "uid string, label string, title string, content string")
    assert {tuple(r) for r in cp.stacked_text(nodes, ["title", "content"]).collect()} == {("a", "Article", "cá"), ("b", "Clause", "x")}
    text = spark.createDataFrame([("a_b c, d  e",), (None,)], "text string")
    assert [r[0] for r in text.select(cp.plain_words(F.col("text"))).collect()] == [["a_b", "d", "e"], []]
    rows = spark.range(10)
    assert [r.id for r in ev.row_window(rows, ["id"], 7).collect()] == [7, 8, 9]
    assert [r.id for r in ev.row_window(rows, ["id"], 2, 2).collect()] == [2, 3]
