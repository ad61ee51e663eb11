"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import text as tx
from docgraph.functions.storage import stored
from docgraph.operators import context as ctx
from docgraph.operators import corpus as cp
from docgraph.operators import evaluation as ev
from docgraph.operators import graph as g
from docgraph.operators import parsing as ps
from docgraph.operators import search as srch
from docgraph.operators.tree import ancestors, interval_labels
from docgraph.plans import retrieval
from docgraph.plans.fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the derived tables under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_COS = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::double * z[2]::double)), 6)"
_RANKED = f"ranked as (select * from (select q.query_id, v.uid, v.label, {_COS} as score, row_number() over (partition by q.query_id, v.label order by {_COS} desc, v.uid) as lr from t_query q cross join t_vector v) where lr <= 5)"
_MERGED = "merged as (select query_id, uid, label, score, row_number() over (partition by query_id order by score desc, uid) as rank from ranked)"
_METRIC = """hits as (select m.query_id, min(rank) as best from merged m join t_query q using (query_id) where starts_with(m.uid, q.reference) group by 1)"""


def _merged(t: Tables) -> DataFrame:
    found = srch.vector_search(t.query, t.vector, 5).drop("rank")
    return srch.top_k(found, ["query_id"], 1 << 30, [F.desc("score"), F.col("uid")])


# -- search ------------------------------------------------------------------


@query(with_tables("select query_id, uid, label, score, lr as rank from ranked", _RANKED))
def d3_vector_topk_per_label(t):
    return srch.vector_search(t.query, t.vector, 5)


@query(with_tables("select * from merged where rank <= 30", f"{_RANKED}, {_MERGED}"))
def d3_vector_topk_merged(t):
    return _merged(t).where("rank <= 30")


@query(with_tables(f"select * from (select q.query_id, v.uid, v.label, {_COS} as score, row_number() over (partition by q.query_id order by {_COS} desc, v.uid) as rank from t_query q cross join t_vector v where v.label = 'L3') where rank <= 5"))
def d4_vector_one_label(t):
    return srch.vector_search(t.query, t.vector.where("label = 'L3'"), 5, per_label=False)


_BM = f"""toks as (select doc_id as id, unnest({_TOK.format('text')}) as term from documents),
tf as (select id, term, count(*) as tf from toks group by 1, 2),
dl as (select doc_id as id, len({_TOK.format('text')}) as dl from documents),
st as (select count(*) as n, avg(dl) as avg_dl from dl),
df as (select term, count(*) as df from tf group by 1),
q as (select item_id as query_id, unnest(list_distinct({_TOK.format('text')})) as term from benchmark),
bm as (select query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) as score
  from q join tf using (term) join df using (term) join dl on dl.id = tf.id cross join st group by 1, 2),
kw as (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from bm) where rank <= 30)"""


def _benchmark_queries(t):
    return t.read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(f"with {_BM} select term, df.df, (select sum(tf) from tf where tf.term = df.term) as cf from df")
def d5_term_statistics(t):
    return srch.term_statistics(srch.postings(t.read("documents"), "doc_id", "text")).select("term", "df", "cf")


@query(f"with {_BM} select query_id, id, score, rank from kw")
def d6_bm25_topk(t):
    return srch.keyword_search(_benchmark_queries(t), t.read("documents"), "doc_id", "text", "query_text", 30).select("query_id", "id", "score", "rank")


@query(
    f"""with {_BM}, v as (
  select * from (select b.item_id as query_id, e.vec_id as id, row_number() over (partition by b.item_id order by round(list_sum(list_transform(list_zip(s.embedding, e.embedding), lambda z: z[1]::double * z[2]::double)), 6) desc, e.vec_id) as rank
  from benchmark b join embeddings s on s.vec_id = b.item_id cross join embeddings e) where rank <= 30),
u as (select query_id, id, rank from v union all select query_id, id, rank from kw)
select * from (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) as score, row_number() over (partition by query_id order by round(sum(1.0::double / (60 + rank)), 9) desc, id) as rank from u group by 1, 2) where rank <= 30"""
)
def d8_hybrid_rrf(t):
    kw = srch.keyword_search(_benchmark_queries(t), t.read("documents"), "doc_id", "text", "query_text", 30).select("query_id", "id", "rank")
    e = t.read("embeddings").select(F.col("vec_id").alias("uid"), F.lit("all").alias("label"), "embedding")
    q = _benchmark_queries(t).join(e.select(F.col("uid").alias("query_id"), "embedding"), "query_id")
    vec = srch.vector_search(q, e, 30, per_label=False).select("query_id", F.col("uid").alias("id"), "rank")
    return srch.reciprocal_rank_fusion([vec, kw], ["query_id", "id"], 30)


_SUB = "sub as (select query_id // 100 as query_id, query_id as sub_query_idx, uid, label, score, row_number() over (partition by query_id // 100, query_id order by score desc, label, uid) as r from ranked)"


def _sub_results(t):
    return srch.vector_search(t.query, t.vector, 5).select(F.expr("query_id div 100").alias("query_id"), F.col("query_id").alias("sub_query_idx"), "uid", "label", "score")


def _fusion(strategy, sql):
    def run(t):
        return srch.fuse(_sub_results(t), strategy, 30)

    run.__name__ = f"d10_fuse_{strategy}"
    query(with_tables(f"select * from (select query_id, uid, label, {sql} as score, row_number() over (partition by query_id order by {sql} desc, label, uid) as rank from sub group by 1, 2, 3) where rank <= 30", f"{_RANKED}, {_SUB}"))(run)


_fusion("rrf", "round(sum(1.0::double / (60 + r)), 9)")
_fusion("borda", "round(avg(score), 9)")
_fusion("max", "round(max(score), 9)")


@query(with_tables("select query_id, sub_query_idx, uid, label, score from sub", f"{_RANKED}, {_SUB}"))
def d9_multi_search(t):
    return _sub_results(t)


_NEEDLES = "needles as (select *, case when starts_with(needle, 'điều ') then substr(needle, 6) else needle end as asked from (select number::int as query_id, lower(case when number::int % 100 = 0 then 'Điều ' || number when number::int % 150 = 0 then split_part(uid, '::', 1) else title end) as needle from t_article where number::int % 50 = 0))"
_HITS = """dh as (select query_id, doc_identity, contains(lower(doc_name), needle) as by_name, contains(lower(doc_identity), needle) as by_id from needles join t_document on contains(lower(doc_name), needle) or contains(lower(doc_identity), needle)),
near as (select query_id, doc_identity from dh union select query_id, doc_identity from needles join t_article on contains(lower(title), needle)),
ah as (select query_id, 'article' as kind, a.uid, row_number() over (partition by query_id order by a.number = asked desc, coalesce(by_name, false) desc, coalesce(by_id, false) desc, a.doc_identity, a.uid) as rank
  from needles join t_article a on a.number = asked or contains(lower(a.title), needle) or contains(lower('Document ' || a.doc_identity), needle) left join dh using (query_id, doc_identity)),
ch as (select query_id, 'clause' as kind, c.uid, row_number() over (partition by query_id order by n.query_id is not null desc, c.number = asked desc, c.doc_identity, c.number::int, c.uid) as rank
  from needles join t_clause c on contains(lower(c.content), needle) left join near n using (query_id, doc_identity)),
ph as (select query_id, 'point' as kind, p.uid, row_number() over (partition by query_id order by n.query_id is not null desc, p.doc_identity, p.parent_clause::int, p.letter, p.uid) as rank
  from needles join t_point p on contains(lower(p.content), needle) left join near n using (query_id, doc_identity))"""


def _needles(t):
    number = F.col("number").cast("int")
    needle = F.when(number % 100 == 0, F.concat(F.lit("Điều "), "number")).when(number % 150 == 0, F.col("doc_identity")).otherwise(F.col("title"))
    return t.article.where(number % 50 == 0).select(number.alias("query_id"), needle.alias("needle"))


def _catalogue(t):
    points = t.point.select("uid", F.col("letter").alias("number"), "content", "doc_identity", F.col("parent_clause").cast("int").alias("clause_num"))
    return t.article, t.clause, points, t.document


@query(with_tables("select * from ah where rank <= 20 union all select * from ch where rank <= 20 union all select * from ph where rank <= 20", f"{_NEEDLES}, {_HITS}"))
def d11_catalogue_search(t):
    """Every fiftieth article's number, title or document as a needle."""
    return srch.catalogue_search(_needles(t), *_catalogue(t))


_CONTENT = "needles as (select o_orderkey::int as query_id, lower(o_orderpriority || ' ' || o_orderstatus) as needle, '' as asked from orders where o_orderkey % 5000 = 0 union all select l_orderkey::int + 100000000, min(strftime(l_shipdate, '%Y-%m-%d')), '' from lineitem where l_orderkey % 500 = 0 group by 1)"


@query(with_tables("select * from ch where rank <= 20 union all select * from ph where rank <= 20", f"{_CONTENT}, {_HITS.replace('c.number = asked desc', '1').replace('a.number = asked', 'false')}"))
def d11_content_search(t):
    """Contents of some clauses and points as needles."""
    o = t.read("orders").where("o_orderkey % 5000 = 0").select(F.col("o_orderkey").cast("int").alias("query_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("needle"))
    li = t.read("lineitem").where("l_orderkey % 500 = 0").groupBy((F.col("l_orderkey").cast("int") + 100_000_000).alias("query_id")).agg(F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("needle"))
    return srch.catalogue_search(o.unionByName(li), *_catalogue(t)).where("kind <> 'article'")


@query(with_tables("select doc_identity, parent_article, 'clause' as kind, uid, row_number() over (partition by doc_identity, parent_article order by number::int, uid) as pos from t_clause where parent_article::int % 50 = 0 union all select doc_identity, parent_article, 'point', uid, row_number() over (partition by doc_identity, parent_article order by parent_clause::int, letter, uid) from t_point where parent_article::int % 50 = 0"))
def d13_article_children(t):
    wanted = t.article.where(F.col("number").cast("int") % 50 == 0).select("doc_identity", F.col("number").alias("parent_article"))
    return srch.article_children(wanted, t.clause, t.point)


@query(with_tables("select label, case when label = 'Article' then trim(concat_ws(' ', nullif(title, ''), nullif(content, ''))) else content end as text, uid from t_node where label <> 'Document'"))
def d1_searchable_text(t):
    return srch.searchable_text(t.node.where("label <> 'Document'")).select("label", "text", "uid")


# -- retrieval evaluation ------------------------------------------------------

_ROWS = "rows as (select q.query_id, " + ", ".join(f"round(coalesce((best <= {k})::int, 0)::double, 6) as recall_{k}" for k in ev.RECALL_AT) + ", " + ", ".join(f"round(coalesce((best <= {k})::int, 0) / {k}, 6) as precision_{k}" for k in ev.PRECISION_AT) + ", round(coalesce(1.0::double / best, 0), 6) as mrr from t_query q left join hits using (query_id))"


def _references(t):
    return t.query.select("query_id", "reference")


@query(with_tables("select * from rows", f"{_RANKED}, {_MERGED}, {_METRIC}, {_ROWS}"))
def g3_row_metrics(t):
    return ev.retrieval_metrics(_merged(t), _references(t))


@query(with_tables("select " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ev.METRICS) + ", count(*) as num_evaluated from rows", f"{_RANKED}, {_MERGED}, {_METRIC}, {_ROWS}"))
def g5_run_summary(t):
    return ev.run_summary(ev.retrieval_metrics(_merged(t), _references(t)))


_GRID = "grid as (select c.config, m.query_id, m.uid, row_number() over (partition by c.config, m.query_id order by case c.config when 'reversed' then -m.score else m.score end desc, m.uid) as rank from merged m cross join (values ('full'), ('reversed'), ('one_label')) c(config) where c.config <> 'one_label' or m.label = 'L1'), ghits as (select config, query_id, min(rank) as best from grid join t_query q using (query_id) where starts_with(grid.uid, q.reference) group by 1, 2), grows as (select c.config, q.query_id, best from (values ('full'), ('reversed'), ('one_label')) c(config) cross join t_query q left join ghits g on g.config = c.config and g.query_id = q.query_id), gsum as (select config, " + ", ".join(f"round(avg(round(coalesce((best <= {k})::int, 0)::double, 6)), 6) as recall_{k}" for k in ev.RECALL_AT) + ", " + ", ".join(f"round(avg(round(coalesce((best <= {k})::int, 0) / {k}, 6)), 6) as precision_{k}" for k in ev.PRECISION_AT) + ", round(avg(round(coalesce(1.0::double / best, 0), 6)), 6) as mrr, count(*) as num_evaluated from grows group by 1)"


def _grid_summary(t):
    m = _merged(t)
    configs = F.explode(F.array(F.lit("full"), F.lit("reversed"), F.lit("one_label")))
    grid = m.withColumn("config", configs).where((F.col("config") != "one_label") | (F.col("label") == "L1"))
    order = F.when(F.col("config") == "reversed", -F.col("score")).otherwise(F.col("score"))
    ranked = srch.top_k(grid.withColumn("s", order).drop("rank"), ["config", "query_id"], 1 << 30, [F.desc("s"), F.col("uid")])
    ranked = stored(ranked.select("config", "query_id", "uid", "rank"), "grid")  # the metrics read it twice, each time with its search
    return ev.run_summary(ev.retrieval_metrics(ranked, _references(t)))


@query(with_tables("select * from gsum", f"{_RANKED}, {_MERGED}, {_GRID}"))
def g6_ablation_grid(t):
    return _grid_summary(t)


@query(with_tables("select s.config, " + ", ".join(f"round(s.{m} - b.{m}, 6) as {m}" for m in ev.METRICS) + " from gsum s cross join (select * from gsum where config = 'full') b", f"{_RANKED}, {_MERGED}, {_GRID}"))
def g7_delta_to_baseline(t):
    return ev.delta_to_baseline(_grid_summary(t), "full")


# -- graph ---------------------------------------------------------------------


@query(with_tables("select uid, letter, content, doc_identity from t_point"))
def c3_node_upsert(t):
    return t.point.select("uid", "letter", "content", "doc_identity")


@query(with_tables("select doc_identity || '::article::' || parent_article || '::clause::' || parent_clause || '::point::' || letter as uid from t_point"))
def c1_build_uids(t):
    return t.point.select(g.build_uid("point", F.col("doc_identity"), F.col("letter"), article=F.col("parent_article"), clause=F.col("parent_clause")).alias("uid"))


@query(with_tables("select src, dst, type from t_edge"))
def c6_edge_upsert(t):
    twice = t.edge.withColumn("time", F.explode(F.array(F.lit(1), F.lit(2)))).drop("time")
    return g.upsert_edges(twice, t.node)


@query(with_tables("select src_uid, dst_uid, max(amend_type) as amend_type from t_amends group by 1, 2"))
def c7_amendment_edges(t):
    return g.amendment_edges(t.amends, t.node)


@query(with_tables("select 'Point' as label, uid, count(*) as n from t_point_raw group by 2 having count(*) > 1"))
def c8_key_violations(t):
    return g.key_violations(t.point_raw.withColumn("label", F.lit("Point")))


@query(with_tables("select s.label as src_label, e.type, d.label as dst_label, count(*) as n from t_edge e join t_node s on s.uid = e.src join t_node d on d.uid = e.dst group by 1, 2, 3"))
def c10_schema_triples(t):
    return g.schema_triples(t.node, t.edge)


_CLOSE = "close as (select src as anc, dst, 1 as depth from t_edge union all select c.anc, e.dst, c.depth + 1 from close c join t_edge e on e.src = c.dst where c.depth < 6)"


@query(with_tables("select uid, level, coalesce(n, 0) as n_below from (select dst as uid, max(depth)::int as level from close group by 1 union all select distinct src, 0 from t_edge where src not in (select dst from t_edge)) left join (select anc as uid, count(*) as n from close group by 1) using (uid)", _CLOSE))
def c11_tree_intervals(t):
    """Level of each node and how many nodes its interval holds."""
    return interval_labels(t.edge).select("uid", "level", (F.col("last") - F.col("pre")).alias("n_below"))


@query(with_tables("select anc, dst, depth from close join t_article on anc = t_article.uid", _CLOSE))
def c14_descendants_by_sweep(t):
    """Clauses and points of each article, from intervals."""
    return ancestors(interval_labels(t.edge), 2).join(t.article.select(F.col("uid").alias("anc")), "anc")


@query(with_tables("select anc, dst, depth from close", _CLOSE))
def c11_closure(t):
    return g.closure(stored(t.edge, "edge"), 4)


@query(with_tables("select anc as doc_identity, " + ", ".join(f"count(*) filter (label = '{x}') as n_{x.lower()}s" for x in ("Chapter", "Article", "Clause", "Point")) + " from close join t_document on doc_identity = anc join t_node n on n.uid = dst group by 1", _CLOSE))
def c12_descendant_counts(t):
    return g.descendant_counts(g.closure(stored(t.edge, "edge"), 4), t.node, t.document)


@query(with_tables("select anc as doc_identity, count(*) as n_hits from close join t_document on doc_identity = anc join t_node n on n.uid = dst where lower(n.content) like '%urgent%' group by 1", _CLOSE))
def c12_documents_with_phrase(t):
    return g.documents_with_phrase(g.closure(stored(t.edge, "edge"), 4), t.node, t.document, "urgent")


@query(with_tables("select uid, label, title, content from t_node where label = 'Article'"))
def c13_node_lookup(t):
    return g.fetch_nodes(t.node, t.article.select("uid", F.lit("Article").alias("label")))


@query(with_tables("select anc as uid, dst as descendant, depth from close where anc in (select uid from t_article)", _CLOSE))
def c14_descendants(t):
    return g.descendants(g.closure(stored(t.edge, "edge"), 4), t.article)


# -- context -------------------------------------------------------------------

def _targets(t):
    return t.point.select("uid")


@query(
    with_tables(
        """select p.uid, '[Văn bản: ' || p.doc_identity || ' — Hiệu lực: ' || coalesce(d.effect_date, 'N/A') || ']' || chr(10) || 'Chương ' || ch.number || ': ' || ch.title || chr(10) || 'Điều ' || a.number || ': ' || a.title
  || chr(10) || 'Khoản ' || c.number || '.' || chr(10) || c.content || chr(10) || 'Điểm ' || p.letter || '.' || chr(10) || 'Nội dung: ' || p.content as context
  from t_point p join t_document d using (doc_identity) join t_clause c on c.number = p.parent_clause join t_article a on a.number = p.parent_article join t_chapter ch on ch.doc_identity = a.doc_identity and ch.number = a.parent_chapter"""
    )
)
def e1_hierarchy_text(t):
    return ctx.hierarchy_text(_targets(t), t.node, t.edge, t.document)


@query(with_tables("select uid, 'Điểm ' || letter || ' Khoản ' || parent_clause || ' Điều ' || parent_article || ' ' || doc_identity as display from t_point"))
def e3_format_uid(t):
    return t.point.select("uid", tx.format_uid(F.col("uid")).alias("display"))


@query(
    with_tables(
        """select distinct r.uid, a.src_uid, a.dst_uid, a.amend_type, n.content as amend_text, d.effect_date
  from (select dst as uid, anc as dst_uid from close union all select anc, dst from close union all select uid, uid from t_node) r
  join t_clause w on w.uid = r.uid join t_amends a on a.dst_uid = r.dst_uid join t_node n on n.uid = a.src_uid join t_document d on d.doc_identity = n.doc_identity""",
        _CLOSE,
    )
)
def e4_amendments(t):
    return ctx.amendments_of(t.clause, t.amends, t.edge, t.node, t.document)


@query(with_tables("select uid, coalesce(array_to_string(list_sort(f), ','), '') as flags from t_clause left join (select dst_uid, list(distinct amend_type) as f from t_amends where amend_type in ('bãi bỏ', 'thay thế') group by 1) on dst_uid = uid"))
def e6_status_flags(t):
    return ctx.status_flags(t.clause, t.amends).select("uid", F.array_join("flags", ",").alias("flags"))


@query(with_tables("select uid, d.effect_date from t_clause join t_document d using (doc_identity)"))
def e7_effect_dates(t):
    return ctx.effect_dates(t.clause, t.document)


@query(with_tables("select p.uid, string_agg('  Điểm ' || o.letter || '. ' || o.content, chr(10) order by o.letter) as siblings from t_point p join t_point o on o.parent_clause = p.parent_clause and o.uid <> p.uid group by 1"))
def e8_sibling_points(t):
    return ctx.sibling_points(t.point, t.point)


@query(with_tables("select c.uid, string_agg('  Điểm ' || p.letter || '. ' || p.content, chr(10) order by p.uid) as children from t_clause c join t_point p on p.parent_clause = c.number group by 1"))
def e9_children(t):
    return ctx.children_text(t.clause, t.node)


@query(with_tables("select uid, case when uid like '%::point::%' then 'Point' when uid like '%::clause::%' then 'Clause' else 'Article' end as label from t_node where label in ('Point', 'Clause', 'Article')"))
def e11_label_from_uid(t):
    return t.node.where(F.col("label").isin("Point", "Clause", "Article")).select("uid", tx.label_from_uid(F.col("uid")).alias("label"))


def _law_nodes(t):
    """Articles, clauses and points, derived once."""
    return stored(t.node.where(F.col("label").isin("Article", "Clause", "Point")).select("uid", "label", "title", "content"), "law-nodes")


_TITLE = "'Document ' || a.doc_identity || chr(10) || 'Điều ' || a.number || '. ' || a.title"


@query(
    with_tables(
        f"""select c.uid, {_TITLE} || chr(10) || c.number || '. ' || c.content as law_text from t_clause c join t_article a on a.number = c.parent_article
  union all select p.uid, {_TITLE} || chr(10) || c.number || '. ' || c.content || chr(10) || p.letter || ') ' || p.content from t_point p join t_clause c on c.number = p.parent_clause join t_article a on a.number = p.parent_article
  union all select a.uid, {_TITLE} || coalesce(chr(10) || string_agg(x.line, chr(10) order by x.c, x.p), '') from t_article a left join (
    select parent_article, number::int as c, '' as p, number || '. ' || content as line from t_clause
    union all select parent_article, parent_clause::int, letter, letter || ') ' || content from t_point) x on x.parent_article = a.number group by a.uid, a.doc_identity, a.number, a.title"""
    )
)
def e13_law_text(t):
    """Law text of every article, clause and point."""
    nodes = _law_nodes(t)
    return ctx.law_text(nodes, nodes, stored(t.document, "documents"))


@query(
    with_tables(
        """select c.uid, round(1.0 + case when coalesce(list_contains(f, 'bãi bỏ'), false) then -5.0 when coalesce(list_contains(f, 'thay thế'), false) then -3.0 else 0.0 end + greatest(0.0, 2.0 - 0.3 * greatest(0, date '2002-01-01' - d.effect_date::date) / 365.0), 6)::double as adjusted
  from t_clause c join t_document d using (doc_identity) left join (select dst_uid, list(distinct amend_type) as f from t_amends where amend_type in ('bãi bỏ', 'thay thế') group by 1) on dst_uid = c.uid"""
    )
)
def f3_adjust_by_status(t):
    rows = ctx.status_flags(t.clause, t.amends).join(ctx.effect_dates(t.clause, t.document), "uid").withColumn("score", F.lit(1.0))
    return srch.adjust_by_status(rows, "2002-01-01").select("uid", "adjusted")


@query()
def f4_retrieval_pipeline(t):
    """Every fiftieth article asks two sub-queries, its title and its chapter."""
    graph = _graph(t)
    post = graph["node"].where(F.col("label").isin("Article", "Clause", "Point"))
    asked = t.article.where("cast(number as int) % 50 = 0").select(F.col("number").cast("int").alias("query_id"), F.array("title", F.concat_ws(" ", F.lit("urgent"), "parent_chapter")).alias("texts"))
    q = stored(asked.select("query_id", F.posexplode("texts").alias("sub_query_idx", "query_text")), "questions")
    return retrieval.retrieve(q, srch.searchable_text(post), graph, retrieval.Settings(expand=True))


def _graph(t):
    """The graph tables as a load would leave them; edges are read above articles alone, and points are nodes."""
    kept = {name: stored(getattr(t, name), name) for name in ("node", "document", "amends")}
    points = kept["node"].where("label = 'Point'").select("uid", F.col("number").alias("letter"), "content")
    return kept | {"edge": t.edge, "point": points}


@query()
def f4_hybrid_pipeline(t):
    """Every fiftieth article asks for its title and chapter, over the articles' text and hashed term vectors."""
    articles = stored(srch.searchable_text(t.node.where("label = 'Article'")).select("uid", "label", "text"), "articles")
    asked = t.article.where("cast(number as int) % 50 = 0").select(F.col("number").cast("int").alias("query_id"), F.array("title", "parent_chapter", F.concat_ws(" ", "title", "parent_chapter")).alias("texts"))
    q = stored(asked.select("query_id", F.posexplode("texts").alias("sub_query_idx", "query_text")).withColumn("uid", F.concat_ws("/", "query_id", "sub_query_idx")), "questions")
    embedded = q.join(srch.embed_text(q.select("uid", F.col("query_text").alias("text")), "uid", "text", 64, articles), "uid").drop("uid")
    vectors = articles.select("uid", "label").join(srch.embed_text(articles, "uid", "text", 64), "uid")
    return retrieval.retrieve(embedded, articles, _graph(t), retrieval.Settings(mode="hybrid"), vectors)


# -- conversations -------------------------------------------------------------


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as r from conversations) where r <= 4")
def f6_recent_turns(t):
    return cp.recent_turns(t.read("conversations"), "conv_id", 2)


@query("select conv_id, turn, case when role <> 'user' and length(text) > 200 then substr(text, 1, 200) || '...' else text end as text from conversations")
def f7_history_text(t):
    return t.read("conversations").select("conv_id", "turn", cp.history_text(F.col("role"), F.col("text")).alias("text"))


@query("select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn, role, text) || '<|eot_id|>' as text from conversations group by 1")
def j5_render_chat(t):
    return cp.render_chat(t.read("conversations"), "conv_id")


@query("select conv_id from (select conv_id, arg_min(role, turn) as r, arg_min(text, turn) as x from conversations group by 1) where r = 'system' and contains(x, 'the')")
def j9_system_conversations(t):
    return cp.conversations_opening_with(t.read("conversations"), "conv_id", "the")


# -- answers and judges --------------------------------------------------------

_BLEU = f"""tok as (select conv_id, turn, {_TOK.format('reference_text')} as r, {_TOK.format('candidate_text')} as c from t_pair),
gc as (select conv_id, turn, n, array_to_string(c[i:i+n-1], ' ') as g, count(*) as k from tok, (select unnest([1,2,3,4]) as n), (select unnest(range(1, 30000)) as i) where i + n - 1 <= len(c) group by all),
gr as (select conv_id, turn, n, array_to_string(r[i:i+n-1], ' ') as g, count(*) as kr from tok, (select unnest([1,2,3,4]) as n), (select unnest(range(1, 30000)) as i) where i + n - 1 <= len(r) group by all),
hit as (select conv_id, turn, n, sum(least(k, coalesce(kr, 0))) as hit, sum(k) as total from gc left join gr using (conv_id, turn, n, g) group by all),
sc as (select conv_id, turn, sum(ln((case when hit > 0 then hit else 0.1 end)::double / total)) as s, count(*) as orders from hit group by all)"""


@query(with_tables("select conv_id, turn, round(case when len(c) = 0 or len(r) = 0 then 0.0 else exp((s + (4 - orders) * ln(0.1::double)) / 4 + case when len(c) > len(r) then 0.0 else 1.0 - len(r)::double / len(c) end) end, 6) as bleu from tok left join sc using (conv_id, turn)", _BLEU))
def h1_bleu(t):
    return ev.bleu(t.pair, ["conv_id", "turn"])


@query()
def h2_h3_rouge_meteor(t):
    return ev.rouge_meteor(t.pair, ["conv_id", "turn"])


@query("select doc_id, array_to_string(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')[1:50], ' ') as text from documents")
def h5_truncate_tokens(t):
    return t.read("documents").select("doc_id", ev.truncate_tokens(F.col("text"), 50).alias("text"))


_JUDGE = r"judged as (select id, model, case when raw_eval like 'Score%' then regexp_extract(raw_eval, '(\d{1,2})', 1)::double else (id % 5) / 2.0 + 4.5 end as score from t_judge)"


@query(with_tables("select id, model, score from judged", _JUDGE))
def h7_parse_judge(t):
    return ev.parse_judge(t.judge).select("id", "model", "score")


@query(
    """select event_id as id, event_type as model, case k when 0 then a + c + s when 1 then n % 11 when 2 then n % 7 else 0 end::double as score, a as legal_accuracy, 0::double as correct_citation, c as completeness, 0::double as hallucination_citation, s as structure,
  case k when 0 then 'vì ' || event_type when 1 then 'lý do ' || event_type when 2 then event_type else '' end as reasoning, case k when 0 then 'so ' || n when 1 then 'so với ' || n when 2 then '' else event_type end as comparison
from (select *, event_id as n, event_id % 4 as k, case when event_id % 4 = 0 then event_id % 3 else 0 end::double as a, case when event_id % 4 = 0 then event_id % 2 + 0.5 else 0 end::double as c, case when event_id % 4 = 0 then event_id % 5 else 0 end::double as s from events)"""
)
def h7_judge_fields(t):
    """Every field of a reply, in all its forms."""
    return ev.parse_judge(t.judge_reply).drop("raw_eval")


@query(with_tables("select model, round(avg(score), 4) as avg_score, round(avg((score >= 7)::int), 4) as pass_rate, count(*) as n from judged group by 1", _JUDGE))
def h11_judge_by_model(t):
    return ev.judge_summary(ev.parse_judge(t.judge), ["model"])


@query(with_tables("select round(avg(score), 4) as avg_score, round(avg((score >= 7)::int), 4) as pass_rate, count(*) as n from judged", _JUDGE))
def h9_judge_overall(t):
    return ev.judge_summary(ev.parse_judge(t.judge), [])


# -- votes ---------------------------------------------------------------------


@query(with_tables("select id, sum(vote::int) >= count(*) // 2 as verdict, count(*) as n_votes, sum(vote::int)::bigint as n_yes, min(vote::int) = max(vote::int) as all_agreed from t_votes group by 1"))
def i2_majority(t):
    return ev.majority(t.votes, ["id"])


_ALL = "every as (select id, model, vote, is_correct from t_votes union all select id, 'MAJORITY', sum(vote::int) >= count(*) // 2, any_value(is_correct) from t_votes group by 1)"


@query(with_tables("select * from every", _ALL))
def i4_vote_table(t):
    return ev.vote_table(t.votes)


def _timed(votes):
    return votes.withColumn("latency_ms", F.col("id") % 1000 + F.length("model"))


@query(with_tables("select model, tp, fp, fn, tn, n_questions, total_uids, avg_latency_ms, round((tp + tn) / (tp + fp + fn + tn), 4) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall from (select model, count(*) filter (vote and is_correct) as tp, count(*) filter (vote and not is_correct) as fp, count(*) filter (not vote and is_correct) as fn, count(*) filter (not vote and not is_correct) as tn, count(distinct id) as n_questions, count(*) as total_uids, round(avg(id % 1000 + length(model)), 1) as avg_latency_ms from every group by 1)", _ALL))
def i6_confusion_by_model(t):
    return ev.confusion(_timed(ev.vote_table(t.votes)), ["model"], "latency_ms")


@query(with_tables("select id, model, case when vote and is_correct then 'TP' when vote then 'FP' when is_correct then 'FN' else 'TN' end as outcome from t_votes"))
def i7_outcomes(t):
    return t.votes.select("id", "model", ev.outcome(F.col("vote"), F.col("is_correct")).alias("outcome"))


# -- datasets ------------------------------------------------------------------


@query("select doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '*') and not contains(lower(x), 'tiền đề'))[-1], substr(text, 1, 300)) as answer from documents")
def j4_final_answer(t):
    return t.read("documents").select("doc_id", cp.final_answer(F.col("text")).alias("answer"))


@query("select doc_id, substr(replace(text, ' ', '_'), 1, 60) as key, floor(length(text) / 4)::bigint as n_tokens from documents")
def j13_document_keys(t):
    return t.read("documents").select("doc_id", cp.document_key(F.col("text")).alias("key"), cp.estimate_tokens(F.col("text")).alias("n_tokens"))


@query("select event_id, n_requests, n_requests > 2 as over_limit from (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as n_requests from events)")
def j15_trailing_load(t):
    rows = t.read("events").withColumn("tok", F.lit(1))
    return cp.trailing_load(rows, "user_id", "ts", "tok", 2, 1_000_000).select("event_id", "n_requests", "over_limit")


@query("select case when b < 8 then 'train' when b = 8 then 'valid' else 'test' end as split, count(*) as n from (select ('0x' || md5('42:' || doc_id)[1:8])::bigint % 10 as b from documents) group by 1")
def j10_split(t):
    return cp.split_by_hash(t.read("documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


# -- corpus statistics ---------------------------------------------------------


@query(with_tables("select label, count(*) as n from t_node group by 1"))
def k1_level_counts(t):
    return cp.level_counts(t.node)


@query(with_tables(" union all ".join(f"select label, '{c}' as \"column\", count(*) filter ({c} is null) as n_null from t_node group by 1" for c in ("number", "title", "content"))))
def k2_null_counts(t):
    return cp.null_counts(t.node, ["number", "title", "content"])


@query(with_tables("select type, children, count(*) as parents from (select type, src, count(*) as children from t_edge group by 1, 2) group by 1, 2"))
def k3_children_per_parent(t):
    return cp.children_per_parent(t.edge)


_TOKS = f"toks as (select doc_id as id, unnest({_TOK.format('text')}) as term from documents), long as (select * from toks where length(term) > 1)"


@query(f"with {_TOKS} select sum(c)::bigint as n_tokens, count(*) as n_distinct, round(count(*) / sum(c), 6) as ratio from (select term, count(*) as c from long group by 1)")
def k6_vocabulary_ratio(t):
    return cp.vocabulary_ratio(cp.clean_tokens(t.read("documents"), "doc_id", "text"))


@query("with x as (select lang, length(text) as n from documents), s as (select min(n) as lo, max(n) as hi from x) select lang, least(floor((n - lo) * 50 / greatest(hi - lo, 1)), 49)::bigint as bin, count(*) as n from x, s group by 1, 2")
def k7_length_histogram(t):
    return cp.histogram(t.read("documents").select("lang", F.length("text").alias("len")), "len", 50, ["lang"])


@query(f"with {_TOKS} select term, count(*) as n from long group by 1 order by n desc, term limit 10")
def k8_top_terms(t):
    return cp.top_terms(cp.clean_tokens(t.read("documents"), "doc_id", "text"))


_LIST = _TOK.format("text").replace("x <> ''", "length(x) > 1")


@query(f"with t as (select {_LIST} as t from documents), b as (select t[i] as a, t[i+1] as b from (select t, unnest(range(1, len(t))) as i from t)) select a || ' ' || b as gram, count(*) as n from b where a <> b group by 1 order by n desc, gram limit 10")
def k9_top_bigrams(t):
    return cp.top_ngrams(t.read("documents"), "text", 2)


# -- parsing -------------------------------------------------------------------


@query("select doc, line, text from (select doc_id as doc, i - 1 as line, trim(l[i]) as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))) where text <> ''")
def b4_lines(t):
    return ps.lines(t.read("documents"), "doc_id", "text")


@query()
def b1_html_to_text(t):
    return t.read("pages").select("page_id", ps.html_to_text(F.col("html")).alias("text"))


def rendered_documents(t) -> DataFrame:
    """Each article with its clauses and points as a document of its own, for parsing back; letter f is no point letter and is left out."""
    name = F.concat_ws("/", "doc_identity", "parent_article").alias("doc")
    none = F.lit("")
    a = t.article.withColumn("parent_article", F.col("number")).select(name, none.alias("cn"), none.alias("letter"), F.concat(F.lit("Điều "), "number", F.lit(". "), "title").alias("line"))
    c = t.clause.select(name, F.col("number").alias("cn"), none.alias("letter"), F.concat("number", F.lit(". "), "content").alias("line"))
    p = t.point.where("letter <> 'f'").select(name, F.col("parent_clause").alias("cn"), "letter", F.concat("letter", F.lit(") "), "content").alias("line"))
    return a.unionByName(c).unionByName(p).groupBy("doc").agg(ctx.ordered_text(F.struct("cn", "letter"), F.col("line")).alias("text"))


@query(with_tables("select doc_identity || '/' || number as doc, 'Article' as kind, number, null as content, null as in_article, null as in_clause from t_article union all select doc_identity || '/' || parent_article, 'Clause', number, content, parent_article, null from t_clause union all select doc_identity || '/' || parent_article, 'Point', letter, content, parent_article, parent_clause from t_point where letter <> 'f'"))
def b6_parse_back(t):
    nodes = ps.parsed_nodes(ps.lines(rendered_documents(t), "doc", "text"))
    up = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), F.col(c))
    return nodes.select("doc", "kind", "number", up("content", "Clause", "Point").alias("content"), up("in_article", "Clause", "Point").alias("in_article"), up("in_clause", "Point").alias("in_clause"))


# -- index, stubs and dimensions -------------------------------------------------


@query(with_tables("select uid, 'article' as kind, coalesce(try_cast(number as int), 0) as number, title as name from t_article union all select uid, 'clause', coalesce(try_cast(number as int), 0), content from t_clause union all select uid, 'point', coalesce(try_cast(letter as int), 0), content from t_point"))
def d12_index_entries(t):
    return srch.index_entries(t.article, t.clause, t.point)


@query("select user_id, arg_max(event_type, event_id) filter (event_type is not null) as event_type, arg_max(value, event_id) filter (value is not null and value >= 1) as value from (select * from events) group by 1")
def c4_dimension_upsert(t):
    """The last given value of each property per user; small values count as not given."""
    rows = t.read("events").select("user_id", "event_id", "event_type", F.when(F.col("value") >= 1, F.col("value")).alias("value"))
    return g.upsert_dimension(rows, "user_id", "event_id")


@query("with f as (select doc_id, source as doc_name, nullif(lang, 'en') as doc_guid from documents), s as (select doc_id, quality::varchar as doc_name, toxic::varchar as doc_guid from labels union all select item_id + 10000000, 'item', text from benchmark) select doc_id, coalesce(f.doc_name, s.doc_name) as doc_name, coalesce(f.doc_guid, s.doc_guid) as doc_guid from f full join s using (doc_id)")
def c5_fill_stubs(t):
    full = t.read("documents").select("doc_id", F.col("source").alias("doc_name"), F.nullif("lang", F.lit("en")).alias("doc_guid"))
    stubs = t.read("labels").select("doc_id", F.col("quality").cast("string").alias("doc_name"), F.col("toxic").cast("string").alias("doc_guid"))
    items = t.read("benchmark").select((F.col("item_id") + 10_000_000).alias("doc_id"), F.lit("item").alias("doc_name"), F.col("text").alias("doc_guid"))
    return g.fill_stubs(full, stubs.unionByName(items), "doc_id", ["doc_name", "doc_guid"])


@query(with_tables("select uid, src from (select uid, doc_identity || '::article::' || parent_article || '::clause::' || parent_clause as src from t_point)"))
def c2_resolve_ids(t):
    dotted = F.concat_ws(".", "parent_article", "parent_clause")
    return t.point.select("uid", g.resolve_structural_id(F.col("doc_identity"), F.lit("Clause"), dotted).alias("src"))


@query(with_tables(" union all ".join(f"select label, '{c}' as property, count(*) as n from t_node where {c} is not null group by 1" for c in ("number", "title", "content"))))
def c10_label_properties(t):
    return g.label_properties(t.node, ["number", "title", "content"])


@query(with_tables("select (select count(*) from documents) as total, (select count(*) from documents where text is not null and text <> '') as succeeded, (select count(*) from documents where text is null or text = '') as failed, (select count(*) from t_node) as nodes, (select count(*) from t_edge) as edges"))
def c9_import_counters(t):
    loaded = t.read("documents").select(F.when(F.coalesce("text", F.lit("")) == "", F.lit("empty")).alias("error"))
    return g.import_counters(loaded, t.node, t.edge)


# -- more context and reranking ----------------------------------------------------


@query(with_tables("select uid, trim(concat_ws(chr(10), nullif(title, ''), nullif(content, ''))) as text from t_node"))
def e2_flat_text(t):
    return t.node.select("uid", ctx.flat_text(t.node).alias("text"))


@query(
    with_tables(
        """select uid, string_agg('      - Amended by: ' || 'Khoản ' || split_part(src_uid, '::', 5) || ' Điều ' || split_part(src_uid, '::', 3) || ' ' || split_part(src_uid, '::', 1) || case when length(effect_date) >= 10 then ' (Effective: ' || substr(effect_date, 1, 10) || ')' else '' end || ' (applied to ' || 'Khoản ' || split_part(dst_uid, '::', 5) || ' Điều ' || split_part(dst_uid, '::', 3) || ' ' || split_part(dst_uid, '::', 1) || ')' || chr(10) || '        Content: ' || coalesce(content, ''), chr(10) order by src_uid, dst_uid) as amendments
  from (select distinct r.uid, a.src_uid, a.dst_uid, n.content, d.effect_date
    from (select dst as uid, anc as dst_uid from close union all select anc, dst from close union all select uid, uid from t_node) r
    join t_clause w on w.uid = r.uid join (select distinct src_uid, dst_uid, amend_type from t_amends) a on a.dst_uid = r.dst_uid join t_node n on n.uid = a.src_uid join t_document d on d.doc_identity = n.doc_identity) group by 1""",
        _CLOSE,
    )
)
def e5_amendment_lines(t):
    found = ctx.amendments_of(t.clause, t.amends, t.edge, t.node, t.document)
    return ctx.amendment_lines(found.drop("amend_type").distinct())


_WANTED = """wa as (select number::int // 10 as q, number as an from t_article where number::int % 10 = 0),
wc as (select parent_article::int // 10 as q, parent_article as an, number as cn from t_clause where number::int % 3 = 0),
wp as (select parent_article::int // 10 as q, uid, parent_article as an, parent_clause as cn from t_point where letter = 'b' and parent_clause::int % 3 = 1),
shown as (
  select q, c.parent_article as an, c.number::int as c, '' as p, c.number || '. ' || c.content as line from t_clause c join wa on an = parent_article
  union select q, parent_article, parent_clause::int, letter, letter || ') ' || content from t_point join wa on an = parent_article
  union select q, an, number::int, '', number || '. ' || content from t_clause join wc on cn = number
  union select q, an, parent_clause::int, letter, letter || ') ' || content from t_point join wc on cn = parent_clause
  union select q, an, number::int, '', number || '. ' || content from t_clause join wp on cn = number
  union select q, an, parent_clause::int, letter, letter || ') ' || content from t_point join wp using (uid)),
bodies as (select q, an, string_agg(line, chr(10) order by c, p) as body from shown group by 1, 2),
arts as (select q, a.doc_identity, a.number::int as n, 'Điều ' || a.number || '. ' || a.title || coalesce(chr(10) || body, '') as t from (select q, an from bodies union select q, an from wa) x join t_article a on a.number = an left join bodies using (q, an)),
docs as (select q, doc_identity, 'Document ' || doc_identity || chr(10) || string_agg(t, chr(10) || chr(10) order by n) as t from arts group by 1, 2)"""


@query(with_tables("select q as query_id, string_agg(t, chr(10) || chr(10) order by doc_identity) as law_text from docs group by 1", _WANTED))
def e14_merged_law_text(t):
    """Ten customers make a query: every tenth article whole, every third clause, some single points."""
    nodes = _law_nodes(t)
    n = nodes.select("uid", "label", F.split("uid", "::").alias("s")).select("uid", "label", F.expr("cast(s[2] as int)").alias("article"), F.expr("cast(get(s, 4) as int)").alias("clause"), F.expr("get(s, 6)").alias("letter"))
    wanted = n.where("(label = 'Article' and article % 10 = 0) or (label = 'Clause' and clause % 3 = 0) or (label = 'Point' and letter = 'b' and clause % 3 = 1)").select(F.expr("article div 10").alias("query_id"), "uid")
    return ctx.merged_law_text(wanted, nodes, stored(t.document, "documents"))


@query(
    with_tables(
        """select number::int // 10 as query_id, 'Danh sách văn bản hiệu lực:' || chr(10) || string_agg(distinct '- ' || doc_identity || ' (Ngày hiệu lực: ' || effect_date || ')', chr(10) order by '- ' || doc_identity || ' (Ngày hiệu lực: ' || effect_date || ')') as dates from t_article join t_document using (doc_identity) group by 1"""
    )
)
def e15_date_list(t):
    return ctx.effect_date_list(t.article.select(F.expr("cast(number as int) div 10").alias("query_id"), "uid"), t.document)


@query(
    with_tables(
        f"""select parent_article as query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by number::int) as text from (
  select c.parent_article, c.number, case when list_contains(f, 'bãi bỏ') then '[ĐÃ BỊ BÃI BỎ bởi văn bản mới hơn]' || chr(10) when list_contains(f, 'thay thế') then '[ĐÃ BỊ THAY THẾ bởi văn bản mới hơn]' || chr(10) else '' end
    || '[Văn bản: ' || c.doc_identity || ' — Hiệu lực: ' || coalesce(d.effect_date, 'N/A') || ']' || chr(10) || 'Chương ' || ch.number || ': ' || ch.title || chr(10) || 'Điều ' || a.number || ': ' || a.title || chr(10) || 'Khoản ' || c.number || '.' || chr(10) || 'Nội dung: ' || c.content
    || coalesce(chr(10) || chr(10) || '[Nội dung chi tiết]:' || chr(10) || kids, '') || coalesce(chr(10) || chr(10) || '[LƯU Ý - NỘI DUNG SỬA ĐỔI]:' || chr(10) || notes, '') as block
  from t_clause c join t_document d using (doc_identity) join t_article a on a.number = c.parent_article join t_chapter ch on ch.doc_identity = a.doc_identity and ch.number = a.parent_chapter
  left join (select dst_uid as uid, list(distinct amend_type) as f from t_amends where amend_type in ('bãi bỏ', 'thay thế') group by 1) fl on fl.uid = c.uid
  left join (select parent_clause as number, string_agg('  Điểm ' || letter || '. ' || content, chr(10) order by uid) as kids from t_point group by 1) k on k.number = c.number
  left join (select dst_uid as uid, string_agg('Đã được sửa đổi/bổ sung bởi ' || 'Khoản ' || split_part(src_uid, '::', 5) || ' Điều ' || split_part(src_uid, '::', 3) || ' ' || split_part(src_uid, '::', 1) || ': ' || coalesce(n.content, ''), chr(10) order by src_uid) as notes from (select distinct src_uid, dst_uid from t_amends) join t_node n on n.uid = src_uid group by 1) nt on nt.uid = c.uid) group by 1"""
    )
)
def e10_final_context(t):
    """The clauses of each article as ranked results, with flags, children and amendment notes."""
    rows = t.clause.select("uid", F.col("parent_article").alias("query_id"), F.col("number").cast("int").alias("rank"))
    graph = _graph(t)
    return ctx.final_context(rows, graph["node"], graph["edge"], graph["document"], graph["amends"])


@query(ORACLE_SQL["e10_final_context"])
def e12_context_for_uids(t):
    """The same context, for uids that are given."""
    wanted = t.clause.select("uid", F.col("parent_article").alias("query_id"), F.col("number").cast("int").alias("rank"))
    return retrieval.context_for_uids(wanted, _graph(t), True)


@query(with_tables("select query_id, uid, round(score::decimal(18, 6), 4)::double as score, 'Điều ' || split_part(uid, '::', 3) || ' ' || split_part(uid, '::', 1) as display, substr(d.text, 1, 300) as snippet from merged m join documents d on d.doc_id = split_part(uid, '::', 3)::bigint", f"{_RANKED}, {_MERGED}"))
def e16_source_items(t):
    texts = t.read("documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, ctx.SNIPPET).alias("context"))  # whole texts would be moved for their beginnings
    return ctx.source_items(_merged(t).withColumn("id", F.split("uid", "::")[2].cast("long")).join(texts, "id"))


@query(
    f"""with {_BM}, c as (select kw.query_id, kw.id as uid, list_distinct({_TOK.format('b.text')}) as qt, list_distinct({_TOK.format('d.text')}) as dt from kw join benchmark b on b.item_id = kw.query_id join documents d on d.doc_id = kw.id where trim(d.text) <> ''),
s as (select query_id, uid, round(len(list_intersect(qt, dt))::double / greatest(len(qt), 1), 6) as score from c)
select * from (select *, row_number() over (partition by query_id order by score desc, uid) as rank from s) where rank <= 10"""
)
def f1_rerank(t):
    q = _benchmark_queries(t)
    found = srch.keyword_search(q, t.read("documents"), "doc_id", "text", "query_text", 30).select("query_id", F.col("id").alias("uid"))
    texts = t.read("documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("context"))
    return srch.rerank(found.join(texts, "uid").join(q, "query_id"), 10).select("query_id", "uid", "score", "rank")


@query("select conv_id, case when count(*) > 1 then array_to_string(list(text order by turn, text)[1:count(*)-1], ' ') else any_value(text) end as query from conversations group by 1")
def f5_rerank_query(t):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.read("conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", ps.rerank_query(F.col("t")).alias("query"))


@query("select conv_id, string_agg(text, '|' order by turn, text) as queries from conversations group by 1")
def f9_sub_queries(t):
    """Replies made of the conversations' turns, parsed back to sub-queries."""
    rows = t.read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.transform("t", lambda x: F.struct(x["text"].alias("query")))), F.lit("\n```"))
    return rows.select("conv_id", F.array_join(ps.parse_sub_queries(reply), "|").alias("queries"))


# -- parts of runs -------------------------------------------------------------------


@query(r"select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[,;]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:5], '|') as items from documents")
def g1_parse_lists(t):
    return t.read("documents").select("doc_id", F.array_join(tx.parse_list(F.col("text"), 5), "|").alias("items"))


@query(with_tables("select config, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ev.METRICS) + ", sum(n)::bigint as num_evaluated from (select part, 'run' as config, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in ev.METRICS) + ", count(*) as n from (select *, query_id // 50 % 2 as part from rows) group by 1) group by 1", f"{_RANKED}, {_MERGED}, {_METRIC}, {_ROWS}"))
def g9_combine_parts(t):
    part = F.expr("query_id div 50 % 2")
    rows = ev.retrieval_metrics(_merged(t), _references(t)).withColumn("part", part)
    parts = [ev.run_summary(rows.where(F.col("part") == p)).withColumn("config", F.lit("run")) for p in (0, 1)]
    return ev.combine_parts(parts[0].unionByName(parts[1]))


@query("select avg(quality) as quality, avg(toxic) as toxic, 'labels' as config from labels")
def g10_mean_of_numeric(t):
    return ev.mean_of_numeric(t.read("labels").withColumnRenamed("doc_id", "id"), "labels")


_PARTS = "parts as (select 1 as part, item_id as pos, text from benchmark union all select 2, doc_id, text from documents)"


@query(f"with {_PARTS} select part, pos, row_number() over (order by part, pos) as id from parts")
def g11_renumber(t):
    parts = t.read("benchmark").select(F.lit(1).alias("part"), F.col("item_id").alias("pos")).unionByName(t.read("documents").select(F.lit(2).alias("part"), F.col("doc_id").alias("pos")))
    return ev.renumber(parts)


@query(f"with {_PARTS} select part, pos, try_cast(pos as int) + case part when 2 then 100 else 0 end as id from parts")
def g12_offset_ids(t):
    parts = t.read("benchmark").select(F.lit(1).alias("part"), F.col("item_id").alias("pos")).unionByName(t.read("documents").select(F.lit(2).alias("part"), F.col("doc_id").alias("pos")))
    return ev.offset_ids(parts.withColumn("id", F.col("pos").cast("string")), {2: 100})


@query(with_tables("select query_id, recall_5 from rows where recall_5 = 1", f"{_RANKED}, {_MERGED}, {_METRIC}, {_ROWS}"))
def g13_recall_gate(t):
    return ev.recall_gate(ev.retrieval_metrics(_merged(t), _references(t)), 6).select("query_id", "recall_5")


@query(with_tables("select query_id from hits where best <= 3", f"{_RANKED}, {_MERGED}, {_METRIC}"))
def g13_reference_gate(t):
    """Without recall columns: questions all of whose references are among the first three."""
    return ev.recall_gate(_references(t).select("query_id"), 3, _merged(t), _references(t))


@query("select doc_id, text as question, len(string_split(source, ',')) as n_references from documents where trim(coalesce(text, '')) <> '' and source <> ''")
def g4_usable_questions(t):
    rows = t.read("documents").select("doc_id", F.col("text").alias("question"), tx.parse_list(F.col("source")).alias("references"))
    return ev.usable_questions(rows).select("doc_id", "question", F.size("references").alias("n_references"))


# -- more answer metrics -----------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip(x, y), lambda z: z[1]::double * z[2]::double))"


@query(
    f"""with v as (select vec_id // 4 as id, list(embedding order by vec_id) filter (vec_id % 4 < 2) as c, list(embedding order by vec_id) filter (vec_id % 4 >= 2) as r from embeddings group by 1),
m as (select id, list_avg(list_transform(c, lambda x: list_max(list_transform(r, lambda y: {_DOT})))) as p, list_avg(list_transform(r, lambda x: list_max(list_transform(c, lambda y: {_DOT})))) as q from v where c is not null and r is not null)
select id, round(case when p + q > 0 then 2 * p * q / (p + q) else 0.0 end, 6) as f1 from m"""
)
def h4_embedding_f1(t):
    """Four vectors in a row make a pair: two candidate tokens and two reference tokens."""
    e = t.read("embeddings").withColumn("id", F.expr("vec_id div 4")).withColumn("k", F.expr("vec_id % 4"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("vec_id", "embedding")))), lambda x: x["embedding"])
    pairs = e.groupBy("id").agg(side(F.col("k") < 2).alias("cand"), side(F.col("k") >= 2).alias("ref"))
    return ev.embedding_f1(pairs.where((F.size("cand") > 0) & (F.size("ref") > 0)), ["id"])


@query(with_tables(r"select id, trim(regexp_replace(regexp_replace(raw_eval, '^```(?:json)?\s*', ''), '\s*```$', '')) as body from t_judge"))
def h6_strip_fences(t):
    return t.judge.select("id", tx.strip_fences(F.col("raw_eval")).alias("body"))


@query("select lang, coalesce(avg(try_cast(text as double)), 0.0) as text, round(avg(try_cast(n_chars as double)), 4) as n_chars from documents group by 1")
def h10_coerced_means(t):
    rows = t.read("documents").select("lang", "text", F.col("n_chars").cast("string").alias("n_chars"))
    return ev.coerced_means(rows, ["lang"], ["text", "n_chars"])


@query("select doc_id, lang, quality from documents join labels using (doc_id)")
def h12_join_results(t):
    return t.read("documents").select("doc_id", "lang").join(t.read("labels").select("doc_id", "quality"), "doc_id")


@query("select o_orderkey as k, o_orderkey::varchar as id from orders")
def h13_clean_id(t):
    return t.read("orders").select(F.col("o_orderkey").alias("k"), tx.clean_id(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))).alias("id"))


@query("select doc_id, coalesce(case when quality = 1 then 'good' end, source) as source, lang from documents left join labels using (doc_id)")
def h14_overlay(t):
    payload = t.read("labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("source"))
    return ev.overlay(t.read("documents").select("doc_id", "source", "lang"), payload, "doc_id", ["source"])


@query("select doc_id, lang, quality from documents left join labels using (doc_id)")
def h15_ground_truth(t):
    rows = t.read("documents").select("doc_id", "lang", F.lit(-1).alias("quality"))
    return ev.merge_ground_truth(rows, t.read("labels"), "doc_id", "quality")


@query("select doc_id, 'Document ' || doc_id || ' (' || coalesce(lang, '') || '): ' || coalesce(text, '') as prompt from documents")
def h16_fill_template(t):
    return t.read("documents").select("doc_id", tx.fill_template("Document {doc_id} ({lang}): {text}", ["doc_id", "lang", "text"]).alias("prompt"))


@query("select doc_id, lang from documents order by doc_id limit 100 offset 50")
def h17_row_window(t):
    return ev.row_window(t.read("documents").select("doc_id", "lang"), ["doc_id"], 50, 100)


@query("select doc_id, case when trim(coalesce(text, '')) = '' or starts_with(trim(text), 'ERROR:') then 0.0::double else n_chars::double end as score from documents")
def h18_error_guard(t):
    return t.read("documents").select("doc_id", ev.guard(F.col("text"), F.col("n_chars").cast("double")).alias("score"))


@query(r"select conv_id, turn, text, case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(có|yes|co)($|[^\p{L}\p{N}_])') then true when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(không|khong|no)($|[^\p{L}\p{N}_])') then false end as vote from conversations")
def i1_parse_vote(t):
    return t.read("conversations").select("conv_id", "turn", "text", ev.parse_vote(F.col("text")).alias("vote"))


@query(with_tables("select m.query_id, m.uid, starts_with(m.uid, q.reference) as is_correct from merged m join t_query q using (query_id)", f"{_RANKED}, {_MERGED}"))
def i3_truth_labels(t):
    refs = _references(t).groupBy("query_id").agg(F.collect_set("reference").alias("references"))
    return _merged(t).join(refs, "query_id").select("query_id", "uid", F.exists("references", lambda r: F.col("uid").startswith(r)).alias("is_correct"))


@query(with_tables("select tp, fp, fn, tn, n_questions, total_uids, avg_latency_ms, round((tp + tn) / (tp + fp + fn + tn), 4) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) as recall from (select count(*) filter (vote and is_correct) as tp, count(*) filter (vote and not is_correct) as fp, count(*) filter (not vote and is_correct) as fn, count(*) filter (not vote and not is_correct) as tn, count(distinct id) as n_questions, count(*) as total_uids, round(avg(id % 1000 + length(model)), 1) as avg_latency_ms from t_votes)"))
def i5_confusion(t):
    return ev.confusion(_timed(t.votes), [], "latency_ms")


# -- more datasets and corpus statistics -----------------------------------------------


@query(with_tables("select conv_id as context, reference_text as question, candidate_text as answer from t_pair"))
def j6_explode_qa(t):
    """Question and answer pairs packed into JSON text per conversation and taken apart again."""
    packed = t.pair.groupBy(F.col("conv_id").alias("article_content")).agg(F.to_json(F.collect_list(F.struct(F.col("reference_text").alias("question"), F.col("candidate_text").alias("answer")))).alias("generated_qa_pairs"))
    return cp.explode_qa(packed)


@query(with_tables("select uid, label, nfc_normalize(lower(x)) as text from (select uid, label, unnest([title, content]) as x from t_node) where trim(coalesce(x, '')) <> ''"))
def k4_stacked_text(t):
    return cp.stacked_text(t.node, ["title", "content"])


@query(f"with toks as (select doc_id as id, unnest({_TOK.format('text')}) as term from documents) select id, count(*) as n_terms, count(distinct term) as n_distinct from toks where length(term) > 1 and term not in ('the', 'of', 'and', 'der', 'die', 'und', 'les', 'des', 'que', 'los') group by 1")
def k5_clean_tokens(t):
    stop = t.spark.createDataFrame([(w,) for w in ("the", "of", "and", "der", "die", "und", "les", "des", "que", "los")], "term string")
    return cp.clean_tokens(t.read("documents"), "doc_id", "text", stop).groupBy("id").agg(F.count("*").alias("n_terms"), F.count_distinct("term").alias("n_distinct"))


def _ngrams(name, n):
    def run(t):
        return cp.top_ngrams(t.read("documents"), "text", n)

    run.__name__ = name
    query(f"with t as (select {_LIST} as t from documents), b as (select t[i:i+{n - 1}] as g from (select t, unnest(range(1, len(t) - {n - 2})) as i from t where len(t) >= {n})) select array_to_string(g, ' ') as gram, count(*) as n from b where len(list_distinct(g)) = {n} group by 1 order by n desc, gram limit 10")(run)


_ngrams("k9_top_trigrams", 3)
_ngrams("k9_top_fourgrams", 4)


def _ngrams_across(name, n):
    def run(t):
        return cp.top_ngrams_across(t.read("documents"), ["doc_id"], "text", n)

    run.__name__ = name
    then = ", ".join(f"lead(w, {i}) over o as w{i}" for i in range(1, n))
    gram = " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, n))])
    words = ", ".join(["w", *(f"w{i}" for i in range(1, n))])
    query(f"with t as (select doc_id, {_LIST} as t from documents), s as (select doc_id, i, t[i] as w from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from t)), b as (select w, {then} from s window o as (order by doc_id, i)) select {gram} as gram, count(*) as n from b where w{n - 1} is not null and len(list_distinct([{words}])) = {n} group by 1 order by n desc, gram limit 10")(run)


_ngrams_across("k9_bigrams_across_texts", 2)
_ngrams_across("k9_trigrams_across_texts", 3)
_ngrams_across("k9_fourgrams_across_texts", 4)

_TAGGED = f"tagged as (select term as word, case when regexp_matches(term, '^[0-9]+$') then 'M' when length(term) > 6 then 'N' else 'A' end as tag from (select unnest({_TOK.format('text')}) as term from documents)), dict as (select distinct lower(source) as word, 'Np' as tag from documents where source is not null)"


def _tagged(t):
    words = t.read("documents").select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return words.withColumn("tag", F.when(F.col("word").rlike("^[0-9]+$"), "M").when(F.length("word") > 6, "N").otherwise("A"))


@query(f"with {_TAGGED} select case when g.tag = 'A' then coalesce(d.tag, g.tag) else g.tag end as tag, count(*) as n from tagged g left join dict d using (word) group by 1")
def k10_tag_counts(t):
    override = t.read("documents").where("source is not null").select(F.lower("source").alias("word")).distinct().withColumn("tag", F.lit("Np"))
    return cp.tag_counts(_tagged(t), override)


@query(f"with {_TAGGED} select * from (select tag, word, count(*) as n, row_number() over (partition by tag order by count(*) desc, word) as rank from tagged group by 1, 2) where rank <= 10")
def k11_top_words_per_tag(t):
    return cp.top_words_per_tag(_tagged(t))


@query(r"select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '' and not regexp_matches(replace(w, '_', ''), '\p{P}')))::int as n_plain from documents")
def k12_plain_words(t):
    return t.read("documents").select("doc_id", F.size(cp.plain_words(F.col("text"))).alias("n_plain"))


# -- analytics, comparison and samples ---------------------------------------------


@query(with_tables("select doc_identity, parent_chapter as chapter, number, title from t_article where parent_chapter = 'BUILDING'"))
def c12_titles_in_chapters(t):
    return g.titles_in_chapters(t.article, t.chapter.where("number = 'BUILDING'"))


@query(with_tables("select doc_identity, count(*) as n_articles from t_article group by 1 order by n_articles desc, doc_identity limit 5"))
def c12_largest_documents(t):
    return g.largest_documents(t.article, 5)


@query("select year(o_orderdate) as year, count(*) as n from orders group by 1")
def c12_issued_per_year(t):
    return g.issued_per_year(t.read("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_date")), "issue_date")


def _dimensions(t):
    o = t.read("orders")
    part = lambda label, c: o.select(F.col("o_custkey").alias("doc_identity"), F.lit(label).alias("label"), F.col(c).alias("name"))
    return part("Signer", "o_orderstatus").unionByName(part("Field", "o_orderpriority"))


@query("select o_orderpriority as name, count(distinct o_custkey) as n from orders group by 1")
def c12_documents_by_field(t):
    return g.count_by_dimension(_dimensions(t), "Field")


@query("select distinct o_custkey as doc_identity, o_orderstatus as name from orders join customer on c_custkey = o_custkey where lower(c_name) like '%00%'")
def c12_signers_of_documents(t):
    documents = t.read("customer").select(F.col("c_custkey").alias("doc_identity"), F.col("c_name").alias("doc_name"))
    return g.dimension_of_documents(documents, _dimensions(t), "Signer", "00")


@query(with_tables("select distinct type, '' as properties from t_edge union all select distinct 'AMENDS', 'amend_type' from t_amends"))
def c10_edge_properties(t):
    edges = t.edge.withColumn("amend_type", F.lit(None).cast("string")).unionByName(t.amends.select(F.col("src_uid").alias("src"), F.col("dst_uid").alias("dst"), F.lit("AMENDS").alias("type"), "amend_type"))
    return g.edge_properties(edges, ["amend_type"]).select("type", F.array_join("properties", ",").alias("properties"))


@query(with_tables("select config, num_evaluated, " + ", ".join(ev.METRICS) + " from gsum", f"{_RANKED}, {_MERGED}, {_GRID}"))
def g8_comparison_table(t):
    return ev.comparison_table(_grid_summary(t))


@query("select source as name from documents where source is not null and lang is not null group by 1 having count(distinct lang) = 4")
def g11_files_in_every_part(t):
    return ev.in_every_part(t.read("documents").where("source is not null and lang is not null").select(F.col("lang").alias("part"), F.col("source").alias("name")), 4)


@query("select doc_id, case when doc_id % 2 = 0 then '<|turn>user' || chr(10) || coalesce(text, '') || '<turn|><|turn>model' || chr(10) else '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|><|im_start|>assistant' || chr(10) end as prompt from documents")
def h16_turn_tokens(t):
    prompt = tx.fill_template("<|im_start|>user\n{text}<|im_end|><|im_start|>assistant\n", ["text"])
    model = F.when(F.col("doc_id") % 2 == 0, "Gemma-3").otherwise("other")
    return t.read("documents").select("doc_id", tx.turn_tokens(prompt, model).alias("prompt"))


def _samples(t):
    d = t.read("documents")
    task = F.col("doc_id") % 3
    return d.select(
        "doc_id",
        F.when(task == 0, F.substring(F.coalesce("text", F.lit("")), 1, 80)).alias("legal_document"),
        F.col("source").alias("specific_question"),
        F.col("lang").alias("question"),
        F.when(task < 2, F.array(F.lit("một"), F.lit("hai"))).alias("choices"),
        F.when(task < 2, (F.expr("doc_id div 3") % 3).cast("string")).otherwise(F.concat(F.lit("<think>"), F.coalesce("text", F.lit("")), F.lit("</think><answer>x</answer>"))).alias("answer"),
        F.lit("<think>vì</think>").alias("reasoning"),
    )


@query("select doc_id, 'task' || (doc_id % 3 + 1) as task from documents")
def j1_detect_task(t):
    return cp.detect_task(_samples(t)).select("doc_id", "task")


@query(
    r"""with s as (select doc_id, doc_id % 3 as k, doc_id // 3 % 3 as a, coalesce(lang, '') as q, coalesce(source, '') as sq, substr(coalesce(text, ''), 1, 80) as d, regexp_replace(regexp_replace(coalesce(text, '') || 'x', '</?(think|answer)[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') as o from documents)
select doc_id, case k when 0 then 'Tài liệu pháp lý:' || chr(10) || d || chr(10) || chr(10) || 'Câu hỏi cụ thể: ' || sq || chr(10) || chr(10) || 'Câu hỏi: ' || q || chr(10) || 'Các lựa chọn:' || chr(10) || '  1. một' || chr(10) || '  2. hai' || chr(10) || chr(10) || 'Hãy phân tích và đưa ra câu trả lời.'
  when 1 then 'Câu hỏi: ' || q || chr(10) || chr(10) || 'Các lựa chọn:' || chr(10) || '  A. một' || chr(10) || '  B. hai' || chr(10) || chr(10) || 'Hãy phân tích từng lựa chọn và đưa ra câu trả lời đúng.'
  else 'Câu hỏi: ' || q || chr(10) || chr(10) || 'Hãy phân tích và đưa ra câu trả lời dựa trên các quy định pháp luật.' end as user,
  case k when 0 then 'vì' || chr(10) || chr(10) || '<answer>' || case a when 0 then 'một' when 1 then 'hai' else 'Không' end || '</answer>'
  when 1 then 'vì' || chr(10) || chr(10) || '<answer>' || case a when 0 then 'A. một' when 1 then 'B. hai' else 'Không xác định' end || '</answer>'
  else o || chr(10) || chr(10) || '<answer>' || coalesce(list_filter(list_transform(string_split(o, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not starts_with(x, '*') and not contains(lower(x), 'tiền đề'))[-1], substr(o, 1, 300)) || '</answer>' end as assistant from s"""
)
def j2_format_samples(t):
    return cp.format_samples(cp.detect_task(_samples(t))).select("doc_id", "user", "assistant")


@query(with_tables("select '' as law_text, reference_text as question, candidate_text as answer from t_pair"))
def j7_without_context(t):
    return cp.without_context(t.pair.select(F.col("reference_text").alias("question"), F.col("candidate_text").alias("answer")))


@query("select doc_id from documents where source in (select lower(source) from documents where doc_id % 50 = 0)")
def j8_only_named(t):
    names = t.read("documents").where("doc_id % 50 = 0").select(F.lower("source").alias("name"))
    return cp.only_named(t.read("documents").select("doc_id", F.col("source").alias("doc_name")), names).select("doc_id")


@query("select doc_id, 'task' || (doc_id % 3 + 1) as task, source as document_name from documents where doc_id % 3 < 2")
def j11_tagged_tasks(t):
    d = cp.tag_document(t.read("documents").select("doc_id", "source"), F.col("source")).drop("source")
    return cp.concat_tasks({f"task{k + 1}": d.where(F.col("doc_id") % 3 == k) for k in (0, 1)}).select("doc_id", "task", "document_name")


@query(with_tables("select type, case when hi = lo then 25 else least(floor((children - lo) * 50 / (hi - lo)), 49) end::bigint as bin, count(*) as parents from (select *, min(children) over (partition by type) as lo, max(children) over (partition by type) as hi from (select type, src, count(*) as children from t_edge group by 1, 2)) group by 1, 2"))
def k3_children_histogram(t):
    return cp.children_histogram(t.edge)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search, per-query metrics and the ablation summary."""
    return QUERIES["g6_ablation_grid"](spark, sf_dir)
