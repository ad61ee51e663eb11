"""Vector, keyword and fused search for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.functions.text import tokens
from docgraph.operators.keyword import keyword_search
from docgraph.operators.vectors import vector_search

RRF = 60


def searchable_text(nodes: DataFrame) -> DataFrame:
    """Articles search by title and content, other nodes by content."""
    return nodes.withColumn("text", F.when(F.col("label") == "Article", F.trim(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("content", F.lit(""))))).otherwise(F.col("content")))


def embed_text(df: DataFrame, id_col: str, text_col: str, dims: int = 256, corpus: DataFrame | None = None) -> DataFrame:
    """(id, embedding): hashed term weights tf * idf, unit length; null for a text without known terms.

    idf comes from ``corpus`` (the same columns) where queries are to meet its vectors. A model of one's own goes in as a pandas_udf instead.
    """
    cut = lambda d: d.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    terms, known = cut(df), cut(df if corpus is None else corpus)
    n = (df if corpus is None else corpus).select(F.count("*").alias("n"))
    idf = known.groupBy("term").agg(F.count("*").alias("df")).join(n).select("term", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))  # n is one row
    cell = terms.join(idf, "term").groupBy(id_col, F.pmod(F.xxhash64("term"), F.lit(dims)).alias("dim")).agg(F.sum(F.col("tf") * F.col("idf")).alias("w"))
    rows = cell.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).cast("float"))
    return df.select(id_col).join(rows, id_col, "left").select(id_col, F.when(F.col("m").isNotNull(), vector).alias("embedding"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(df: DataFrame, keys: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows per key with their rank; Spark prunes to k rows per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def postings(texts: DataFrame, id_col: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, term, tf, dl): one row per text and term."""
    label = F.col(label_col) if label_col else F.lit("all")
    rows = texts.select(F.col(id_col).alias("id"), label.alias("label"), tokens(F.col(text_col)).alias("t")).select("id", "label", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("id", "label", "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(post: DataFrame) -> DataFrame:
    return post.groupBy("label", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def reciprocal_rank_fusion(lists: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over ranked lists."""
    every = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(*keys, "rank"))
    fused = every.groupBy(*keys).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return top_k(fused, ["query_id"], k, [F.desc("score"), *(F.col(c) for c in keys if c != "query_id")])


def fuse(results: DataFrame, strategy: str = "rrf", k: int | None = None) -> DataFrame:
    """Fuse sub-query lists (query_id, sub_query_idx, uid, label, score) by rrf, borda (the mean of scores) or max."""
    if strategy not in ("rrf", "borda", "max"):
        raise ValueError(f"unknown strategy: {strategy}")
    ranked = results.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "sub_query_idx").orderBy(F.desc("score"), "label", "uid")))
    how = {"rrf": F.sum(1.0 / (RRF + F.col("r"))), "borda": F.avg("score"), "max": F.max("score")}[strategy]
    fused = ranked.groupBy("query_id", "uid", "label").agg(F.round(how, 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label", "uid")
    fused = fused.withColumn("rank", F.row_number().over(order))
    return fused.where(F.col("rank") <= k) if k else fused


GRAMS = (1, 2, 3, 4, 8, 16, 32)  # characters


def windows(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    n = F.length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def substring_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, t) where the text holds the needle; needles: (needle), texts: (t), each value once.

    They meet on the needle's rarest substring of the largest of the ``GRAMS`` sizes that fits into it, then the whole is compared.
    """
    n, widest = F.length("needle"), F.lit(None).cast("array<string>")
    for size in GRAMS:
        widest = F.when(n >= size, windows(F.col("needle"), size)).otherwise(widest)
    asked = stored(needles.select("needle", F.explode(F.array_distinct(widest)).alias("gram")), "needle-grams")
    every = F.array_distinct(F.concat(*(windows(F.col("t"), size) for size in GRAMS)))
    have = stored(texts.select("t", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"), "text-grams")
    df = have.groupBy("gram").agg(F.count("*").alias("df"))
    # a gram that no row has leaves its needle without a hit
    rarest = asked.join(df, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where("g.df > 0")
    return have.join(rarest.select("needle", F.col("g.gram").alias("gram")), "gram").where(F.col("t").contains(F.col("needle"))).select("needle", "t")


def substring_join(needles: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Needles (needle, ...) beside the rows whose lower-cased text holds them. Equal needles and equal texts are compared once."""
    t = F.lower(F.coalesce(text, F.lit("")))
    pairs = stored(substring_pairs(needles.select("needle").distinct(), rows.select(t.alias("t")).distinct()), "pairs")
    return rows.withColumn("t", t).join(pairs, "t").join(needles, "needle").drop("t")


def catalogue_search(queries: DataFrame, articles: DataFrame, clauses: DataFrame, points: DataFrame, documents: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, kind, uid, rank): the first ``k`` articles, clauses and points of each needle.

    Articles hit by number (``điều N`` or ``N``), title, document name or identity; clauses and points by
    content. Clauses and points of a document that hits, or one of whose titles does, come first.
    articles: (uid, number, title, doc_identity); clauses and points: (uid, number, content, doc_identity),
    points with ``clause_num`` too; documents: (doc_identity, doc_name).
    """
    given = queries.select("query_id", F.lower(F.trim("needle")).alias("needle")).where("needle <> ''")
    # what is found hangs on the needle alone: equal ones are searched once
    number = F.when(F.col("needle").startswith("điều "), F.substring("needle", 6, 1 << 20)).otherwise(F.col("needle"))
    q = stored(given.select("needle").distinct().withColumn("asked", number), "needles")
    n = q.select("needle")
    a = articles.select("uid", F.coalesce(F.col("number").try_cast("int"), F.lit(0)).cast("string").alias("number"), "title", "doc_identity")
    by_title = stored(substring_join(n, a.select("uid", "title", "doc_identity"), "title").select("needle", "uid", "doc_identity"), "title-hits")
    doc_hits = lambda c: substring_join(n, documents.select("doc_identity", F.col(c).alias("x")), "x").select("needle", "doc_identity", F.lit(True).alias(f"by_{c}"))
    docs = stored(doc_hits("doc_name").join(doc_hits("doc_identity"), ["needle", "doc_identity"], "full"), "document-hits")
    hits = q.join(a, F.col("asked") == F.col("number")).select("needle", "uid").unionByName(by_title.select("needle", "uid")).unionByName(docs.select("needle", "doc_identity").join(a, "doc_identity").select("needle", "uid")).distinct()
    found = hits.join(a, "uid").join(q, "needle").join(docs, ["needle", "doc_identity"], "left")
    first = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    ranked = top_k(found, ["needle"], k, [first(F.col("number") == F.col("asked")), first(F.col("by_doc_name")), first(F.col("by_doc_identity")), F.col("doc_identity"), F.col("uid")])
    out = ranked.select("needle", F.lit("article").alias("kind"), "uid", "rank")
    near = docs.select("needle", "doc_identity").unionByName(by_title.select("needle", "doc_identity")).distinct().withColumn("near", F.lit(True))
    for kind, rows in (("clause", clauses), ("point", points)):
        number = F.coalesce(F.col("number").try_cast("int"), F.lit(0))
        found = substring_join(q, stored(rows, f"{kind}-rows"), "content").join(near, ["needle", "doc_identity"], "left")
        order = [first(number.cast("string") == F.col("asked")), F.col("doc_identity"), number] if kind == "clause" else [F.col("doc_identity"), F.col("clause_num"), F.col("number")]
        out = out.unionByName(top_k(found, ["needle"], k, [first(F.col("near")), *order, F.col("uid")]).select("needle", F.lit(kind).alias("kind"), "uid", "rank"))
    return given.join(out, "needle").select("query_id", "kind", "uid", "rank")


def article_children(wanted: DataFrame, clauses: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_identity, parent_article, kind, uid, pos): clauses of each wanted article by number, points by clause and letter."""
    w = wanted.select("doc_identity", "parent_article").distinct()
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    keys = Window.partitionBy("doc_identity", "parent_article")
    c = clauses.join(w, ["doc_identity", "parent_article"]).withColumn("pos", F.row_number().over(keys.orderBy(number("number"), "uid")))
    p = points.join(w, ["doc_identity", "parent_article"]).withColumn("pos", F.row_number().over(keys.orderBy(number("parent_clause"), "letter", "uid")))
    cols = lambda df, kind: df.select("doc_identity", "parent_article", F.lit(kind).alias("kind"), "uid", "pos")
    return cols(c, "clause").unionByName(cols(p, "point"))


def index_entries(articles: DataFrame, clauses: DataFrame, points: DataFrame) -> DataFrame:
    """(uid, kind, number, name) of everything a catalogue lists; a number that is text counts as 0."""
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias("number")
    rows = lambda df, kind, n, name: df.select("uid", F.lit(kind).alias("kind"), number(n), F.col(name).alias("name"))
    return rows(articles, "article", "number", "title").unionByName(rows(clauses, "clause", "number", "content")).unionByName(rows(points, "point", "letter", "content"))


def rerank(candidates: DataFrame, k: int, scorer: Column | None = None) -> DataFrame:
    """Score (query_text, context) pairs and keep the best; rows without context go first. The default scorer is term overlap."""
    rows = candidates.where(F.col("context").isNotNull() & (F.trim("context") != ""))
    q, d = F.array_distinct(tokens(F.col("query_text"))), F.array_distinct(tokens(F.col("context")))
    score = scorer if scorer is not None else F.round(F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)), 6)
    return top_k(rows.withColumn("score", score), ["query_id"], k, [F.desc("score"), F.col("uid")])


def adjust_by_status(candidates: DataFrame, as_of: str) -> DataFrame:
    """-5 if abolished, else -3 if replaced; plus max(0, 2 - 0.3 * age in years) by effect date. Bad dates add nothing."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring("effect_date", 1, 10), "yyyy-MM-dd")), F.lit(0)) / 365.0
    penalty = F.when(F.array_contains("flags", "bãi bỏ"), -5.0).when(F.array_contains("flags", "thay thế"), -3.0).otherwise(0.0)
    bonus = F.coalesce(F.greatest(F.lit(0.0), 2.0 - 0.3 * age), F.lit(0.0))
    return candidates.withColumn("adjusted", F.round(F.col("score") + penalty + bonus, 6))
