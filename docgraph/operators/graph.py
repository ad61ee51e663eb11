"""Graph tables: uids, upserts, edges, closure and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.tree import levels_of

LEVELS = ("part", "chapter", "section", "article", "clause", "point")
DEFAULT_AMEND_TYPE = "sửa đổi"


def build_uid(level: str, doc: Column, number: Column, part: Column | None = None, chapter: Column | None = None, article: Column | None = None, clause: Column | None = None) -> Column:
    """Hierarchical uid. Parts and chapters prefix chapters and sections where given; articles hang on the document."""
    step = lambda name, c: F.when(c.isNotNull(), F.concat_ws("::", F.lit(name), c))
    above = {"part": [], "chapter": [("part", part)], "section": [("part", part), ("chapter", chapter)], "article": [], "clause": [("article", article)], "point": [("article", article), ("clause", clause)]}[level]
    return F.concat_ws("::", doc, *(step(n, c) for n, c in above if c is not None), step(level, number))


def resolve_structural_id(doc: Column, label: Column, dotted: Column) -> Column:
    """Dotted structural id of an edge end to its uid: ``article``, ``article.clause`` or ``article.clause.point``."""
    parts = F.split(dotted, r"\.")
    article = F.concat_ws("::", doc, F.lit("article"), F.element_at(parts, 1))
    head = F.substring_index(dotted, ".", 1)
    last = F.element_at(parts, -1)
    middle = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ".")
    return (
        F.when(label == "Document", doc)
        .when(label == "Article", article)
        .when(label == "Clause", F.concat_ws("::", doc, F.lit("article"), head, F.lit("clause"), F.substring_index(dotted, ".", -1)))
        .when(label == "Point", F.concat_ws("::", doc, F.lit("article"), head, F.lit("clause"), middle, F.lit("point"), last))
        .otherwise(F.concat_ws("::", doc, F.lower(label), dotted))
    )


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``. Aggregates map-side, so a hot key is cheap."""
    payload = F.struct(*order, *(c for c in rows.columns if c not in order and c not in keys))
    best = rows.groupBy(*keys).agg(F.max(payload).alias("__best"))
    return best.select(*keys, "__best.*").select(*rows.columns)


def upsert_nodes(existing: DataFrame, fresh: DataFrame, key: str, seq: str) -> DataFrame:
    return last_write_wins(existing.unionByName(fresh, allowMissingColumns=True), [key], [seq])


def upsert_dimension(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Given properties overwrite, others stay: per column the last value that is not null."""
    columns = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns))


def fill_stubs(full: DataFrame, stubs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Insert stubs that are absent; fill only nulls of those present."""
    s = stubs.groupBy(key).agg(*(F.max(c).alias(f"__{c}") for c in columns))
    return full.join(s, key, "full_outer").select(key, *(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in columns), *(c for c in full.columns if c not in (key, *columns)))


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist, each (src, dst, type) once; RELATED_TO is left to the stubs."""
    ids = nodes.select("uid").distinct()  # inner joins: semi-joins would be made apart for each part of a union
    kept = edges.where(F.col("type") != "RELATED_TO").select("src", "dst", "type")
    # repeated edges meet where the join by dst has brought them
    ended = kept.join(ids.withColumnRenamed("uid", "dst"), "dst").select("src", "dst", "type").distinct()
    return ended.join(ids.withColumnRenamed("uid", "src"), "src").select("src", "dst", "type")


def amendment_edges(amends: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per pair, the last type by ``seq`` wins, default type where none is given; both ends must exist."""
    typed = amends.withColumn("amend_type", F.coalesce("amend_type", F.lit(DEFAULT_AMEND_TYPE)))
    once = typed.groupBy("src_uid", "dst_uid").agg(F.max_by("amend_type", F.col("seq") if "seq" in amends.columns else F.col("amend_type")).alias("amend_type"))
    ids = nodes.select("uid")
    return once.join(ids.withColumnRenamed("uid", "src_uid"), "src_uid", "left_semi").join(ids.withColumnRenamed("uid", "dst_uid"), "dst_uid", "left_semi").select("src_uid", "dst_uid", "amend_type")


def deepest_uid(doc: Column, article: Column, clause: Column, point: Column) -> Column:
    """uid of the deepest level given: point, else clause, else article, else the document."""
    a = F.concat_ws("::", doc, F.lit("article"), article)
    c = F.concat_ws("::", a, F.lit("clause"), clause)
    return F.when(article.isNull(), doc).when(clause.isNull(), a).when(point.isNull(), c).otherwise(F.concat_ws("::", c, F.lit("point"), point))


def key_violations(nodes: DataFrame, key: str = "uid") -> DataFrame:
    """Keys that occur more than once per label."""
    return nodes.groupBy("label", key).agg(F.count("*").alias("n")).where("n > 1")


def import_counters(loaded: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """total, succeeded, failed files and node and edge counts; ``loaded`` has a null ``error`` on success."""
    files = loaded.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return files.join(nodes.agg(F.count("*").alias("nodes"))).join(edges.agg(F.count("*").alias("edges")))  # one row each


def schema_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source label, edge type, target label) with their number."""
    n = nodes.select("uid", "label")
    return edges.join(n.select(F.col("uid").alias("src"), F.col("label").alias("src_label")), "src").join(n.select(F.col("uid").alias("dst"), F.col("label").alias("dst_label")), "dst").groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))


def label_properties(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Which properties the nodes of each label have."""
    present = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return nodes.select("label", F.explode(present).alias("property")).groupBy("label", "property").agg(F.count("*").alias("n"))


def closure(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(anc, dst, depth) for 1 .. depth steps along the edges of a tree of any depth; what is no tree is an error.

    Nodes carry their nearest ancestors from level to level, so each edge is joined once.
    """
    rows = reduce(DataFrame.unionByName, levels_of(edges, depth))
    return rows.select("uid", F.posexplode("above").alias("at", "anc")).select("anc", F.col("uid").alias("dst"), (F.col("at") + 1).alias("depth"))


def descendant_counts(close: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Chapters, articles, clauses and points under each document."""
    n = nodes.select(F.col("uid").alias("dst"), "label")
    d = documents.select(F.col("doc_identity").alias("anc"))
    labels = ("Chapter", "Article", "Clause", "Point")
    counts = close.join(d, "anc", "left_semi").join(n, "dst").groupBy(F.col("anc").alias("doc_identity")).agg(*(F.count_if(F.col("label") == x).alias(f"n_{x.lower()}s") for x in labels))
    return counts


def fetch_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Title and content of the wanted (uid, label); missing ones are absent."""
    return nodes.join(wanted.select("uid", "label").distinct(), ["uid", "label"]).select("uid", "label", "title", "content")


def descendants(close: DataFrame, wanted: DataFrame) -> DataFrame:
    return close.join(wanted.select(F.col("uid").alias("anc")).distinct(), "anc").select(F.col("anc").alias("uid"), F.col("dst").alias("descendant"), "depth")


def documents_with_phrase(close: DataFrame, nodes: DataFrame, documents: DataFrame, phrase: str) -> DataFrame:
    hit = nodes.where(F.lower("content").contains(phrase.lower())).select(F.col("uid").alias("dst"))
    d = documents.select(F.col("doc_identity").alias("anc"))
    return close.join(d, "anc", "left_semi").join(hit, "dst").groupBy(F.col("anc").alias("doc_identity")).agg(F.count("*").alias("n_hits"))


def edge_properties(edges: DataFrame, columns: list[str]) -> DataFrame:
    """(type, properties): the properties that edges of each type have, in order of name; none is an empty list."""
    present = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return edges.groupBy("type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(present)))).alias("properties"))


def count_by_dimension(dimensions: DataFrame, label: str) -> DataFrame:
    """(name, n): documents per value of a dimension, such as field, issuer or signer. dimensions: (doc_identity, label, name)."""
    return dimensions.where(F.col("label") == label).groupBy("name").agg(F.count_distinct("doc_identity").alias("n"))


def dimension_of_documents(documents: DataFrame, dimensions: DataFrame, label: str, phrase: str) -> DataFrame:
    """(doc_identity, name): a dimension's values for the documents whose name holds the phrase, such as who signed them."""
    named = documents.where(F.lower("doc_name").contains(phrase.lower())).select("doc_identity")
    return dimensions.where(F.col("label") == label).join(named, "doc_identity").select("doc_identity", "name").distinct()


def titles_in_chapters(articles: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_identity, chapter, number, title): the articles of the wanted (doc_identity, number) chapters."""
    wanted = chapters.select("doc_identity", F.col("number").alias("parent_chapter")).distinct()
    return articles.join(wanted, ["doc_identity", "parent_chapter"]).select("doc_identity", F.col("parent_chapter").alias("chapter"), "number", "title")


def largest_documents(articles: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` documents with most articles."""
    return articles.groupBy("doc_identity").agg(F.count("*").alias("n_articles")).orderBy(F.desc("n_articles"), "doc_identity").limit(k)


def issued_per_year(documents: DataFrame, date: str) -> DataFrame:
    """(year, n); dates that are none count under a null year."""
    return documents.groupBy(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n")).groupBy(F.year("d").alias("year")).agg(F.sum("n").alias("n"))
