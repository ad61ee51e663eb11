"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A section is up to eight lines and ends early at an empty line; its paragraphs are its
lines; a paragraph is cut into leaves of 24 characters at most, which end where their own
content says so (a vowel and a blank, or one of every eighth block of the wide scripts), so
an insertion moves few borders. One rule serves texts of every size. Leaves cover every
character. Hashes are built upward: a paragraph's covers its leaves, a section's its
paragraphs, the root the sections. Equal texts have equal roots.

The fingerprint is the root and the tree below it: per section and paragraph 32 bits of its
hash, per leaf 24 bits. Two trees are compared from the top: equal roots end it; otherwise
leading branches that agree are passed over, section by section and then paragraph by
paragraph, and the leaves of what is left are matched as multisets. The likeness is the
share of matched leaves (Dice, repeats counted). ``first_edit`` names the first section,
paragraph and leaf that differ.

Only DataFrame functions are used. The successor of each document (ascending id) is found
inside range buckets: the first row of each bucket is also sent to the bucket before it, so
one exchange of the texts is enough. An id of many rows (or none) gets buckets of its own,
cut by a hash of the text.

Edge cases: null text reads as empty; an empty text is the root of no sections; two empty
texts are alike (1.0), an empty and another text are not (0.0); null ids sort first; rows
that share an id are ordered by a hash of their text; a table of one row has itself as
successor; ids may be of any type that sorts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import shuffle_partitions, small_table

SECTION_LINES = 8
LEAF_CHARS = 24
BUCKET_ROWS = 10_000
#: Every eighth block of 32 characters of the scripts written without blanks: one character in eight ends a leaf.
WIDE_CUTS = "".join(f"{chr(a)}-{chr(a + 31)}" for a in range(0x0E00, 0xD800, 256) if not 0x1000 <= a < 0x3000)
SECTION = rf"(?:[^\n]+\n){{0,{SECTION_LINES - 1}}}[^\n]*\n?"
LEAF = rf"(?s).{{7,{LEAF_CHARS - 2}}}?(?:\s(?<=[aeiouyаеиоуы]\s)|[\u0E00-\uD7FF&&[{WIDE_CUTS}]])|.{{1,{LEAF_CHARS}}}"


def merkle_tree(text: Column) -> Column:
    """Leaf hashes by section and paragraph: array<array<array<long>>>."""
    sections = F.filter(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), lambda s: s != "")
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))))


def paragraph_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.xxhash64(p)))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.xxhash64(s))


def _hex(value: Column, digits: int) -> Column:
    """The low bits of a hash in so many digits."""
    top = 1 << (4 * digits)
    return F.substring(F.hex(value.bitwiseAND(top - 1).bitwiseOR(top)), 2, digits)


def root_hex(sections: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(sections)), 16, "0")


def fingerprint(tree: Column, paragraphs: Column, sections: Column) -> Column:
    """Root, then per section its hash and per paragraph its hash and those of its leaves."""
    paragraph = lambda leaves, h: F.concat(F.lit("."), _hex(h, 8), F.lit(":"), F.array_join(F.transform(leaves, lambda x: _hex(x, 6)), ""))
    section = lambda s, k: F.concat(F.lit("/"), _hex(F.element_at(sections, k + 1), 8), F.array_join(F.zip_with(s, F.element_at(paragraphs, k + 1), paragraph), ""))
    return F.concat(root_hex(sections), F.array_join(F.transform(tree, section), ""))


def first_difference(a: Column, b: Column) -> Column:
    """Position (from 0) of the first differing branch of two hash arrays; null if equal."""
    n = F.greatest(F.size(a), F.size(b))
    where = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    return F.try_element_at(where, F.lit(1)) - 1


def common_prefix(a: Column, b: Column) -> Column:
    return F.coalesce(first_difference(a, b), F.size(a))


def first_edit(a: Column, b: Column) -> Column:
    """(section, paragraph, leaf) of the first difference of two trees, from 0; nulls if equal."""
    none = F.array().cast("array<array<bigint>>")
    s = first_difference(section_hashes(paragraph_hashes(a)), section_hashes(paragraph_hashes(b)))
    sa, sb = (F.coalesce(F.try_element_at(t, s + 1), none) for t in (a, b))
    p = first_difference(F.transform(sa, lambda x: F.xxhash64(x)), F.transform(sb, lambda x: F.xxhash64(x)))
    pa, pb = (F.coalesce(F.try_element_at(t, p + 1), F.array().cast("array<bigint>")) for t in (sa, sb))
    return F.struct(s.alias("section"), p.alias("paragraph"), first_difference(pa, pb).alias("leaf"))


def matched(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets of leaf hashes: equal ones pair off along the merged order."""
    tag = lambda values, side: F.transform(values, lambda x: x.bitwiseAND(0xFFFFFF) * 2 + side)
    merged = F.array_sort(F.concat(tag(a, 0), tag(b, 1)))
    state = lambda h, free, hits: F.struct(h.cast("long").alias("h"), free.cast("int").alias("free"), hits.cast("int").alias("hits"))

    def step(s: Column, v: Column) -> Column:
        h = F.shiftright(v, 1)
        free = F.when(s["h"] == h, s["free"]).otherwise(F.lit(0))
        first = v.bitwiseAND(1) == 0
        return state(h, F.when(first, free + 1).otherwise(F.greatest(free - 1, F.lit(0))), F.when(~first & (free > 0), s["hits"] + 1).otherwise(s["hits"]))

    return F.aggregate(merged, state(F.lit(-1), F.lit(0), F.lit(0)), step, lambda s: s["hits"])


def with_likeness(frame: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``frame`` with the likeness of the trees in columns a and b (each with its hashes in ``_p`` and ``_s`` beside it)."""
    rest = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    frame = frame.withColumn("__k", common_prefix(F.col(a + "_s"), F.col(b + "_s")))
    frame = frame.withColumns({"__pa": F.flatten(rest(F.col(a + "_p"), F.col("__k"))), "__pb": F.flatten(rest(F.col(b + "_p"), F.col("__k")))})
    frame = frame.withColumn("__j", common_prefix(F.col("__pa"), F.col("__pb")))
    leaves = lambda t: F.flatten(rest(F.flatten(rest(F.col(t), F.col("__k"))), F.col("__j")))
    frame = frame.withColumns({"__la": leaves(a), "__lb": leaves(b), "__na": F.size(F.flatten(F.flatten(F.col(a)))), "__nb": F.size(F.flatten(F.flatten(F.col(b))))})
    # leaves passed over with their branches are matched on both sides
    agreed = F.col("__na") - F.size("__la")
    total = F.col("__na") + F.col("__nb")
    same = F.col("__k") == F.greatest(F.size(a + "_s"), F.size(b + "_s"))
    value = F.when(same, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * (agreed + matched(F.col("__la"), F.col("__lb"))) / total)
    return frame.withColumn(out, value).drop("__k", "__pa", "__pb", "__j", "__la", "__lb", "__na", "__nb")


def with_tree(frame: DataFrame, text: str, out: str) -> DataFrame:
    """``frame`` with the tree of a text column and its paragraph and section hashes."""
    frame = frame.withColumn(out, merkle_tree(F.col(text))).withColumn(out + "_p", paragraph_hashes(F.col(out)))
    return frame.withColumn(out + "_s", section_hashes(F.col(out + "_p")))


def merkle_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root, fingerprint, tree) of each document."""
    frame = with_tree(documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")), "__text", "tree")
    return frame.select(id_col, root_hex(F.col("tree_s")).alias("root"), fingerprint(F.col("tree"), F.col("tree_p"), F.col("tree_s")).alias("fingerprint"), "tree")


def _place(borders: list, hot: dict) -> tuple[Column, int]:
    """Bucket of ``id`` and the places a bucket has: its own, after those of the hot id that it begins with."""
    places = max(hot.values(), default=0) + 1
    step = max(1, int(len(borders) ** 0.5))
    # two short scans instead of one long: first the stretch of borders, then the border in it
    stretches = [borders[i : i + step] for i in range(0, len(borders), step)]
    id_ = F.col("id")
    bucket = F.lit(0)  # null ids come before the first border
    if stretches:
        s = F.size(F.filter(F.array(*(F.lit(x[0]) for x in stretches)), lambda b: b <= id_))
        within = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in stretches)), F.greatest(s, F.lit(1)))
        bucket = F.when(id_.isNull() | (s == 0), F.lit(0)).otherwise((s - 1) * step + F.size(F.filter(within, lambda b: b <= id_)))
    inside = F.lit(places - 1)
    for value, cuts in hot.items():
        mine = id_.isNull() if value is None else id_ == F.lit(value)
        # the order of the signed hash, cut into equal ranges
        inside = F.when(mine, F.floor((F.shiftright("tie", 32) + 2**31) * cuts / 2**32).cast("int")).otherwise(inside)
    return bucket * places + inside, places


def with_successor(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, text, next_text, place, ghost, tie) by ascending id; the last row is followed by the first.

    Rows with ``ghost`` are copies of a bucket's first row at the end of the bucket before; drop
    them in the end. The driver holds one row per bucket of about ``bucket_rows`` rows.
    """
    spark = documents.sparkSession
    ids = documents.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    n_rows = ids.agg(F.sum("n")).first()[0] or 0
    n = max(2 * shuffle_partitions(spark), n_rows // bucket_rows)
    limit = max(bucket_rows // 2, n_rows // n)
    hot = {r["id"]: -(-r["n"] // limit) for r in ids.where(F.col("n") > limit).collect()}  # n at most
    ranged = ids.where(F.col("id").isNotNull()).repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("lo"))
    borders = sorted({*(r["lo"] for r in ranged.collect()), *(v for v in hot if v is not None)})
    place, _ = _place(borders, hot)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("place", place)
    firsts = rows.groupBy("place").agg(F.min(F.struct(F.col("id").isNotNull().alias("filled"), "id", "tie")).alias("f"))
    heads = sorted(((r["place"], r["f"]["id"], r["f"]["tie"]) for r in firsts.collect()), key=lambda h: h[0]) if n_rows else []
    known = small_table(spark, [(*h, heads[i - 1][0]) for i, h in enumerate(heads)], f"place int, first_id {rows.schema['id'].dataType.simpleString()}, first_tie long, before int")
    placed = rows.join(F.broadcast(known), "place")  # one row per bucket
    own, ghost = (F.struct(F.col(c).alias("place"), F.lit(g).alias("ghost")) for c, g in (("place", False), ("before", True)))
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    dealt = placed.select("id", "text", "tie", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("at")).select("id", "text", "tie", "at.*")
    # the trees are dear for their bytes: a number of tasks of our own, or small exchanges would be merged
    dealt = dealt.repartition(2 * shuffle_partitions(spark), "place")
    return dealt.withColumn("next_text", F.lead("text").over(_order())).withColumn("next_text", F.coalesce("next_text", "text"))


def _order():
    return Window.partitionBy("place").orderBy("ghost", F.col("id").asc_nulls_first(), "tie")


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = with_successor(documents).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    pairs = with_tree(pairs.drop("next_text"), "text", "own").drop("text")
    # the successor's tree comes along the same order, without another exchange
    nexts = F.lead(F.struct("own", "own_p", "own_s")).over(_order())
    pairs = pairs.withColumn("__next", nexts).where(~F.col("ghost"))
    own = F.struct("own", "own_p", "own_s")
    pairs = pairs.withColumn("__next", F.coalesce("__next", own))
    pairs = pairs.withColumns({"next": F.col("__next.own"), "next_p": F.col("__next.own_p"), "next_s": F.col("__next.own_s")}).drop("__next")
    pairs = with_likeness(pairs, "own", "next", "near_next").drop("next", "next_p", "next_s")
    pairs = with_likeness(with_tree(pairs, "edited", "new"), "own", "new", "near_edited")
    return pairs.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own"), F.col("own_p"), F.col("own_s")).alias("fingerprint"),
        fingerprint(F.col("new"), F.col("new_p"), F.col("new_s")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
