"""Retrieval metrics, answer metrics, judge parsing and votes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.functions.text import strip, strip_fences, tokens

RECALL_AT, PRECISION_AT = (1, 3, 5, 7, 10), (1, 3)
METRICS = [*(f"recall_{k}" for k in RECALL_AT), *(f"precision_{k}" for k in PRECISION_AT), "mrr"]
# Sub-scores of a judge.
JUDGE_KEYS = ("legal_accuracy", "correct_citation", "completeness", "hallucination_citation", "structure")


# -- retrieval ---------------------------------------------------------------


def first_hits(ranked: DataFrame, references: DataFrame, boundary: bool = False) -> DataFrame:
    """(query keys, reference, first rank) where a retrieved uid starts with the reference.

    ``boundary`` matches whole segments by an equi-join on exploded prefixes; the default is a plain prefix,
    evaluated inside each query's short list.
    """
    keys = [c for c in ("config", "query_id") if c in ranked.columns]
    if boundary:
        parts = F.split("uid", "::")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "::"))
        hits = ranked.withColumn("reference", F.explode(prefixes)).join(references, ["query_id", "reference"])
    else:
        hits = ranked.join(references, "query_id").where(F.col("uid").startswith(F.col("reference")))
    return hits.groupBy(*keys, "reference").agg(F.min("rank").alias("first_rank"))


def retrieval_metrics(ranked: DataFrame, references: DataFrame, boundary: bool = False) -> DataFrame:
    """Recall, precision (references found / k) and reciprocal rank of each query with references."""
    keys = [c for c in ("config", "query_id") if c in ranked.columns]
    refs = references.distinct()
    found = first_hits(ranked, refs, boundary)
    base = refs.groupBy("query_id").agg(F.count("*").alias("n_refs"))
    if "config" in keys:
        base = base.join(F.broadcast(ranked.select("config").distinct()))  # the configs of a run: a handful
    agg = found.groupBy(*keys).agg(*(F.count_if(F.col("first_rank") <= k).alias(f"f{k}") for k in RECALL_AT), F.min("first_rank").alias("best"))
    rows = base.join(agg, keys, "left")
    n = lambda k: F.coalesce(F.col(f"f{k}"), F.lit(0))
    return rows.select(*keys, *(F.round(n(k) / F.col("n_refs"), 6).alias(f"recall_{k}") for k in RECALL_AT), *(F.round(n(k) / k, 6).alias(f"precision_{k}") for k in PRECISION_AT), F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def run_summary(metrics: DataFrame) -> DataFrame:
    keys = ["config"] if "config" in metrics.columns else []
    return metrics.groupBy(*keys).agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS), F.count("*").alias("num_evaluated"))


def delta_to_baseline(summary: DataFrame, baseline: str) -> DataFrame:
    """Each config's metrics minus those of the baseline config."""
    summary = stored(summary, "summary")
    base = summary.where(F.col("config") == baseline).select(*(F.col(m).alias(f"b_{m}") for m in METRICS))
    return summary.join(F.broadcast(base)).select("config", *(F.round(F.col(m) - F.col(f"b_{m}"), 6).alias(m) for m in METRICS))  # base is one row


def usable_questions(questions: DataFrame) -> DataFrame:
    """Rows with a question and at least one reference (``references`` is an array)."""
    return questions.where((F.trim(F.coalesce("question", F.lit(""))) != "") & (F.size("references") > 0))


def combine_parts(parts: DataFrame) -> DataFrame:
    """Per config the mean of part means and the sum of ``num_evaluated``."""
    return parts.groupBy("config").agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS if m in parts.columns), F.sum("num_evaluated").alias("num_evaluated"))


def mean_of_numeric(df: DataFrame, config: str) -> DataFrame:
    numeric = [f.name for f in df.schema if f.name != "id" and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    return df.agg(*(F.avg(c).alias(c) for c in numeric)).withColumn("config", F.lit(config))


def renumber(parts: DataFrame, width: int = 10_000) -> DataFrame:
    """Ids 1 .. n in the order of (part, pos); ``pos`` is a whole number.

    Rows are numbered inside stretches of ``width`` positions; the stretches' counts give where each begins.
    """
    cut = parts.withColumn("stretch", F.floor(F.col("pos") / width))
    before = Window.orderBy("part", "stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    starts = cut.groupBy("part", "stretch").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = cut.withColumn("rn", F.row_number().over(Window.partitionBy("part", "stretch").orderBy("pos")))
    return numbered.join(starts, ["part", "stretch"]).withColumn("id", F.col("start") + F.col("rn")).drop("rn", "start", "stretch")


def in_every_part(files: DataFrame, n_parts: int) -> DataFrame:
    """Names of the files (part, name) that each of the parts has; only those are merged."""
    return files.groupBy("name").agg(F.count_distinct("part").alias("n")).where(F.col("n") == n_parts).select("name")


def comparison_table(summaries: DataFrame) -> DataFrame:
    """Summaries of runs side by side: config, number of questions, then the metrics in their order."""
    return summaries.select("config", "num_evaluated", *METRICS)


def offset_ids(parts: DataFrame, offsets: dict[int, int]) -> DataFrame:
    shift = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("part")), F.lit(0))
    return parts.withColumn("id", F.col("id").try_cast("int") + shift)


def recall_gate(rows: DataFrame, top_k: int, ranked: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Rows whose recall at the largest N <= top_k (any N if top_k is below 0) is 1.

    Without such a column, rows all of whose ``references`` (query_id, reference) are among the first top_k
    ``ranked`` (query_id, uid, rank). Rows without references stay in either case, where references are given.
    """
    known = sorted(int(c[7:]) for c in rows.columns if c.startswith("recall_") and c[7:].isdigit() and (top_k < 0 or int(c[7:]) <= top_k))
    whole = F.coalesce(F.col(f"recall_{known[-1]}") == 1.0, F.lit(False)) if known else F.lit(True)
    if references is None:
        return rows.where(whole)
    refs = references.select("query_id", "reference").distinct()
    asked = refs.groupBy("query_id").agg(F.count("*").alias("n_asked"))
    if not known and ranked is not None:
        near = ranked if top_k < 0 else ranked.where(F.col("rank") <= top_k)
        met = first_hits(near.select("query_id", "uid", "rank"), refs).groupBy("query_id").agg(F.count("*").alias("n_met"))
        asked, whole = asked.join(met, "query_id", "left"), F.coalesce(F.col("n_met") == F.col("n_asked"), F.lit(False))
    return rows.join(asked, "query_id", "left").where(F.col("n_asked").isNull() | whole).select(*rows.columns)


def row_window(df: DataFrame, order: list[str], start: int, limit: int | None = None) -> DataFrame:
    """Rows from position ``start`` on, at most ``limit`` of them."""
    rows = df.orderBy(*order).offset(start)
    return rows if limit is None else rows.limit(limit)


# -- answers -----------------------------------------------------------------


def bleu(pairs: DataFrame, keys: list[str], smooth: float = 0.1) -> DataFrame:
    """Sentence BLEU-4 with brevity penalty; a zero n-gram count becomes ``smooth``. Relational: clipped n-gram counts joined."""
    tok = pairs.select(*keys, tokens(F.col("reference_text")).alias("r"), tokens(F.col("candidate_text")).alias("c"))

    def grams(side):
        every = F.flatten(F.transform(F.array(*(F.lit(n) for n in range(1, 5))), lambda n: F.when(F.size(side) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(side) - n + 1, F.lit(1))), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(side, i, n), " ").alias("g")))).otherwise(F.array().cast("array<struct<n:int,g:string>>"))))
        return tok.select(*keys, F.explode(every).alias("x")).select(*keys, "x.n", "x.g").groupBy(*keys, "n", "g").agg(F.count("*").alias("k"))

    c, r = grams(F.col("c")), grams(F.col("r")).withColumnRenamed("k", "kr")
    hit = c.join(r, [*keys, "n", "g"], "left").groupBy(*keys, "n").agg(F.sum(F.least("k", F.coalesce("kr", F.lit(0)))).alias("hit"), F.sum("k").alias("total"))
    p = F.when(F.col("hit") > 0, F.col("hit")).otherwise(F.lit(smooth)) / F.col("total")
    score = hit.groupBy(*keys).agg(F.sum(F.log(p)).alias("s"), F.count("*").alias("orders"))
    sizes = tok.select(*keys, F.size("r").alias("lr"), F.size("c").alias("lc"))
    penalty = F.when(F.col("lc") > F.col("lr"), 0.0).otherwise(1.0 - F.col("lr") / F.col("lc"))
    # an order without n-grams counts as one smoothed miss
    log_p = (F.col("s") + (4 - F.col("orders")) * F.log(F.lit(smooth))) / 4
    return sizes.join(score, keys, "left").select(*keys, F.round(F.when((F.col("lc") == 0) | (F.col("lr") == 0), 0.0).otherwise(F.exp(log_p + penalty)), 6).alias("bleu"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by rows of numpy maxima."""
    if not a or not b:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(b))}
    other = np.array([code[w] for w in b])
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        k = code.get(w)
        if k is not None:
            step = row.copy()
            step[1:] = np.where(other == k, row[:-1] + 1, row[1:])
            row = np.maximum.accumulate(step)
    return int(row[-1])


def _align(r: list[str], c: list[str]) -> tuple[int, int]:
    """Matches and chunks of the exact stage: each candidate word takes the first free equal reference word."""
    free: dict[str, list[int]] = {}
    for i, w in enumerate(r):
        free.setdefault(w, []).append(i)
    for v in free.values():
        v.reverse()
    at = [free[w].pop() if free.get(w) else -1 for w in c]
    matches = sum(x >= 0 for x in at)
    chunks = sum(x >= 0 and (k == 0 or at[k - 1] != x - 1 or at[k - 1] < 0) for k, x in enumerate(at))
    return matches, chunks


def rouge_meteor(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """ROUGE-L F1 and the exact-match stage of METEOR, in Arrow batches."""
    rows = pairs.select(*keys, tokens(F.col("reference_text")).alias("r"), tokens(F.col("candidate_text")).alias("c"))
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", rouge_l double, meteor double"

    def run(batches):
        for pdf in batches:
            rouge, meteor = [], []
            for r, c in zip(pdf.r, pdf.c, strict=True):
                r, c = list(r), list(c)
                common = _lcs(r, c)
                rouge.append(round(2 * common / (len(r) + len(c)), 6) if common else 0.0)
                m, chunks = _align(r, c)
                if m:
                    p, q = m / len(c), m / len(r)
                    meteor.append(round(10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3), 6))
                else:
                    meteor.append(0.0)
            yield pd.concat([pdf[keys], pd.DataFrame({"rouge_l": rouge, "meteor": meteor}, index=pdf.index)], axis=1)

    return rows.mapInPandas(run, schema)


def embedding_f1(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy matching of token vectors both ways: ``ref`` and ``cand`` are arrays of unit vectors."""
    from docgraph.operators.search import dot

    best = lambda a, b: F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    p, r = mean(best(F.col("cand"), F.col("ref"))), mean(best(F.col("ref"), F.col("cand")))
    return pairs.select(*keys, p.alias("p"), r.alias("r")).select(*keys, F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), 1, limit), " ")


def guard(answer: Column, score: Column) -> Column:
    """Empty and ``ERROR:`` answers score 0."""
    return F.when(F.trim(F.coalesce(answer, F.lit(""))).rlike("^$|^ERROR:"), F.lit(0.0)).otherwise(score)


# How a judge's reply in plain text names its parts.
SCORE_TEXT = r"Score[:\s*]*\**\s*\[?(\d{1,2})\]?"
SECTION_TEXT = r"{name}[:\s*]*\**\s*(.*?)(?=- \*\*|- Score:|$)"


def parse_judge(rows: DataFrame) -> DataFrame:
    """The five sub-scores, score, reasoning and comparison of a judge's reply, beside the rows' own columns.

    A JSON object: the score is the sum of the five in ``scores``, 0 for those it lacks and where there is no
    ``scores``; where ``scores`` is no object, it is the plain ``score``. Other text: sections that start with
    their name and a number after the word score; sub-scores are 0. A null reply has no score and empty sections.
    """
    body = strip_fences(F.col("raw_eval"))
    outer = F.from_json(F.when(body.startswith("{") & body.endswith("}"), body), "scores string, score string, reasoning string, comparison string, broken string", {"columnNameOfCorruptRecord": "broken"})
    inner = "struct<" + ", ".join(f"{k}:double" for k in JUDGE_KEYS) + ">"
    raw = F.coalesce("raw_eval", F.lit(""))
    section = lambda name: F.regexp_replace(strip(F.regexp_extract(raw, "(?is)" + SECTION_TEXT.format(name=name), 1)), "^:+|:+$", "")
    mark = F.nullif(F.regexp_extract(raw, "(?i)" + SCORE_TEXT, 1), F.lit("")).cast("double")

    def fields(p: Column, scores: Column) -> Column:
        is_json = p.isNotNull() & p["broken"].isNull()
        parts = [F.coalesce(F.when(is_json, scores[k]), F.lit(0.0)) for k in JUDGE_KEYS]
        summed = p["scores"].startswith("{") | (p["scores"].isNull() & ~F.array_contains(F.json_object_keys(body), "scores"))
        score = F.when(~is_json, mark).when(summed, reduce(lambda a, b: a + b, parts)).otherwise(p["score"].try_cast("double"))
        text = lambda name: F.when(is_json, F.coalesce(p[name], F.lit(""))).otherwise(section(name.title())).alias(name)
        return F.struct(*(x.alias(k) for x, k in zip(parts, JUDGE_KEYS, strict=True)), score.alias("score"), text("reasoning"), text("comparison"))

    # each reply is parsed once: lambdas name what is parsed, and a generator keeps the projects above from repeating it
    parsed = F.transform(F.array(outer), lambda p: F.element_at(F.transform(F.array(F.from_json(p["scores"], inner)), lambda s: fields(p, s)), 1))
    return rows.select(*rows.columns, F.inline(parsed))


def judge_summary(rows: DataFrame, keys: list[str], passing: float = 7.0) -> DataFrame:
    return rows.where("score is not null").groupBy(*keys).agg(F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.avg((F.col("score") >= passing).cast("double")), 4).alias("pass_rate"), F.count("*").alias("n"))


def coerced_means(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means with text coerced to numbers: bad values are null, all-null is 0."""
    return rows.groupBy(*keys).agg(*(F.round(F.coalesce(F.avg(F.col(c).try_cast("double")), F.lit(0.0)), 4).alias(c) for c in columns))


def overlay(base: DataFrame, payload: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-empty payload values win over what is there."""
    p = payload.select(key, *(F.col(c).alias(f"p_{c}") for c in columns))
    return base.join(p, key, "left").select(key, *(F.coalesce(F.nullif(f"p_{c}", F.lit("")), c).alias(c) for c in columns), *(c for c in base.columns if c not in (key, *columns)))


def merge_ground_truth(rows: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """The truth's column replaces any own one; rows without truth keep a null."""
    return rows.drop(column).join(truth.select(key, column), key, "left")


# -- votes -------------------------------------------------------------------


def parse_vote(raw: Column) -> Column:
    """True for yes, false for no, null when unclear: JSON ``answer`` first, then keywords of the whole reply, yes before no."""
    answer = F.lower(strip(F.get_json_object(strip_fences(raw), "$.answer")))
    body = F.lower(raw)
    return F.when(answer.isin("có", "yes", "co"), True).when(answer.isin("không", "no", "khong"), False).when(body.rlike(r"(?iuU)\b(có|yes|co)\b"), True).when(body.rlike(r"(?iuU)\b(không|khong|no)\b"), False)


def majority(votes: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Verdict as ``sum >= n div 2`` (as the metric is defined), or more than half when strict."""
    n, yes = F.count("*"), F.sum(F.coalesce(F.col("vote"), F.lit(False)).cast("int"))
    verdict = yes * 2 > n if strict else yes >= F.floor(n / 2)
    return votes.groupBy(*keys).agg(verdict.alias("verdict"), F.count("*").alias("n_votes"), yes.alias("n_yes"), (F.min("vote") == F.max("vote")).alias("all_agreed"))


def vote_table(votes: DataFrame) -> DataFrame:
    """Votes with a MAJORITY row per item."""
    m = votes.groupBy("id").agg((F.sum(F.col("vote").cast("int")) >= F.floor(F.count("*") / 2)).alias("vote"), F.first("is_correct").alias("is_correct"))
    return votes.select("id", "model", "vote", "is_correct").unionByName(m.select("id", F.lit("MAJORITY").alias("model"), "vote", "is_correct"))


def outcome(vote: Column, truth: Column) -> Column:
    return F.when(vote & truth, "TP").when(vote & ~truth, "FP").when(~vote & truth, "FN").otherwise("TN")


def confusion(votes: DataFrame, keys: list[str], latency: str | None = None) -> DataFrame:
    """Counts, accuracy, precision and recall; ``latency`` names a column whose mean (nulls left out, 0 without any) is given too."""
    tagged = votes.withColumn("o", outcome(F.col("vote"), F.col("is_correct")))
    timed = [F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 1).alias("avg_latency_ms")] if latency else []
    rows = tagged.groupBy(*keys).agg(*(F.count_if(F.col("o") == t).alias(t.lower()) for t in ("TP", "FP", "FN", "TN")), F.count_distinct("id").alias("n_questions"), F.count("*").alias("total_uids"), *timed)
    safe = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return rows.select(*keys, "tp", "fp", "fn", "tn", "n_questions", "total_uids", *(["avg_latency_ms"] if latency else []), safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
