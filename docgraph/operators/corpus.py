"""Corpus statistics and dataset building."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.functions.text import has_punctuation, nfc, strip, strip_think, tokens


TEXTS = 2048  # texts whose n-grams are counted at once


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def null_counts(nodes: DataFrame, columns: list[str]) -> DataFrame:
    wide = nodes.groupBy("label").agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return wide.unpivot(["label"], columns, "column", "n_null")


def children_per_parent(edges: DataFrame) -> DataFrame:
    """How many parents have how many children, per edge type."""
    return edges.groupBy("type", "src").agg(F.count("*").alias("children")).groupBy("type", "children").agg(F.count("*").alias("parents"))


def children_histogram(edges: DataFrame, bins: int = 50) -> DataFrame:
    """(type, bin, parents): number of children per parent in equal bins between each type's least and most; the middle one where these agree."""
    counts = edges.groupBy("type", "src").agg(F.count("*").alias("children"))
    span = counts.groupBy("type").agg(F.min("children").alias("lo"), F.max("children").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(F.floor((F.col("children") - F.col("lo")) * bins / F.when(width > 0, width)), F.lit(bins - 1))).cast("long")
    return counts.join(F.broadcast(span), "type").groupBy("type", b.alias("bin")).agg(F.count("*").alias("parents"))  # span: a row per edge type


def histogram(df: DataFrame, column: str, bins: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the minimum and the maximum; the maximum falls into the last bin."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.floor((F.col(column) - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1)).cast("long")
    return df.join(F.broadcast(span)).groupBy(*(keys or []), b.alias("bin")).agg(F.count("*").alias("n"))  # span is one row


def clean_tokens(texts: DataFrame, id_col: str, text_col: str, stopwords: DataFrame | None = None) -> DataFrame:
    """(id, pos, term): tokens longer than a character, stopwords out."""
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term")).where(F.length("term") > 1)
    return rows.join(stopwords.select("term"), "term", "left_anti").select("id", "pos", "term") if stopwords is not None else rows


def vocabulary_ratio(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_distinct")).withColumn("ratio", F.round(F.col("n_distinct") / F.col("n_tokens"), 6))


def top_terms(toks: DataFrame, k: int = 10) -> DataFrame:
    return toks.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def stacked_text(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(uid, label, text): the text columns of all levels under each other, blanks out, NFC and lower case."""
    rows = nodes.select("uid", "label", F.explode(F.array(*columns)).alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select("uid", "label", F.lower(nfc(F.col("text"))).alias("text"))


def plain_words(text: Column) -> Column:
    """Words between blanks that hold no punctuation but the underscore."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (w != "") & ~has_punctuation(w))


def _count_ngrams(rows: DataFrame, n: int) -> DataFrame:
    """(gram, n) of the n-grams whose words all differ; rows: (t, own), words between blanks and how many of them may begin a gram.

    Grams are counted as numbers of their words in blocks of texts; Spark adds up the blocks' counts.
    """

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                words = pa.compute.split_pattern(batch.column(0), " ")
                size, flat = np.array(words.value_lengths()), words.flatten()
                coded = flat.dictionary_encode()
                code, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
                begin = np.repeat(np.cumsum(size) - size, size)
                place = np.arange(len(code))
                at = place[(place - begin < np.repeat(np.array(batch.column(1)), size)) & (place + n <= begin + np.repeat(size, size))]
                parts = [code[at + i] for i in range(n)]
                differ = np.ones(len(at), bool)
                for i in range(n):
                    for j in range(i):
                        differ &= parts[i] != parts[j]
                at, key, bound = at[differ], np.zeros(int(differ.sum()), np.int64), 1
                for part in parts:
                    if bound * many >= 1 << 62:
                        known, key = np.unique(key, return_inverse=True)
                        bound = len(known)
                    key, bound = key * many + part[differ], bound * many
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                grams = pa.compute.binary_join_element_wise(*(flat.take(pa.array(at[first] + i)) for i in range(n)), " ")
                yield pa.RecordBatch.from_arrays([grams, pa.array(count.astype(np.int64))], names=["gram", "n"])

    return rows.select("t", "own").mapInArrow(run, "gram string, n long").where("gram <> ''").groupBy("gram").agg(F.sum("n").alias("n"))


def top_ngrams(texts: DataFrame, text_col: str, n: int, k: int = 10) -> DataFrame:
    """Most frequent n-grams inside a text whose words all differ."""
    words = F.array_join(F.filter(tokens(F.col(text_col)), lambda x: F.length(x) > 1), " ")
    return _count_ngrams(texts.select(words.alias("t"), F.lit((1 << 31) - 1).alias("own")), n).orderBy(F.desc("n"), "gram").limit(k)


def followed_texts(texts: DataFrame, order: list[str], text_col: str, n: int) -> DataFrame:
    """(part, t, tail): the tokens of each text and the ``n`` - 1 that follow in the texts after it, by ``order``.

    Texts are range partitioned. A partition passes over its texts once and gives each the tokens that follow
    in the same partition; what the last ones lack comes from the first ``n`` - 1 tokens of the partitions after
    it, a table of one row a partition. Texts without tokens are passed over. Tokens have two characters at least.
    """
    spark = texts.sparkSession
    words = F.array_join(F.filter(tokens(F.col(text_col)), lambda x: F.length(x) > 1), " ")
    keyed = texts.select(F.struct(*order).alias("at"), F.xxhash64(text_col).alias("same"), words.alias("t")).where("t <> ''")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "at", "same").sortWithinPartitions("at", "same", "t").select("t")

    def run(batches):
        part, waiting, first = TaskContext.get().partitionId(), [], True

        def rows(done):
            nonlocal first
            lead = [first and i == 0 for i in range(len(done))]
            first = first and not done
            return pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int32()), pa.array(lead, pa.bool_()), pa.array([t for t, _ in done], pa.string()), pa.array([tail for _, tail in done], pa.list_(pa.string()))], names=["part", "leads", "t", "tail"])

        for batch in batches:
            done = []
            for t in batch.column(0).to_pylist():
                ahead = t.split(" ", n - 1)[: n - 1]
                for _, tail in waiting:
                    tail += ahead[: n - 1 - len(tail)]
                while waiting and len(waiting[0][1]) == n - 1:  # the first to wait is the first to be full
                    done.append(waiting.pop(0))
                waiting.append((t, []))
            yield rows(done)
        yield rows(waiting)

    found = stored(ranged.mapInArrow(run, "part int, leads boolean, t string, tail array<string>"), "followed")
    heads = found.where("leads").select("part", F.slice(F.concat(F.split("t", " ", n), "tail"), 1, n - 1).alias("head"))
    by_part = Window.orderBy("part")  # one row a partition
    halo = heads.select("part", F.slice(F.flatten(F.array_compact(F.array(*(F.lead("head", i).over(by_part) for i in range(1, n))))), 1, n - 1).alias("halo"))
    full = found.where(F.size("tail") == n - 1).select("part", "t", "tail")
    short = found.where(F.size("tail") < n - 1).join(halo, "part").select("part", "t", F.slice(F.concat("tail", "halo"), 1, n - 1).alias("tail"))
    return full.unionByName(short)


def top_ngrams_across(texts: DataFrame, order: list[str], text_col: str, n: int, k: int = 10) -> DataFrame:
    """Most frequent n-grams whose words all differ, in the texts one after the other: grams run across their borders."""
    rows = followed_texts(texts, order, text_col, n)
    return _count_ngrams(rows.select(F.concat_ws(" ", "t", "tail").alias("t"), F.size(F.split("t", " ")).alias("own")), n).orderBy(F.desc("n"), "gram").limit(k)


def tag_counts(tagged: DataFrame, override: DataFrame) -> DataFrame:
    """Counts per tag; words of tag A take the override's tag where it has one."""
    o = override.select("word", F.col("tag").alias("o_tag"))
    return tagged.join(o, "word", "left").select(F.when(F.col("tag") == "A", F.coalesce("o_tag", "tag")).otherwise(F.col("tag")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_words_per_tag(tagged: DataFrame, k: int = 10) -> DataFrame:
    counts = tagged.groupBy("tag", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


# -- datasets ----------------------------------------------------------------


def detect_task(sample: DataFrame) -> DataFrame:
    return sample.withColumn("task", F.when(F.col("legal_document").isNotNull(), "task1").when(F.col("choices").isNotNull() & F.col("answer").isNotNull(), "task2").otherwise("task3"))


def final_answer(text: Column) -> Column:
    """Last line that is not blank, does not start with ``*`` and does not mention a premise; else the first 300 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.startswith("*") & ~F.lower(x).contains("tiền đề"))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.substring(text, 1, 300))


def render_chat(turns: DataFrame, key: str) -> DataFrame:
    """Turn-marked text of each conversation, in turn order."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("t"))
    return rows.select(key, F.concat(F.array_join(F.transform("t", lambda x: x["line"]), ""), F.lit("<|eot_id|>")).alias("text"))


def recent_turns(turns: DataFrame, key: str, max_history: int) -> DataFrame:
    return turns.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))).where(F.col("r") <= 2 * max_history).drop("r")


def history_text(role: Column, text: Column, limit: int = 200) -> Column:
    return F.when((role != "user") & (F.length(text) > limit), F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def conversations_opening_with(turns: DataFrame, key: str, phrase: str) -> DataFrame:
    """Conversations whose first turn is a system turn that contains the phrase."""
    first = turns.groupBy(key).agg(F.min_by(F.struct("role", "text"), "turn").alias("f"))
    return first.where((F.col("f.role") == "system") & F.col("f.text").contains(phrase)).select(key)


def split_by_hash(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """8:1:1 by the md5 of seed and id: the same rows fall to the same split in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    b = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10
    return df.withColumn("split", F.when(b < 8, "train").when(b == 8, "valid").otherwise("test"))


def document_key(name: Column) -> Column:
    return F.substring(F.replace(name, F.lit(" "), F.lit("_")), 1, 60)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def trailing_load(requests: DataFrame, user: str, ts: str, tokens_col: str, max_requests: int, max_tokens: int, seconds: int = 60) -> DataFrame:
    """Requests and tokens of each user in the trailing window, and whether a limit is passed."""
    w = Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("n_requests", F.count("*").over(w)).withColumn("n_tokens", F.sum(tokens_col).over(w)).withColumn("over_limit", (F.col("n_requests") > max_requests) | (F.col("n_tokens") > max_tokens))


def explode_qa(rows: DataFrame) -> DataFrame:
    """(context, question, answer) from an array of pairs or its JSON text."""
    kind = "array<struct<question:string,answer:string>>"
    pairs = F.from_json("generated_qa_pairs", kind) if dict(rows.dtypes)["generated_qa_pairs"] == "string" else F.col("generated_qa_pairs")
    return rows.select(F.col("article_content").alias("context"), F.explode(pairs).alias("p")).select("context", "p.question", "p.answer")


def parse_generated(raw: Column, schema: str, need: tuple[str, ...] = ()) -> Column:
    """Direct JSON, fences off, citation marks off, then the widest braces: the first that fills a field, and all of ``need``."""
    from docgraph.functions.text import strip_fences

    fenced = strip_fences(raw)
    uncited = F.regexp_replace(fenced, r"\s*\[\d+(?:\s*,\s*\d+)*\]\.", ".")
    widest = F.regexp_extract(uncited, r"(?s)\{.*\}", 0)
    tries = F.array(*(F.from_json(x, schema, {"mode": "PERMISSIVE"}) for x in (raw, fenced, uncited, widest)))
    filled = lambda s: F.size(F.map_filter(F.from_json(F.to_json(s), "map<string,string>"), lambda k, v: v.isNotNull())) > 0
    whole = lambda s: reduce(lambda a, b: a & b, (s[c].isNotNull() for c in need), F.coalesce(filled(s), F.lit(False)))
    return F.try_element_at(F.filter(tries, whole), F.lit(1))


# The wording of samples.
NO_CHOICE = ("Không", "Không xác định")
ASK = ("Hãy phân tích và đưa ra câu trả lời.", "Hãy phân tích từng lựa chọn và đưa ra câu trả lời đúng.", "Hãy phân tích và đưa ra câu trả lời dựa trên các quy định pháp luật.")
PROMPT_WORDS = {"document": "Tài liệu pháp lý:", "part": "Câu hỏi cụ thể:", "question": "Câu hỏi:", "choices": "Các lựa chọn:"}


def _joined(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _labelled(word: str, text: Column, gap: str = " ") -> Column:
    return F.concat(F.lit(PROMPT_WORDS[word] + gap), F.coalesce(text, F.lit("")))


def _answered(reasoning: Column, answer: Column) -> Column:
    return F.concat(strip_think(F.coalesce(reasoning, F.lit(""))), F.lit("\n\n<answer>"), answer, F.lit("</answer>"))


def _choice_lines(choices: Column, mark: str) -> Column:
    label = (lambda i: F.chr(F.lit(65) + i)) if mark == "letter" else (lambda i: (i + 1).cast("string"))
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), label(i), F.lit(". "), c)), "\n")


def format_samples(samples: DataFrame) -> DataFrame:
    """The samples with ``user`` and ``assistant`` text by their ``task``.

    task1: does a document answer a question (numbered choices); task2: multiple choice (lettered);
    task3: open question. An answer beyond the choices takes the fixed words for none.
    """
    question, choices, answer = F.col("question"), F.coalesce("choices", F.array().cast("array<string>")), F.coalesce(F.col("answer").try_cast("int"), F.lit(0))
    chosen = F.try_element_at(choices, answer + 1)
    open_answer = strip(F.regexp_replace(strip_think(F.coalesce("answer", F.lit(""))), r"</?answer[^>]*>", ""))
    first = _joined(_labelled("document", F.col("legal_document"), "\n"), "", _labelled("part", F.col("specific_question")), "", _labelled("question", question), PROMPT_WORDS["choices"], _choice_lines(choices, "number"), "", ASK[0])
    second = _joined(_labelled("question", question), "", PROMPT_WORDS["choices"], _choice_lines(choices, "letter"), "", ASK[1])
    third = _joined(_labelled("question", question), "", ASK[2])
    by_task = lambda a, b, c: F.when(F.col("task") == "task1", a).when(F.col("task") == "task2", b).otherwise(c)
    lettered_answer = F.coalesce(F.concat(F.chr(F.lit(65) + answer), F.lit(". "), chosen), F.lit(NO_CHOICE[1]))
    replies = by_task(_answered(F.col("reasoning"), F.coalesce(chosen, F.lit(NO_CHOICE[0]))), _answered(F.col("reasoning"), lettered_answer), F.concat(open_answer, F.lit("\n\n<answer>"), final_answer(open_answer), F.lit("</answer>")))
    return samples.withColumns({"user": by_task(first, second, third), "assistant": replies})


def without_context(rows: DataFrame) -> DataFrame:
    """(law_text, question, answer) of samples that bring no context of their own."""
    return rows.select(F.lit("").alias("law_text"), "question", "answer")


def only_named(rows: DataFrame, names: DataFrame, column: str = "doc_name") -> DataFrame:
    """Rows whose ``column`` is in the one-column table ``names``; all rows where there is no such column."""
    if column not in rows.columns:
        return rows
    return rows.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def tag_document(replies: DataFrame, name: Column) -> DataFrame:
    """Generated samples with the name of the document they were made from."""
    return replies.withColumn("document_name", name)


def strip_answer_tags(text: Column) -> Column:
    return strip(F.regexp_replace(strip_think(text), r"</?answer>", ""))


def concat_tasks(frames: dict[str, DataFrame]) -> DataFrame:
    """Samples of several tasks in one table, tagged with their task."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("task", F.lit(t)) for t, df in frames.items()])
