"""Language identification with spans.

Words are runs of letters and the marks that belong to them, by Unicode category. The
scripts of a word's characters (code-point ranges) narrow the candidate languages to those
seen in that script; each word then has one score per language, the sum of the
log-likelihoods of its byte trigrams (with word borders). A Viterbi pass over the words of
a document, with a fixed penalty for switching, labels every word; runs of equal labels are
the spans. The document's language is the one with most letter bytes.

Edge cases: null text, empty text and text without any letter give ``und`` with score 0;
rows with null id or null language are predicted but never learned from; a language whose
training texts hold no letter is never predicted; columns other than id, text and language
are not read; an empty training table gives ``und`` everywhere; more than ``max_languages`` languages are an
error. Equal texts get equal results.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import crc_mod, slices, text_buffer

BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
MAX_LANGUAGES = 512
#: Bytes whose words are labelled together; the Viterbi steps run over all their documents at once.
LABEL_BYTES = 12 << 20
#: Code-point ranges of scripts, both ends included; all else is "other".
SCRIPT_RANGES = (
    ("latin", (0x41, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    ("armenian", (0x530, 0x58F), (0xFB13, 0xFB17)),
    ("hebrew", (0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("syriac", (0x700, 0x74F)),
    ("thaana", (0x780, 0x7BF)),
    ("devanagari", (0x900, 0x97F), (0xA8E0, 0xA8FF)),
    ("bengali", (0x980, 0x9FF)),
    ("gurmukhi", (0xA00, 0xA7F)),
    ("gujarati", (0xA80, 0xAFF)),
    ("oriya", (0xB00, 0xB7F)),
    ("tamil", (0xB80, 0xBFF)),
    ("telugu", (0xC00, 0xC7F)),
    ("kannada", (0xC80, 0xCFF)),
    ("malayalam", (0xD00, 0xD7F)),
    ("sinhala", (0xD80, 0xDFF)),
    ("thai", (0xE00, 0xE7F)),
    ("lao", (0xE80, 0xEFF)),
    ("tibetan", (0xF00, 0xFFF)),
    ("myanmar", (0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    ("georgian", (0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    ("ethiopic", (0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    ("cherokee", (0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    ("khmer", (0x1780, 0x17FF), (0x19E0, 0x19FF)),
    ("mongolian", (0x1800, 0x18AF)),
    ("kana", (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    ("bopomofo", (0x3100, 0x312F), (0x31A0, 0x31BF)),
    ("han", (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)),
)
SCRIPTS = (*(name for name, *_ in SCRIPT_RANGES), "other")


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it part of a word (letter or mark), and its script's number. Built once per worker."""
    category = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([c == "L" for c in category])
    script = np.full(0x110000, len(SCRIPTS) - 1, np.uint8)
    for number, (_, *spans) in enumerate(SCRIPT_RANGES):
        for first, last in spans:
            script[first : last + 1] = number
    return letter, letter | np.array([c == "M" for c in category]), script


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the Latin-1 capitals, byte by byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][second] += 32
    return out


@dataclass
class Words:
    """Byte position and length of each word, its document, and the trigram bucket of each letter byte."""

    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray  # of all letter bytes, word after word
    script: np.ndarray  # bit set of scripts by word
    lettered: np.ndarray  # by document: has it a letter


def cut_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    b = fold(data)
    is_letter, in_word, script_of = _characters()
    letter = (b >= 97) & (b <= 122)
    strict = letter.copy()  # places where a letter starts
    bits = np.where(letter, np.uint64(1), np.uint64(0))  # of latin, the first script
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        first = b[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for j in (1, 2, 3):
            more = size > j
            point[more] = (point[more] << 6) | (b[lead[more] + j] & 0x3F)
        word = in_word[point]
        for j in range(4):
            more = size > j
            letter[lead[more] + j] = word[more]
        strict[lead] = is_letter[point]
        bits[lead] = np.where(word, np.left_shift(np.uint64(1), script_of[point].astype(np.uint64)), np.uint64(0))
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]]) | edge[1:])) + 1
    clean = np.where(letter, b, 32).astype(np.uint32)
    left = np.concatenate([[32], clean[:-1]])
    left[starts] = 32
    right = np.concatenate([clean[1:], [32]])
    right[ends - 1] = 32
    code = (left << 16) | (clean << 8) | right
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)[letter]
    length = ends - starts
    first = np.cumsum(length) - length
    script = np.bitwise_or.reduceat(bits[letter], first) if len(first) else np.empty(0, np.uint64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    upto = np.concatenate([[0], np.cumsum(strict)])
    return Words(starts, length, doc, bucket, script, upto[offsets[1:]] > upto[offsets[:-1]])


@dataclass
class LanguageModel:
    languages: list[str]
    score: np.ndarray  # [bucket, language]
    scripts: np.ndarray  # bit set of scripts by language


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """One score per word and language; languages not seen in any script of the word are barred while another is."""
    first = np.cumsum(words.length) - words.length
    if not len(first):
        return np.empty((0, len(model.languages)), np.float32)
    out = np.add.reduceat(np.take(model.score, words.bucket, axis=0), first, axis=0)
    allowed = (words.script[:, None] & model.scripts[None, :]) != 0
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where(allowed, out, out - 100).astype(np.float32)


def viterbi(score: np.ndarray, doc_words: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per word: one chain per document, all chains advanced together, the longest first."""
    n_docs, (n, k) = len(doc_words), score.shape
    labels = np.zeros(n, np.int32)
    if not n:
        return labels
    first = np.cumsum(doc_words) - doc_words
    order = np.argsort(-doc_words, kind="stable")
    count = doc_words[order]
    at0 = first[order]
    active = np.searchsorted(-count, -np.arange(int(count[0])), side="left")  # chains longer than t words
    best_before = np.zeros(n, np.int32)
    switched = np.zeros((n, k), bool)
    state = np.zeros((n_docs, k), np.float32)
    a = int(active[0])
    state[:a] = score[at0[:a]]
    for t in range(1, len(active)):
        a = int(active[t])
        at = at0[:a] + t
        top = state[:a].argmax(axis=1)
        jump = state[:a][np.arange(a), top] - penalty
        best_before[at] = top
        better = jump[:, None] > state[:a]
        switched[at] = better
        state[:a] = np.where(better, jump[:, None], state[:a]) + score[at]
    now = state.argmax(axis=1).astype(np.int32)
    for t in range(len(active) - 1, -1, -1):
        a = int(active[t])
        at = at0[:a] + t
        labels[at] = now[:a]
        if t:
            now[:a] = np.where(switched[at, now[:a]], best_before[at], now[:a])
    return labels


def fit_language(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Trigram counts per language over every given row; what reaches the driver is at most buckets x ``max_languages`` rows."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        scripts: dict[str, int] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            langs = batch.column(1).to_pylist()
            for i, j in slices(offsets):
                words = cut_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names = sorted(set(langs[i:j]))
                number = np.array([names.index(x) for x in langs[i:j]])
                of_word = number[words.doc]
                grams = np.bincount(words.bucket + np.repeat(of_word, words.length) * BUCKETS, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + grams[k]
                    for bit in range(len(SCRIPTS)):
                        seen = int(((words.script[of_word == k] >> np.uint64(bit)) & np.uint64(1)).sum())
                        scripts[name, bit] = scripts.get((name, bit), 0) + seen
        for name, grams in total.items():
            at = np.flatnonzero(grams)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(grams[at], pa.int64())], names=["lang", "bucket", "n"])
        if scripts:
            rows = sorted(scripts.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([-1 - k[1] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["lang", "bucket", "n"])

    n_languages = documents.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(max_languages + 1).count()
    if n_languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows = (
        documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(rows.lang[rows.bucket >= 0].unique())
    score = np.zeros((BUCKETS, len(languages)), np.float32)
    scripts = np.zeros(len(languages), np.uint64)
    for k, name in enumerate(languages):
        own = rows[rows.lang == name]
        grams = own[own.bucket >= 0]
        counts = np.zeros(BUCKETS)
        counts[grams.bucket.to_numpy()] = grams.n.to_numpy()
        score[:, k] = np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS))
        by_script = {-1 - int(b): int(n) for b, n in zip(own.bucket, own.n, strict=True) if b < 0}
        for bit, n in by_script.items():
            if n > 0.005 * max(1, max(by_script.values())):  # stray words don't open a script to a language
                scripts[k] |= np.uint64(1) << np.uint64(bit)
    return LanguageModel(languages, score, scripts)


def label_spans(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """Language, score and spans (byte ranges in UTF-8) of each whole text."""
    source = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    fields = [source.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField("spans", span)] if with_spans else fields)
    names = np.array([*model.languages, "und"], object)
    k = len(model.languages)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a table of max_languages columns at most

    def run(batches):
        model = sent.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, LABEL_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                score, docs, start, length, letters = [], [], [], [], []
                for p, q in slices(at):
                    words = cut_words(part[at[p] : at[q]], at[p : q + 1] - at[p])
                    score.append(word_scores(words, model))
                    docs.append(words.doc + p)
                    start.append(words.start + at[p])
                    length.append(words.length)
                    letters.append(words.lettered)
                score, docs, start, length = map(np.concatenate, (score, docs, start, length))
                labels = viterbi(score, np.bincount(docs, minlength=j - i), penalty) if k else np.zeros(0, np.int32)
                wide = max(k, 1)
                weight = np.bincount(docs * wide + labels if k else [], weights=length if k else [], minlength=(j - i) * wide).reshape(j - i, wide)
                total = weight.sum(axis=1)
                pick = weight.argmax(axis=1)
                known = np.concatenate(letters) & (total > 0) & bool(k)
                share = np.where(known, weight.max(axis=1) / np.maximum(total, 1), 0.0)
                columns = [batch.column(0).slice(i, j - i), pa.array(names[np.where(known, pick, k)], pa.string()), pa.array(share)]
                if with_spans:
                    new = np.concatenate([[True], (labels[1:] != labels[:-1]) | (docs[1:] != docs[:-1])]) if len(labels) else np.zeros(0, bool)
                    heads = np.flatnonzero(new)
                    tails = np.concatenate([heads[1:], [len(labels)]]).astype(np.int64) - 1
                    per = np.bincount(docs[heads], minlength=j - i) if len(heads) else np.zeros(j - i, int)
                    base = at[docs[heads]] if len(heads) else np.zeros(0, np.int64)
                    values = pa.StructArray.from_arrays([pa.array((start[heads] - base).astype(np.int32)), pa.array((start[tails] + length[tails] - base).astype(np.int32)), pa.array(names[labels[heads]], pa.string())] if len(heads) else [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.string())], names=["start", "end", "lang"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), values))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(documents.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)))
    found = label_spans(documents, model, with_spans=False)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
