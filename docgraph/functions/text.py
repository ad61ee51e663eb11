"""Column functions shared by the operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Segment names of a uid.
SEGMENT_NAMES = {"article": "Điều", "clause": "Khoản", "point": "Điểm", "section": "Mục", "chapter": "Chương", "part": "Phần"}
# Leading type words of document names.
TYPE_WORDS = ("Luật", "Nghị định", "Thông tư", "Nghị quyết", "Quyết định", "Sắc lệnh", "Sắc luật", "Hiến pháp")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Trim Unicode whitespace."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def strip_fences(text: Column) -> Column:
    """Model output without code fences."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"</?think[^>]*>", ""))


def has_punctuation(token: Column) -> Column:
    return token.rlike(r"[\p{P}&&[^_]]")


def to_bool(text: Column) -> Column:
    return F.lower(strip(text.cast("string"))) == "true"


def clean_id(value: Column) -> Column:
    return F.regexp_replace(strip(value.cast("string")), r"\.0$", "")


def parse_list(text: Column, top_k: int | None = None) -> Column:
    """Values between commas or semicolons, trimmed, blanks dropped; a negative or absent cut keeps all."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), strip), lambda x: x != "")
    return items if top_k is None or top_k < 0 else F.slice(items, 1, top_k)


def format_uid(uid: Column) -> Column:
    """Human-readable uid: segments deepest first, the document last."""
    parts = F.split(uid, "::")
    pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.floor((F.size(parts) - 1) / 2), F.lit(1)).cast("int")), lambda i: F.struct(F.element_at(parts, 2 * i).alias("k"), F.element_at(parts, 2 * i + 1).alias("v"))))
    name = lambda k: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEGMENT_NAMES.items() for x in kv)), k), F.initcap(k))
    shown = F.reverse(F.transform(pairs, lambda p: F.concat_ws(" ", name(p["k"]), p["v"])))
    return F.when(F.size(parts) > 1, F.concat_ws(" ", shown, F.element_at(parts, 1))).otherwise(uid)


def label_from_uid(uid: Column) -> Column:
    return F.when(uid.contains("::point::"), "Point").when(uid.contains("::clause::"), "Clause").otherwise("Article")


def short_name(doc_name: Column, identity: Column) -> Column:
    word = F.regexp_extract(F.coalesce(doc_name, F.lit("")), "(?iu)^(" + "|".join(TYPE_WORDS) + ")", 1)
    return F.when(word != "", F.concat_ws(" ", word, identity)).otherwise(identity)


def ancestor_uids(uid: Column) -> Column:
    """The uid and the clause and article above it, deepest first."""
    article, clause = F.substring_index(uid, "::", 3), F.substring_index(uid, "::", 5)
    return F.when(uid.contains("::point::"), F.array(uid, clause, article)).when(uid.contains("::clause::"), F.array(uid, article)).otherwise(F.array(uid))


# Turn tokens of model families, in order of replacement.
TURN_TOKENS = {"gemma": (("<|im_start|>user", "<|turn>user"), ("<|im_start|>assistant", "<|turn>model"), ("<|im_start|>", "<|turn>"), ("<|im_end|>", "<turn|>"), ("<think>", "<|channel>thought"), ("</think>", "<channel|>"))}


def turn_tokens(prompt: Column, model: Column) -> Column:
    """The prompt with the turn tokens of the model's family."""
    out = prompt
    for family, pairs in TURN_TOKENS.items():
        changed = prompt
        for old, new in pairs:
            changed = F.replace(changed, F.lit(old), F.lit(new))
        out = F.when(F.lower(model).contains(family), changed).otherwise(out)
    return out


def fill_template(template: str, columns: list[str]) -> Column:
    """A prompt with each ``{name}`` replaced by the column of that name."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
