"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgraph.functions.storage import found
from docgraph.operators.parsing import html_to_text

_NAMED = "array<struct<{0}Id:int,{0}Name:string>>"
METADATA = (
    "docGUId string, docName string, docIdentity string, issueDate string, effectDate string, expireDate string, gazetteNumber string, gazetteDate string, "
    "docGroup struct<docGroupId:int,docGroupName:string>, docType struct<docTypeId:int,docTypeName:string>, effectStatus struct<effectStatusId:int,effectStatusName:string>, "
    f"fields {_NAMED.format('field')}, organs {_NAMED.format('organ')}, signers {_NAMED.format('signer')}, "
    "docListOther array<struct<docGUId:string,docName:string,docIdentity:string,fieldName:string>>"
)
AMENDS = "doc_identity string, amends array<struct<amending_doc_identity:string,amending_article:string,amending_clause:string,amending_point:string,amend_type:string,target_doc_identity:string,target_article:string,target_clause:string,target_point:string>>"
QA_COLUMNS = ("id", "question", "answer", "reference")


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("stem", _stem())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(_stem().alias("stem"), F.col("value").alias("text"))


def pair_documents(metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """Either side may be missing; the identity falls back to the stem with ``-`` as ``/``."""
    return metadata.join(texts, "stem", "full_outer").withColumn("doc_identity", F.coalesce("docIdentity", F.replace(F.col("stem"), F.lit("-"), F.lit("/"))))


def metadata_document(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.col("docIdentity").alias("doc_identity"), F.col("docGUId").alias("doc_guid"), F.col("docName").alias("doc_name"), *(F.col(c).alias(n) for c, n in (("issueDate", "issue_date"), ("effectDate", "effect_date"), ("expireDate", "expire_date"), ("gazetteNumber", "gazette_number"), ("gazetteDate", "gazette_date"))))


# label, edge type, id and name of each dimension
DIMENSIONS = (("DocumentGroup", "BELONGS_TO_GROUP", "docGroup"), ("DocumentType", "HAS_TYPE", "docType"), ("EffectStatus", "HAS_STATUS", "effectStatus"), ("Organization", "ISSUED_BY", "organ"), ("Signer", "SIGNED_BY", "signer"), ("Field", "IN_FIELD", "field"))


def metadata_dimensions(metadata: DataFrame) -> DataFrame:
    """(doc_identity, label, type, id, name): the six dimensions and their edges to the document."""
    out = None
    for label, kind, stem in DIMENSIONS:
        many = f"{stem}s" in metadata.columns
        item = F.explode(f"{stem}s") if many else F.col(stem)
        part = metadata.select(F.col("docIdentity").alias("doc_identity"), item.alias("x")).select("doc_identity", F.lit(label).alias("label"), F.lit(kind).alias("type"), F.col(f"x.{stem}Id").alias("id"), F.col(f"x.{stem}Name").alias("name")).where("id is not null")
        out = part if out is None else out.unionByName(part)
    return out


def related_stubs(metadata: DataFrame) -> DataFrame:
    """Related documents (RELATED_TO): key is the identity, else the guid."""
    return metadata.select(F.col("docIdentity").alias("doc_identity"), F.explode("docListOther").alias("x")).select("doc_identity", F.coalesce("x.docIdentity", "x.docGUId").alias("target"), F.col("x.docName").alias("doc_name"), F.col("x.docGUId").alias("doc_guid"))


def read_amends(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(AMENDS).option("multiLine", True).json(path)
    return raw.select(F.posexplode("amends").alias("seq", "a")).select("seq", "a.*")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """QA rows; headers are trimmed and lower-cased, missing columns fail."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    missing = set(QA_COLUMNS) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def unprocessed(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def read_row_results(spark: SparkSession, path: str, configs: list[str] | None = None) -> DataFrame:
    """All ``row_results*.csv`` of a folder with the config in their name."""
    df = spark.read.option("header", True).option("multiLine", True).option("pathGlobFilter", "row_results*.csv").csv(path)
    df = df.withColumn("config", F.regexp_extract(F.col("_metadata.file_name"), r"^row_results_?(.*)\.csv$", 1))
    return df.where(F.col("config").isin(configs)) if configs else df


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Input items given as a list or as an object of items, with alias keys."""
    item = "struct<document_name:string,content:string,noi_dung:string,aspects_list:array<string>,aspects:array<string>>"
    raw = spark.read.text(path, wholetext=True)
    as_list = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>"))
    as_map = F.map_values(F.when(F.ltrim("value").startswith("{"), F.from_json("value", f"map<string,{item}>")))
    return raw.select(F.explode(F.coalesce(as_list, as_map)).alias("i")).select("i.document_name", F.coalesce("i.content", "i.noi_dung").alias("content"), F.coalesce("i.aspects_list", "i.aspects").alias("aspects"))


def split_details(details: DataFrame, html_col: str = "docContent") -> tuple[DataFrame, DataFrame]:
    """Text (from HTML) and metadata (all other fields) of fetched records."""
    return details.select("docGUId", html_to_text(F.col(html_col)).alias("text")), details.drop(html_col)


def numbered_output(samples: DataFrame, order: str, width: int = 10_000) -> DataFrame:
    """A key like ``0001_task1`` per sample, counted per task in the order of a whole number.

    Numbers run inside stretches of ``width`` positions; counts tell where each stretch begins.
    """
    cut = samples.withColumn("stretch", F.floor(F.col(order) / width))
    before = Window.partitionBy("task").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    starts = cut.groupBy("task", "stretch").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = cut.withColumn("rn", F.row_number().over(Window.partitionBy("task", "stretch").orderBy(order))).join(starts, ["task", "stretch"])
    return numbered.withColumn("key", F.concat_ws("_", F.format_string("%04d", F.col("start") + F.col("rn")), "task")).drop("stretch", "start", "rn")


def write_parsed(bundles: DataFrame, path: str) -> None:
    """Parsed documents as JSON, one object each with nulls written out."""
    bundles.write.option("ignoreNullFields", False).json(path)


def read_parsed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parsed documents as ``write_parsed`` leaves them, or as one JSON file each."""
    return spark.read.schema(schema).option("multiLine", False).json(path)


PAYLOAD = "id string, question string, expert_answer string, uids array<string>, law_text string, extra_info string, top_k int, llm_answer string"


def append_payloads(rows: DataFrame, path: str, batch: str) -> None:
    """Adds payload rows as JSON lines under the batch's name; with ``unprocessed`` a run goes on where the last one ended.

    Spark's marker commits a batch: one that died before it is not read, and its retry takes its place.
    """
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of all batches that were written whole."""
    done = [p.rsplit("/", 1)[0] for p in found(spark, f"{path}/batch=*/_SUCCESS")]
    return spark.read.schema(PAYLOAD).json(done) if done else spark.createDataFrame([], PAYLOAD)


def write_chatml(samples: DataFrame, path: str) -> None:
    """JSON lines with the rendered ``text`` alone."""
    samples.select("text").write.json(path)


def read_chatml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path)
