"""Reading annotation records: JSON lines of varying keys, whole files, CSV, vectors, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = "array<struct<startIndex: string, endIndex: string, type: string, text: string>>"
#: Every key that a record may have; those missing are null.
RECORD = f"_id string, id string, doc_id string, subreddit string, source string, text string, body string, conspiracy string, label string, annotator string, markers {MARKERS}"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = False) -> DataFrame:
    """Records of JSON lines; blank and malformed lines are left out, or an error if strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record")


def read_jsonl_repaired(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Like read_jsonl, but a line is parsed from its first to its last brace."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"(?s)(\{.*\})", 1).alias("v")).where("v <> ''")
    parsed = lines.select(F.from_json("v", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return parsed.where("_corrupt_record is null").drop("_corrupt_record")


def read_texts(spark: SparkSession, path: str, part: int = -1) -> DataFrame:
    """One document per file: doc_id is the file's name without its ending, or that of another part of its path (-2: its folder's)."""
    name = F.element_at(F.split(F.input_file_name(), "/"), part)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_json(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame | None:
    """One JSON document per file; default if there is no such path."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else default


def latest(spark: SparkSession, pointer: str) -> str:
    """The path that a pointer file holds; an error if that does not exist."""
    path = spark.read.text(pointer).first()[0].strip()
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def has_labels(df: DataFrame, label: Column, rows: int = 200) -> bool:
    """Whether any of the first rows is labelled."""
    return not df.limit(rows).where(label.isNotNull()).isEmpty()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, SHA-256 and a preview (the first 200 bytes as text) of every file. Files are read whole, one at a time: for
    configuration and prompts, not for data."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode(F.substring("content", 1, 200), "UTF-8").alias("preview"))


def collection(vectors: DataFrame, **filters) -> DataFrame:
    """The rows of a vector table whose metadata columns have the given values: key, vector and metadata, as a collection returns them."""
    for column, value in filters.items():
        vectors = vectors.where(F.col(column) == value)
    return vectors


def rehydrate(ids: DataFrame, fetched: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Ids joined to fetched texts (key, body): records with text, and failures with a reason: not_found, invalid_body, empty_body, deleted
    or removed."""
    j = ids.join(fetched.select(key, F.col("body").alias("text"), F.lit(True).alias("_found")), key, "left")
    t = F.trim("text")
    reason = F.when(F.col("_found").isNull(), "not_found").when(F.col("text").isNull(), "invalid_body").when(t == "", "empty_body").when(t == "[deleted]", "deleted").when(t == "[removed]", "removed")
    j = j.withColumn("reason", reason).drop("_found")
    return j.where("reason is null").drop("reason"), j.where("reason is not null").drop("text")
