"""Writing results: JSON lines, CSV, packages, vector tables, caches and manifests."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not there yet; returns how many."""
    from .readers import exists

    new = df
    if exists(df.sparkSession, path):
        new = df.join(df.sparkSession.read.schema(df.schema).json(path).select(key), key, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON objects in text files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def package(rows: DataFrame, zip_path: str, name: str, limit: int = 1_000_000) -> int:
    """A zip file with one file of JSON lines, written by the driver row by row: for submissions, of at most ``limit`` rows."""
    if (n := rows.count()) > limit:
        raise ValueError(f"{n} rows are more than a package holds ({limit})")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w") as f:
        for r in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator():
            f.write(r[0].encode() + b"\n")
    return n


def upsert(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the given columns from changes where these have the key, and the rows of changes whose key is new; columns that changes
    lacks are null there. Keys are unique in changes."""
    hit, *new = ["_hit", *(f"_new_{c}" for c in columns)]
    while {hit, *new} & set(table.columns):
        hit, new = f"_{hit}", [f"_{c}" for c in new]
    made = changes.select(F.col(key).alias(f"{hit}k"), F.lit(True).alias(hit), *(F.col(c).alias(n) for c, n in zip(columns, new, strict=True)))
    j = table.join(made, F.col(key) == F.col(f"{hit}k"), "full")
    pick = {c: F.when(F.col(hit), F.col(n)).otherwise(F.col(c)) for c, n in zip(columns, new, strict=True)}
    return j.select(*(F.coalesce(F.col(key), F.col(f"{hit}k")).alias(key) if c == key else pick.get(c, F.col(c)).alias(c) for c in table.columns))


def update_metadata(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """upsert() of the rows that are there; no new ones."""
    return upsert(table, changes.join(table.select(key), key, "left_semi"), key, columns)


def cache_misses(prompts: DataFrame, cache: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompts, with their SHA-256 as key, that the cache has no filled response for."""
    keyed = prompts.withColumn("key", F.sha2(F.col(prompt), 256))
    return keyed.join(cache.where(F.trim("response") != "").select("key"), "key", "left_anti")


def cache_add(cache: DataFrame, answers: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """The cache (key, response) with the filled responses to prompts that it lacks; of several answers to one prompt the first by text."""
    filled = answers.where(F.trim(F.coalesce(response, F.lit(""))) != "").groupBy(F.sha2(F.col(prompt), 256).alias("key")).agg(F.min(response).alias("response"))
    known = cache.where(F.trim("response") != "")
    return known.select("key", "response").unionByName(filled.join(known.select("key"), "key", "left_anti"))


def manifest(spark: SparkSession, sizes: dict[str, int], config: dict[str, str]) -> DataFrame:
    """One row: sizes and configuration as maps."""
    return spark.createDataFrame([(sizes, config)], "sizes map<string, long>, config map<string, string>")
