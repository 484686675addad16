"""Extendible hashing: shards of bounded bytes, found by splitting only the oversized buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small, staged, unstage

#: Bits counted in one round beyond those that even shards would need, and at most.
SPARE_BITS, MAX_BITS = 5, 30


def bucket_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of key and text, as a number; null is not the empty text."""
    told = lambda c: F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))
    return F.conv(F.substring(F.md5(F.concat(told(key), F.lit("|"), told(text))), 1, 15), 16, 10).cast("long")


def _bits(h: Column, used: int, bits: int) -> Column:
    """The bits of a hash of 60 that follow the first ``used``, as text of 0 and 1: the name of a bucket within one named by those."""
    return F.lpad(F.bin(F.shiftright(h, 60 - used - bits).bitwiseAND((1 << bits) - 1)), bits, "0") if bits else F.lit("")


def _leaves(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """Of the trees over cells (lead, cell of ``bits`` bits, bytes, rows): the buckets at or under the limit whose parent is over it, and
    cells over it that no bit here splits."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    nodes = cells.select(depths, "*").groupBy("lead", "depth", F.expr("substr(cell, 1, depth)").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    nodes = staged(nodes, "nodes")
    whole = (F.col("bytes") <= limit) | (F.col("rows") <= 1)
    split = nodes.where(~whole & (F.col("depth") < bits)).select("lead", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    children = nodes.withColumn("up", F.expr("substr(node, 1, greatest(depth - 1, 0))"))
    below = children.join(split, ["lead", "depth", "up"], "left_semi").unionByName(children.where("depth = 0"))
    leaves = staged(below.where(whole | (F.col("depth") == bits)).select("lead", "node", "depth", "bytes", "rows", whole.alias("done")), "leaves")
    unstage(nodes)
    return leaves


def _numbered(rest: DataFrame, h: str, columns: list[str]) -> DataFrame:
    """rest with another hash in h, that also covers the other columns and, of rows equal in all, a number from 0 for each. Equal rows are
    numbered by the part of the table they are in, so that however many there are, no task has all."""
    at, part, nth, before = fresh(rest, "at", "part", "nth", "before")
    fixed = staged(rest.withColumn(h, F.xxhash64(h, *columns)).withColumn(at, F.monotonically_increasing_id()), "rest")
    parted = fixed.withColumn(part, F.shiftrightunsigned(at, 33))
    counts = parted.groupBy(h, part).agg(F.count("*").alias(nth))
    up = Window.partitionBy(h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select(h, part, F.coalesce(F.sum(nth).over(up), F.lit(0)).alias(before)), "counts")
    own = F.row_number().over(Window.partitionBy(h, part).orderBy(at))
    again = parted.join(small(counts), [h, part]).withColumn(h, F.shiftrightunsigned(F.xxhash64(h, F.col(before) + own), 4))
    out = staged(again.drop(at, part, before), "rest")
    unstage(counts, fixed)
    return out


def extendible_shards(df: DataFrame, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deals the rows of df into shards of at most ``limit`` bytes of text.

    A row's bucket is named by the first bits of a hash of its key and text. Bits are counted in one pass, a few more
    than even shards need; only buckets over the limit split on the next bit. The directory has as many bits as the
    deepest bucket, and those of its names that rows have. Buckets still over the limit go on, until none is, on the
    hash's other bits, and where these end on the bits of another hash, which also covers the other columns and a
    number that each of equal rows gets. A document longer than the limit has a shard of its own.

    Adds shard (the bucket's bits, as text; empty if one shard is enough), shard_bytes, shard_rows and doc_bytes
    (null text: 0). Columns of those names in df are replaced; others may have any names. Null keys and texts hash as
    such; an empty table stays empty. Reruns agree, whatever the order of rows.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    out = df.drop("shard", "shard_bytes", "shard_rows", "doc_bytes")
    added = ["doc_bytes", "shard", "shard_bytes", "shard_rows"]
    h, lead, cell, done = fresh(out, "h", "lead", "cell", "done")
    hashed = [f"`{f.name}`" for f in out.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    open_ = out.withColumns({h: bucket_hash(F.col(key), F.col(text)), "doc_bytes": size, lead: F.lit("")})
    largest = open_.agg(F.coalesce(F.sum("doc_bytes"), F.lit(0))).first()[0]
    result, used = None, 0
    while True:
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(largest, 1) / limit))) + SPARE_BITS) if result is None else min(MAX_BITS, 60 - used)
        name = _bits(F.col(h), used, bits)
        cells = staged(open_.groupBy(F.col(lead).alias("lead"), name.alias("cell")).agg(F.sum("doc_bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
        leaves = _leaves(cells, bits, limit)
        deepest, over = leaves.agg(F.coalesce(F.max("depth"), F.lit(0)), F.max(F.when(~F.col("done"), F.col("bytes")))).first()
        names = cells.select("lead", F.substring("cell", 1, deepest).alias("cell")).distinct()
        names = names.select("lead", "cell", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth")).withColumn("node", F.expr("substr(cell, 1, depth)"))
        directory = names.join(leaves, ["lead", "depth", "node"])
        directory = directory.select(F.col("lead").alias(lead), F.col("cell").alias(cell), F.concat("lead", "node").alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), F.col("done").alias(done))
        directory = staged(directory, "directory")
        unstage(cells, leaves)
        dealt = open_.withColumn(cell, F.substring(name, 1, deepest)).join(small(directory), [lead, cell])
        settled = dealt.where(done).select(*out.columns, *added)
        result = settled if result is None else result.unionByName(settled)
        if over is None:
            return result
        rest = dealt.where(~F.col(done)).withColumn(lead, F.col("shard")).select(*out.columns, "doc_bytes", h, lead)
        used += bits
        if used < 60:
            open_ = staged(rest, "rest")
        else:
            open_, used = _numbered(rest, h, hashed), 0
