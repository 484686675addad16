"""Resampling towards a target: documents are drawn by how much likelier the target's hashed n-grams make them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import sums_before
from . import crc
from .common import concat, slices, staged, unstage

RESULTS = ("n_features", "weight", "score", "rank")


def _features(texts: list[bytes], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, each feature's text, and the number of words of each text."""
    data, at = concat(texts)
    data, starts, ends = crc.words(data)
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    of = np.repeat(np.arange(len(texts)), n_words)
    grams, doc = crc.gram_crcs(crc.word_crcs(data, starts, ends), ends - starts, of, width)
    return (grams % np.uint32(buckets)).astype(np.int64), doc, n_words


def _histogram(texts: DataFrame, text: str, width: int, buckets: int, least_words: int) -> DataFrame:
    """bucket, n: the features of all texts by bucket. Bucket -1 has the number of texts of at least so many words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, long_enough = np.zeros(buckets, dtype=np.int64), 0
        for b in batches:
            for _, _, part in slices(b.column(0)):
                got, _, n_words = _features(part, width, buckets)
                total += np.bincount(got, minlength=buckets)
                long_enough += int((n_words >= least_words).sum())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], long_enough))], names=["bucket", "n"])

    each = texts.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(count, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, width: int, buckets: int, least_words: int) -> tuple[np.ndarray, int]:
    """A thousand times the log ratio of each bucket's smoothed shares in target and docs, floored, and the number of long enough documents.

    Only counts by bucket, as many as the parameter says, come to the driver.
    """
    s, t = (_histogram(x, text, width, buckets, least_words) for x in (docs, target))
    both = s.select("bucket", F.col("n").alias("s")).join(t.select("bucket", F.col("n").alias("t")), "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st"))
    counts = np.zeros((2, buckets), dtype=np.int64)
    enough = 0
    for r in both.collect():
        if r.bucket < 0:
            enough = r.s
        else:
            counts[:, r.bucket] = r.s, r.t
    s, t = counts.astype(float)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64), enough


def weigh(docs: DataFrame, gains: np.ndarray, text: str, width: int) -> DataFrame:
    """docs with its text replaced by n_words, n_features and weight, the floored mean of its features' gains (0 without features)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, part in slices(b.column(b.num_columns - 1)):
                got, doc, n_words = _features(part, width, buckets)
                n = np.bincount(doc, minlength=len(part))
                total = np.zeros(len(part), dtype=np.int64)
                np.add.at(total, doc, gains[got])
                out.append((n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.astype(np.int64)) for c in columns)], names=["row_", "n_words_", "n_features_", "weight_"])

    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row_"), F.col(f"`{text}`").cast("binary").alias("t_"))
    kinds = ", ".join(f"{x}_ long" for x in ("n_words", "n_features", "weight"))
    return packed.mapInArrow(run, f"row_ {packed.schema['row_'].dataType.simpleString()}, {kinds}")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per row of docs: its columns without the text, and n_features, weight, score and rank (null: not drawn).

    Features are all runs of 1 to ``width`` words; each one's bucket is its CRC-32 modulo ``buckets``, composed from its words' CRCs
    (``crc``). weight is the floored mean over a document's features of how much likelier their buckets are in ``target``, and score adds a
    Gumbel variable made of seed and key, so that the highest ``percent`` of a hundred scores among the documents of at least
    ``least_words`` words are a sample without replacement. Ties go to the lesser key.

    Two passes over the texts; ranks are sums over ranges of the order, so no task has all rows. Null texts have no words; a null key is drawn
    for as an empty one and comes before others of its score. Repeated rows are ranked one after the other. An empty target or empty table is fine.
    Columns of docs that have a result's name are replaced.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c in (key, text) or c.lower() not in RESULTS))
    gains, enough = bucket_gains(docs, target, text, width, buckets, least_words)
    draw = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row_")[key].cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(draw, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, text, width).withColumn("score_", F.col("weight_") + noise)
    order = F.struct(F.col("n_words_") < least_words, -F.col("score_"), F.col("row_")[key].alias("key"), "n_features_")
    scored = staged(scored, "scored")  # ranges are found by one scan and dealt by another: the texts are not read for both
    ranked = sums_before(scored.withColumn("order_", order), [], "order_", {"ahead_": F.lit(1)})
    unstage(scored)
    place = F.col("ahead_") + 1
    drawn = (F.col("n_words_") >= least_words) & (place <= percent * enough // 100)
    others = [F.col("row_")[c].alias(c) for c in docs.columns if c != text]
    return ranked.select(*others, *(F.col(f"{c}_").alias(c) for c in ("n_features", "weight", "score")), F.when(drawn, place).cast("long").alias("rank"))
