"""Streams of records: resumable output, windowed counts with late data, and running scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of the files in a folder, or of the one file of that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by time window and ``by``; those later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")


def first_seen(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_results(stream: DataFrame, path: str, checkpoint: str, transform=lambda df: df) -> StreamingQuery:
    """Writes each batch's results once, by batch number, until all that is there is read; a rerun goes on where it ended."""

    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_windows(stream: DataFrame, path: str, checkpoint: str, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> StreamingQuery:
    """Appends each window's counts (``windowed_counts``) to the folder once, when the watermark has passed its end, until all that is there is read.

    A restart with the same checkpoint goes on with the open windows; the folder's log makes each window's rows count once, whatever fails.
    """
    counts = windowed_counts(stream, ts, by, window, late)
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def late_counts(stream: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, by, n_late: of each batch, the rows that come too late for their window, whose end the watermark has passed.

    The operator has the watermark from its state's handle and keeps no state, so nothing grows; keys are windows, so that a
    common value of ``by`` is not one task. For append mode; a window's counts of several batches add up.
    """
    kind = stream.schema[by].dataType.simpleString()
    rows = stream.withWatermark(ts, late).select(F.window(ts, window).alias("w"), F.col(by).alias("by"), ts)
    rows = rows.select(F.col("w.start").alias("start"), F.unix_millis("w.end").alias("end_ms"), "by", ts)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(p) for p in parts)
        if key[1] <= state.getCurrentWatermarkMs():
            yield pd.DataFrame({"start": [key[0]], "by": [key[2]], "n_late": [n]})

    told = rows.groupBy("start", "end_ms", "by").applyInPandasWithState(count, f"start timestamp, by {kind}, n_late long", "seen int", "append", GroupStateTimeout.NoTimeout)
    return told.withColumnRenamed("by", by)


def complete_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the whole result after each batch, by batch number: the last one, ``latest(path)``, is the answer."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the highest batch in the folder."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def running_confusion(stream: DataFrame) -> DataFrame:
    """Counts of right and wrong so far over rows (y, p_label), for update mode."""
    return stream.groupBy("y", "p_label").agg(F.count("*").alias("n"))
