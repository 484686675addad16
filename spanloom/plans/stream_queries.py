"""Streams over the events table, run until all of it is read, against the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.staging import scratch
from ..operators.views import table
from ..streaming.streams import append_results, finished_windows, late_counts, read_stream
from .registry import query


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def stream_event_counts(spark, d):
    """Batches append their own counts; the counts are added up when read."""
    schema = table(spark, d, "events").schema
    at = scratch(spark, "stream")
    stream = read_stream(spark, f"{d}/events.parquet", schema)
    append_results(stream, f"{at}/out", f"{at}/checkpoint", lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))).awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))


LATE_SQL = """with e as (select *, least(2, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) // 864000000000) + case when event_id % 29 = 0 then 1 else 0 end as slice from events),
marks as (select s.slice, (select max(epoch_us(ts)) // 1000 - 7200000 from e where e.slice < s.slice) as mark from (select distinct slice from e) s),
rows_ as (select date_trunc('hour', ts) as start, event_type, coalesce(epoch_us(date_trunc('hour', ts)) // 1000 + 3600000 <= mark, false) as late from e join marks using (slice)),
last as (select max(epoch_us(ts)) // 1000 - 7200000 as mark from e)
select start, event_type, case when epoch_us(start) // 1000 + 3600000 <= any_value(mark) then nullif(count(*) filter (not late), 0) end as n, count(*) filter (late) as n_late from rows_, last group by 1, 2"""


@query(LATE_SQL)
def stream_late_windows(spark, d):
    """The events in slices of ten days, one in 29 of them a slice late, each slice after the stream has stopped and is started again:
    counts of the windows that the watermark (two hours behind) has passed, each written once, and of the rows that came too late for
    theirs. A window that is still open has no count."""
    at = scratch(spark, "late")
    events = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first = F.unix_micros(F.lit(events.agg(F.min("ts")).first()[0]).cast("timestamp"))
    late = F.when(F.col("event_id") % 29 == 0, 1).otherwise(0)
    slices = events.withColumn("slice", F.least(F.lit(2), F.floor((F.unix_micros("ts") - first) / 864_000_000_000)) + late)
    for n in range(4):
        slices.where(F.col("slice") == n).drop("slice").write.mode("append").parquet(f"{at}/in")
        stream = read_stream(spark, f"{at}/in", events.schema, files=1_000_000)
        finished_windows(stream, f"{at}/out", f"{at}/windows", "ts", "event_type").awaitTermination()
        append_results(late_counts(stream, "ts", "event_type"), f"{at}/late", f"{at}/counts").awaitTermination()
    done = spark.read.parquet(f"{at}/out")
    missed = spark.read.parquet(f"{at}/late").groupBy("start", "event_type").agg(F.sum("n_late").alias("n_late"))
    every = events.select(F.date_trunc("hour", "ts").alias("start"), "event_type").distinct()
    out = every.join(done, ["start", "event_type"], "left").join(missed, ["start", "event_type"], "left")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.coalesce("n_late", F.lit(0)).alias("n_late"))
