"""Late rows over a restart: left out of their window, and counted."""

import datetime as dt

from spanloom.streaming import streams as sr


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    slices = [
        [(at(10, 5), "a"), (at(10, 50), "a"), (at(12), "b"), (at(14, 30), "a")],  # the watermark is 12:30 then
        [(at(10, 59), "a"), (at(10, 1), "b"), (at(12, 1), "b"), (at(13), "b"), (at(20), "c")],  # the first two are late, 12:01 is not: its window ends at 13:00
    ]
    where = lambda name: f"file://{tmp_path}/{name}"
    for rows in slices:  # each time the stream has stopped and starts again
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(where("in"))
        stream = sr.read_stream(spark, where("in"), "ts timestamp, kind string")
        sr.finished_windows(stream, where("out"), where("c1"), "ts", "kind").awaitTermination()
        sr.append_results(sr.late_counts(stream, "ts", "kind"), where("late"), where("c2")).awaitTermination()
    done = {(r.start.hour, r.kind): r.n for r in spark.read.parquet(where("out")).collect()}
    assert done == {(10, "a"): 2, (12, "b"): 2, (13, "b"): 1, (14, "a"): 1}  # 20:00 is still open
    late = {(r.start.hour, r.kind): r.n_late for r in spark.read.parquet(where("late")).collect()}
    assert late == {(10, "a"): 1, (10, "b"): 1}


def test_complete_results_keep_the_last(spark, tmp_path):
    where = lambda name: f"file://{tmp_path}/{name}"
    for rows in ([(1, 1), (0, 1)], [(1, 1), (0, 0)]):
        spark.createDataFrame(rows, "y int, p_label int").coalesce(1).write.mode("append").parquet(where("in"))
        sr.complete_results(sr.running_confusion(sr.read_stream(spark, where("in"), "y int, p_label int")), where("out"), where("c")).awaitTermination()
    assert sorted(map(tuple, sr.latest(spark, where("out")).select("y", "p_label", "n").collect())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2)]
