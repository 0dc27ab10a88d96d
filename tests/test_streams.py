"""Streams give every window that the batch over the same events gives."""

from breezeframe.plans import QUERIES, streams

DATA = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_hourly_windows_are_whole(spark):
    out = streams.stream_hourly(spark, DATA)
    columns = ("start", "event_type", "n", "total")
    assert rows(out, *columns) == rows(QUERIES["batch_hourly"](spark, DATA), *columns)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert out.agg({"n": "sum"}).first()[0] == events.count()


def test_sessions_are_whole(spark):
    out = streams.stream_sessions(spark, DATA)
    assert rows(out, "user_id", "start", "n") == rows(QUERIES["batch_sessions"](spark, DATA), "user_id", "start", "n")
    assert out.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()


def readings(rows):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    return [(s, k, None if hour is None else day + dt.timedelta(hours=hour), value, *[None] * 4) for k, (s, hour, value) in enumerate(rows)]


def test_late_rows_are_refused_across_restarts(spark, tmp_path):
    """State outlives a restart; a late, an equal and a null hour go to the log of refused rows and change nothing."""
    from breezeframe.streaming import trailing as tr
    from breezeframe.streaming.log import AppendLog, write_into

    parts = [[(1, 0, 10.0), (1, 2, 30.0), (1, 1, 999.0), (2, 5, 1.0)], [(1, 2, 999.0), (1, None, 999.0), (1, 3, -5.0), (1, 4, None), (1, 5, 50.0)], [(1, 4, 999.0), (1, 40, 70.0)]]
    good, bad = (AppendLog(f"file://{tmp_path}/{n}", tr.ROWS, "parquet") for n in ("good", "bad"))
    at = 0
    for part in parts:
        rows = [(s, at + k, *rest) for s, k, *rest in readings(part)]
        at += len(part)
        spark.createDataFrame(rows, tr.READINGS).repartition(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(tr.READINGS).parquet(f"file://{tmp_path}/in")
        write_into(tr.trailing_rows(stream), {good: "NOT refused", bad: "refused"}, f"file://{tmp_path}/checkpoint").awaitTermination()
    got = [(r["t"].day * 24 + r["t"].hour - 24, r["n_pm25"], r["m_pm25"]) for r in good.read(spark).where("series = 1").orderBy("t").collect()]
    assert got == [(0, 1, 10.0), (2, 2, 20.0), (3, 2, 20.0), (4, 2, 20.0), (5, 3, 30.0), (40, 4, 40.0)]
    assert sorted((r["arrival"], r["pm25"]) for r in bad.read(spark).collect()) == [(2, 999.0), (4, 999.0), (5, 999.0), (9, 999.0)]


def test_means_leave_the_window():
    import numpy as np

    from breezeframe.streaming import trailing as tr

    values = np.arange(60.0)
    whole, n = tr.means(values, np.empty(0), 24)
    assert whole[59] == values[36:].mean() and n.max() == 24
    rest, _ = tr.means(values[40:], values[17:40], 24)
    assert (rest == whole[40:]).all()


def test_repeated_batch_counts_once(spark, tmp_path):
    from breezeframe.streaming.log import AppendLog

    log = AppendLog(f"file://{tmp_path}/log", "b long, a string")
    assert log.read(spark).count() == 0
    first = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "b long, a string")
    assert log.append(first, 0) and log.append(first.limit(0), 1)
    before = sorted(map(tuple, log.read(spark).collect()), key=str)
    assert not log.append(first.union(first), 0)
    assert sorted(map(tuple, log.read(spark).collect()), key=str) == before and len(before) == 3
    # A write that broke off left no mark: it is done again.
    (tmp_path / "log" / "batch=0" / "_SUCCESS").unlink()
    assert log.append(first, 0) and log.read(spark).count() == 3
