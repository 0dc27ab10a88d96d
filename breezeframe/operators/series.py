"""Hourly series: trailing means, lags, rolling means, windows that must be complete, sessions.

Positional operators use ROWS frames, exact-time ones RANGE frames or joins; with gaps
in a series they differ, and their names say which they are. All are partitioned by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import index as ix

GAS_COLUMNS = ("pm25", "pm10", "no2", "o3", "co")
LEAST_HOURS = 3


def by_time():
    return W.partitionBy("series").orderBy("t")


def with_index(air: DataFrame) -> DataFrame:
    """Adds s_<gas>, instant, dominant, missing and band_i (the instantaneous band's number)."""
    subs = {k: F.col(f"s_{k}") for k in GAS_COLUMNS}
    out = air.withColumns({f"s_{k}": ix.sub_index(k, F.col(k)) for k in GAS_COLUMNS})
    out = out.withColumn("instant", F.greatest(*subs.values()))
    return out.withColumns({"dominant": ix.dominant(subs, F.col("instant")), "missing": ix.missing(subs), "band_i": ix.ordinal(F.col("instant"))})


def with_trailing(indexed: DataFrame) -> DataFrame:
    """Adds trail, trailing_hours, effective and band_e. Means are over rows; negative and missing readings are left out.

    All gases share one window specification, so the series is sorted once.
    """
    frame = {k: by_time().rowsBetween(1 - ix.AVERAGING_HOURS[k], 0) for k in GAS_COLUMNS}
    good = {k: F.when(F.col(k) >= 0, F.col(k)) for k in GAS_COLUMNS}
    return trailing_of_means(indexed.withColumns({f"m_{k}": F.avg(good[k]).over(frame[k]) for k in GAS_COLUMNS} | {f"n_{k}": F.count(good[k]).over(frame[k]) for k in GAS_COLUMNS}))


def trailing_of_means(out: DataFrame) -> DataFrame:
    """The trailing index of rows that have the mean m_<gas> of each window and the number n_<gas> of its readings."""
    subs = {k: F.when(F.col(f"n_{k}") >= LEAST_HOURS, ix.sub_index(k, F.col(f"m_{k}"))) for k in GAS_COLUMNS}
    out = out.withColumns({f"ts_{k}": subs[k] for k in GAS_COLUMNS}).withColumn("trail", F.greatest(*[F.col(f"ts_{k}") for k in GAS_COLUMNS]))
    lead = ix.dominant({k: F.col(f"ts_{k}") for k in GAS_COLUMNS}, F.col("trail"))
    hours = F.coalesce(*[F.when(lead == k, F.col(f"n_{k}")) for k in GAS_COLUMNS])
    out = out.withColumns({"trailing_hours": hours, "effective": ix.conservative(F.col("instant"), F.col("trail"))})
    return out.withColumn("band_e", ix.ordinal(F.col("effective"))).drop(*[f"{p}_{k}" for p in ("m", "n", "ts") for k in GAS_COLUMNS])


def lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(by_time())


def rolling(c: str, n: int) -> Column:
    return F.avg(c).over(by_time().rowsBetween(1 - n, 0))


def with_lags(df: DataFrame, c: str = "effective") -> DataFrame:
    """Positional lags, differences, the six-hour rate and rolling means of one column."""
    out = df.withColumns({f"lag{n}": lag(c, n) for n in (1, 3, 6)})
    out = out.withColumns({f"diff{n}": F.col(c) - F.col(f"lag{n}") for n in (1, 3, 6)})
    return out.withColumns({"rate6": F.col("diff6") / 6.0, "rolling3": rolling(c, 3), "rolling6": rolling(c, 6)})


def hours_frame(before: int, after: int):
    """An exact-time frame around each row, as a RANGE over the hour's number."""
    return W.partitionBy("series").orderBy(hour_number(F.col("t"))).rangeBetween(-before, after)


def hour_number(t: Column) -> Column:
    return F.floor(F.unix_seconds(t.cast("timestamp")) / 3600)


def at_offset(df: DataFrame, hours: int, columns: dict[str, str]) -> DataFrame:
    """Left join of the row that is exactly so many hours later (earlier if negative): {new name: column}."""
    other = df.select("series", (F.col("t") - F.make_interval(hours=F.lit(hours))).alias("t"), *[F.col(c).alias(new) for new, c in columns.items()])
    return df.join(other, ["series", "t"], "left")


def with_episodes(df: DataFrame, positive: Column, gap_hours: int = 6) -> DataFrame:
    """The positive rows with an episode number within their series; a gap of more than gap_hours starts a new one."""
    rows = df.where(positive)
    before = F.lag("t").over(by_time())
    new = F.when(before.isNull() | (F.col("t") - before > F.make_dt_interval(hours=F.lit(gap_hours))), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("episode", F.sum("_new").over(by_time().rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def chronological_split(df: DataFrame, holdout: float = 0.2) -> DataFrame:
    """Adds `part`: the first int(n (1 - holdout)) rows of a series (one at least) are train."""
    n = F.count("*").over(W.partitionBy("series"))
    cut = F.greatest(F.lit(1), F.floor(n * (1 - holdout)))
    return df.withColumn("part", F.when(F.row_number().over(by_time()) <= cut, F.lit("train")).otherwise(F.lit("test")))
