"""Queries over the hourly series: index, features, policies, joins, selection."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import index as ix
from ..functions import policy as po
from ..functions import weather as we
from ..operators import series as se
from ..sources import adapters as ad
from .sql import INDEX_SQL, LABELLED_SQL, SLOTS_SQL, TRAILING_SQL, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _even_handed(sql: str) -> str:
    """`round(x, n)` in the text stands for the rounding of `rounded`."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner, digits = sql[m.end() : k - 1].rsplit(",", 1)
        out += [sql[at : m.start()], rsql(inner, int(digits))]
        at = k
    return "".join(out) + sql[at:]


def query(sql: str | None = None, also: str | None = None):
    """Register a function as the query of its name (and of a second one), with the SQL that must agree."""

    def add(f: Query) -> Query:
        for name in filter(None, (f.__name__, also)):
            QUERIES[name] = f
            if sql is not None:
                ORACLE_SQL[name] = _even_handed(sql)
        return f

    return add


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounding in which values a hair apart, as sums in another order are, agree also at ties."""
    return F.floor(x * float(10**digits) + 0.501) / float(10**digits)


def r6(c: str) -> Column:
    return rounded(F.col(c)).alias(c)


def rsql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.501::DOUBLE) / {10**digits}.0::DOUBLE"


# --- frames that queries share


def indexed(spark, d, series=4):
    return se.with_index(ad.air(spark, d, series))


def trailing(spark, d, series=4):
    return se.with_trailing(indexed(spark, d, series))


def slots(spark, d, series=4):
    return trailing(spark, d, series).join(ad.weather(spark, d, series), ["series", "t"], "left")


def labelled(spark, d, series=4):
    """Rows whose label is the instantaneous band six rows on, with the persistence forecast and a made probability."""
    at = lambda c: F.lead(c, 6).over(se.by_time())
    rows = slots(spark, d, series).withColumns({"label": at("band_i"), "target": at("instant"), "target_t": at("t")})
    rows = rows.where("label IS NOT NULL AND band_i IS NOT NULL AND band_e IS NOT NULL").withColumn("pred", F.col("band_i"))
    key = F.col("user_id") if series is None else F.col("user_id") % series
    n = ad.table(spark, d, "events").groupBy(key.cast("int").alias("series"), ad.hour_of(F.col("ts")).alias("t")).agg(F.count("*").alias("n_events"))
    return rows.join(n, ["series", "t"]).withColumn("prob", F.col("n_events") % 101 / 100.0)


def thunder():
    return F.coalesce(we.category(F.col("weather_code")) == "thunderstorm", F.lit(False))


# --- index


@query(with_views(INDEX_SQL, "SELECT series, t, round(s_pm25, 6) AS s_pm25, round(s_pm10, 6) AS s_pm10, round(s_no2, 6) AS s_no2, round(s_o3, 6) AS s_o3, round(s_co, 6) AS s_co, missing FROM idx"))
def sub_indices(spark, d):
    return indexed(spark, d).select("series", "t", *[r6(f"s_{k}") for k in se.GAS_COLUMNS], "missing")


@query(with_views(INDEX_SQL, f"SELECT series, t, round(instant, 6) AS instant, dominant, {ix.band_sql('band_i')} AS band FROM idx"))
def index_band(spark, d):
    return indexed(spark, d).select("series", "t", r6("instant"), "dominant", ix.band(F.col("band_i")).alias("band"))


@query(with_views(INDEX_SQL, "SELECT dominant, band_i, count(*)::BIGINT AS n FROM idx WHERE instant IS NOT NULL GROUP BY ALL"))
def dominant_counts(spark, d):
    return indexed(spark, d).where("instant IS NOT NULL").groupBy("dominant", "band_i").agg(F.count("*").alias("n"))


@query(with_views(TRAILING_SQL, "SELECT series, t, round(instant, 6) AS instant, round(trail, 6) AS trail, trailing_hours::BIGINT AS trailing_hours, round(effective, 6) AS effective, band_e FROM tr"))
def trailing_index(spark, d):
    return trailing(spark, d).select("series", "t", r6("instant"), r6("trail"), F.col("trailing_hours").cast("long").alias("trailing_hours"), r6("effective"), "band_e")


_EDGES = [(k, (0.0, *map(float, e), None)) for k, e in ix.BREAKPOINTS.items()]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, {e[n]!r}::DOUBLE, {'NULL' if e[n + 1] is None else repr(e[n + 1])}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for k, e in _EDGES for n, (a, b) in enumerate(ix.SEGMENTS)) + ") v(pollutant, segment, conc_low, conc_high, index_low, index_high)")
def breakpoint_rows(spark, d):
    return ix.breakpoint_table(spark)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{b}', {a}, {z}, '{t}')" for k, (b, (a, z), t) in enumerate(zip(ix.BANDS, ix.SEGMENTS, ix.BAND_TEXT))) + ") v(ordinal, band, index_low, index_high, health)")
def band_rows(spark, d):
    return ix.band_table(spark)


def _inverse_sql() -> str:
    edges = (0.0, *map(float, ix.BREAKPOINTS["pm25"]))
    cases = []
    for k, (a, b) in enumerate(ix.SEGMENTS):
        width = (edges[k + 1] - edges[k]) / (b - a) if k < 5 else (edges[5] - edges[4]) / (ix.SEGMENTS[4][1] - ix.SEGMENTS[4][0])
        cases.append(f"WHEN x BETWEEN {a} AND {b} THEN round_even({edges[k]!r}::DOUBLE + (x - {a}) * {width!r}::DOUBLE, 1)")
    return f"SELECT p_partkey, CASE {' '.join(cases)} ELSE 30.0 END::DOUBLE AS pm25 FROM (SELECT p_partkey, greatest(0.0, least(499.0, p_retailprice / 3))::DOUBLE AS x FROM part)"


@query(_inverse_sql())
def inverse_index(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", ix.pm25_for_index(F.col("p_retailprice") / 3).alias("pm25"))


# --- weather and features


@query(
    with_views(
        SLOTS_SQL,
        f"""SELECT series, t, {we.category_sql('weather_code')} AS category, {we.label_sql('weather_code')} AS label,
  round(0.61078 * exp(17.27 * temp_c / (temp_c + 237.3)) * (1 - greatest(least(humidity, 100.0), 0.01) / 100.0), 6) AS vpd,
  round(humidity / 100.0 / greatest(wind_kmh, 1.0), 6) AS stagnation,
  round(CASE WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN least(greatest(pm25 / greatest(pm10, 1.0), 0.0), 1.0) END, 6) AS pm_ratio,
  round(coalesce(effective - instant, 0.0), 6) AS index_gap,
  round(sin(2 * pi() * hour(t) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(t) / 24.0), 6) AS hour_cos,
  round(sin(2 * pi() * month(t) / 12.0), 6) AS month_sin, round(cos(2 * pi() * month(t) / 12.0), 6) AS month_cos,
  CASE WHEN apparent_c >= 35 THEN 1 ELSE 0 END AS heat_flag
FROM slots""",
    )
)
def compact_features(spark, d):
    rows = slots(spark, d)
    hs, hc = we.cyclic(F.hour("t"), 24)
    ms, mc = we.cyclic(F.month("t"), 12)
    return rows.select(
        "series", "t", we.category(F.col("weather_code")).alias("category"), we.label(F.col("weather_code")).alias("label"),
        rounded(we.vapour_deficit(F.col("temp_c"), F.col("humidity")), 6).alias("vpd"),
        rounded(we.stagnation(F.col("humidity"), F.col("wind_kmh")), 6).alias("stagnation"),
        rounded(we.particle_ratio(F.col("pm25"), F.col("pm10")), 6).alias("pm_ratio"),
        rounded(F.coalesce(F.col("effective") - F.col("instant"), F.lit(0.0)), 6).alias("index_gap"),
        rounded(hs, 6).alias("hour_sin"), rounded(hc, 6).alias("hour_cos"), rounded(ms, 6).alias("month_sin"), rounded(mc, 6).alias("month_cos"),
        F.when(F.col("apparent_c") >= 35, 1).otherwise(0).alias("heat_flag"),
    )


_W = "OVER (PARTITION BY series ORDER BY t)"
_LAGS = ", ".join(f"lag(effective, {n}) {_W} AS lag{n}" for n in (1, 3, 6))
LAG_SQL = f"""{SLOTS_SQL},
lg AS (SELECT series, t, effective, {_LAGS}, lag(pm25, 1) {_W} AS pm25_lag1, pm25 - lag(pm25, 3) {_W} AS pm25_diff3, temp_c - lag(temp_c, 3) {_W} AS temp_diff3, wind_kmh - lag(wind_kmh, 1) {_W} AS wind_diff1,
  avg(effective) OVER (PARTITION BY series ORDER BY t ROWS 2 PRECEDING) AS rolling3, avg(effective) OVER (PARTITION BY series ORDER BY t ROWS 5 PRECEDING) AS rolling6 FROM slots)"""
_LAG_OUT = ("lag1", "lag3", "lag6", "diff1", "diff3", "diff6", "rate6", "rolling3", "rolling6", "pm25_lag1", "pm25_diff3", "temp_diff3", "wind_diff1")


@query(with_views(f"{LAG_SQL}, l2 AS (SELECT *, effective - lag1 AS diff1, effective - lag3 AS diff3, effective - lag6 AS diff6, (effective - lag6) / 6.0 AS rate6 FROM lg)", f"SELECT series, t, {', '.join(f'round({c}, 6) AS {c}' for c in _LAG_OUT)} FROM l2"))
def lag_features(spark, d):
    rows = se.with_lags(slots(spark, d))
    rows = rows.withColumns({"pm25_lag1": se.lag("pm25", 1), "pm25_diff3": F.col("pm25") - se.lag("pm25", 3), "temp_diff3": F.col("temp_c") - se.lag("temp_c", 3), "wind_diff1": F.col("wind_kmh") - se.lag("wind_kmh", 1)})
    return rows.select("series", "t", *map(r6, _LAG_OUT))


# --- policies

_SKIPS = "list_filter([CASE WHEN effective IS NULL THEN 'no_air' END, CASE WHEN effective >= 300 THEN 'air' END, CASE WHEN apparent_c >= 35 THEN 'heat' END, CASE WHEN precip_mm >= 2.5 THEN 'rain' END, CASE WHEN precip_prob >= 70 AND precip_mm >= 0.5 THEN 'rain_chance' END, CASE WHEN weather_code IN (95, 96, 99) THEN 'thunder' END], lambda x: x IS NOT NULL)"
_WAITS = "list_filter([CASE WHEN effective >= 200 THEN 'air' END, CASE WHEN apparent_c >= 30 THEN 'heat' END, CASE WHEN precip_prob >= 40 THEN 'rain_chance' END], lambda x: x IS NOT NULL)"
POLICY_SQL = f"""{SLOTS_SQL},
p0 AS (SELECT *, {_SKIPS} AS skips, {_WAITS} AS waits, coalesce(is_day, 0) = 0 AS night FROM slots),
p1 AS (SELECT *, CASE WHEN len(skips) > 0 THEN 2 WHEN len(waits) > 0 OR night THEN 1 ELSE 0 END AS a_rank,
  list_concat(CASE WHEN len(skips) > 0 THEN skips ELSE waits END, CASE WHEN night THEN ['night'] ELSE [] END) AS a_reasons,
  list_filter([CASE WHEN apparent_c IS NULL THEN 'no_heat' END, CASE WHEN precip_mm IS NULL THEN 'no_rain' END], lambda x: x IS NOT NULL) AS unknown FROM p0),
pol AS (SELECT *, CASE WHEN a_rank < 2 AND len(unknown) > 0 THEN 2 ELSE a_rank END AS rank, CASE WHEN a_rank < 2 AND len(unknown) > 0 THEN unknown ELSE a_reasons END AS reasons,
  CASE WHEN effective IS NULL THEN 0.0 ELSE round_even(0.55 * greatest(0.0, least(100.0, 100.0 - effective / 300.0 * 100.0)) + 0.3 * CASE WHEN apparent_c IS NULL THEN 80.0 ELSE greatest(0.0, least(100.0, 100.0 - greatest(0.0, apparent_c - 24.0) * 6.0)) END
    + 0.15 * CASE WHEN precip_mm IS NULL THEN 100.0 ELSE greatest(0.0, 100.0 - precip_mm * 25.0) END + 1e-9, 1) END AS comfort FROM p1)"""

def inputs():
    return [F.col(c) for c in ("effective", "apparent_c", "precip_mm", "precip_prob")]


def decided(spark, d, series=4):
    """Slots with the safe policy's rank and reasons, and comfort."""
    rows = slots(spark, d, series).withColumn("_p", po.safe_policy(*inputs(), thunder(), F.col("is_day")))
    return rows.withColumns({"rank": F.col("_p.rank"), "reasons": F.col("_p.reasons"), "comfort": po.comfort(*inputs()[:3])}).drop("_p")


@query(with_views(POLICY_SQL, "SELECT series, t, ['GO', 'WAIT', 'SKIP'][a_rank + 1] AS decision, array_to_string(a_reasons, ',') AS reasons FROM p1"))
def policy_product(spark, d):
    p = slots(spark, d).select("series", "t", po.product_policy(*inputs(), thunder(), F.col("is_day")).alias("p"))
    return p.select("series", "t", po.decision_name(F.col("p.rank")).alias("decision"), F.array_join("p.reasons", ",").alias("reasons"))


@query(with_views(POLICY_SQL, "SELECT series, t, ['GO', 'WAIT', 'SKIP'][rank + 1] AS decision, array_to_string(reasons, ',') AS reasons, comfort::DOUBLE AS comfort FROM pol"))
def policy_safe(spark, d):
    return decided(spark, d).select("series", "t", po.decision_name(F.col("rank")).alias("decision"), F.array_join("reasons", ",").alias("reasons"), "comfort")


@query(
    with_views(
        POLICY_SQL,
        """SELECT series, t, model_rank, greatest(model_rank, rank) AS final_rank FROM (SELECT *, CASE WHEN band_i >= 4 OR coalesce(precip_mm, 0.0) >= 2.5 OR coalesce(precip_prob, 0.0) >= 70 OR coalesce(apparent_c, 30.0) >= 35 THEN 2
  WHEN band_i = 3 OR coalesce(apparent_c, 30.0) >= 30 OR coalesce(precip_prob, 0.0) >= 40 OR coalesce(is_day, 0) = 0 THEN 1 ELSE 0 END AS model_rank FROM pol WHERE band_i IS NOT NULL)""",
    )
)
def policy_model_override(spark, d):
    rows = decided(spark, d).where("band_i IS NOT NULL").withColumn("model_rank", po.model_policy(F.col("band_i"), *inputs()[1:], F.col("is_day")))
    return rows.select("series", "t", "model_rank", po.stricter(F.col("model_rank"), F.col("rank")).alias("final_rank"))


@query(with_views(POLICY_SQL, "SELECT series, t, rank, comfort::DOUBLE AS comfort, round(effective, 6) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rank, comfort DESC, t) AS k FROM pol) WHERE k = 1"))
def best_hour(spark, d):
    """The best hour of each series: decision first, then comfort, then time. One aggregate with map-side combine, no sort."""
    best = F.min(F.struct("rank", (-F.col("comfort")).alias("c"), "t", "effective"))
    b = decided(spark, d).groupBy("series").agg(best.alias("b"))
    return b.select("series", "b.t", "b.rank", (-F.col("b.c")).alias("comfort"), rounded(F.col("b.effective"), 6).alias("effective"))


@query(
    with_views(
        POLICY_SQL,
        """SELECT o.series, o.t, o.rank, (o.n - b.n)::BIGINT AS from_best FROM (SELECT series, t, rank, row_number() OVER (PARTITION BY series ORDER BY t) AS n FROM pol) o
JOIN (SELECT series, n FROM (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS n, row_number() OVER (PARTITION BY series ORDER BY rank, comfort DESC, t) AS k FROM pol) WHERE k = 1) b USING (series)
WHERE o.n - b.n BETWEEN -1 AND 6""",
    )
)
def display_window(spark, d):
    """Hours around the best one: one before, six after."""
    rows = decided(spark, d).withColumn("n", F.row_number().over(se.by_time()))
    best = rows.groupBy("series").agg(F.min(F.struct("rank", (-F.col("comfort")).alias("c"), "t", "n")).alias("b")).select("series", F.col("b.n").alias("best"))
    return rows.join(best, "series").where((F.col("n") - F.col("best")).between(-1, 6)).select("series", "t", "rank", (F.col("n") - F.col("best")).cast("long").alias("from_best"))


@query(with_views(POLICY_SQL, "SELECT series, min(CASE WHEN rank = 0 THEN t END) AS next_go, count(CASE WHEN rank = 0 THEN 1 END)::BIGINT AS n_go, count(*)::BIGINT AS n FROM pol GROUP BY series"))
def next_go(spark, d):
    return decided(spark, d).groupBy("series").agg(F.min(F.when(F.col("rank") == 0, F.col("t"))).alias("next_go"), F.count_if(F.col("rank") == 0).alias("n_go"), F.count("*").alias("n"))


@query(with_views(POLICY_SQL, "SELECT series, t, CASE WHEN effective >= 200 THEN 'air' WHEN apparent_c >= 33 THEN 'heat' WHEN precip_prob >= 30 THEN 'rain' WHEN hour(t) BETWEEN 4 AND 10 THEN 'morning' ELSE 'evening' END AS cue FROM pol"))
def cue_choice(spark, d):
    cue = F.when(F.col("effective") >= 200, "air").when(F.col("apparent_c") >= 33, "heat").when(F.col("precip_prob") >= 30, "rain").when(F.hour("t").between(4, 10), "morning").otherwise("evening")
    return decided(spark, d).select("series", "t", cue.alias("cue"))


@query(
    with_views(
        POLICY_SQL,
        """SELECT series, t, CASE WHEN rank = 0 THEN 'GO' WHEN rank = 1 THEN 'WAIT' ELSE 'SKIP' END || ' ' || strftime(t, '%H:%M') || CASE WHEN len(reasons) = 0 THEN '' ELSE ' · ' || array_to_string(reasons, ' · ') END AS headline FROM pol""",
    )
)
def headlines(spark, d):
    text = F.concat(po.decision_name(F.col("rank")), F.lit(" "), F.date_format("t", "HH:mm"), F.when(F.size("reasons") == 0, "").otherwise(F.concat(F.lit(" · "), F.array_join("reasons", " · "))))
    return decided(spark, d).select("series", "t", text.alias("headline"))


@query(
    with_views(
        POLICY_SQL,
        """SELECT series, t, CASE WHEN age < INTERVAL 0 MINUTES OR age > INTERVAL 15 MINUTES THEN 'expired' WHEN NOT (t <= now AND now < t + INTERVAL 1 HOUR) THEN 'no_current_hour' WHEN rank <> 0 THEN 'not_now' ELSE 'ok' END AS verdict
FROM (SELECT *, t + to_minutes(CAST(5 + series * 20 AS BIGINT)) AS now, to_minutes(CAST(minute(made) AS BIGINT)) AS age FROM (SELECT *, t + to_minutes(CAST(extract(hour FROM t) * 2 AS BIGINT)) AS made FROM pol))""",
    )
)
def walk_eligibility(spark, d):
    """An ordered chain of checks: age of the assessment, the hour that contains now, the decision."""
    rows = decided(spark, d).withColumn("_age", F.minute(F.col("t") + F.make_dt_interval(mins=(F.hour("t") * 2))))
    now = F.col("t") + F.make_dt_interval(mins=(5 + F.col("series") * 20))
    inside = (F.col("t") <= now) & (now < F.col("t") + F.make_dt_interval(hours=F.lit(1)))
    verdict = F.when((F.col("_age") < 0) | (F.col("_age") > 15), "expired").when(~inside, "no_current_hour").when(F.col("rank") != 0, "not_now").otherwise("ok")
    return rows.select("series", "t", verdict.alias("verdict"))


# --- joins


@query(with_views(SLOTS_SQL, "SELECT series, t, round(instant, 6) AS instant, temp_c, precip_mm, is_day FROM slots"), also="join_left_weather_all")
def join_left_weather(spark, d):
    return slots(spark, d).select("series", "t", r6("instant"), "temp_c", "precip_mm", "is_day")


@query(with_views(SLOTS_SQL, "SELECT a.series, a.t, w.temp_c, w.apparent_c FROM air a JOIN wx w USING (series, t) WHERE w.temp_c IS NOT NULL AND w.apparent_c IS NOT NULL AND w.precip_mm IS NOT NULL AND w.humidity IS NOT NULL AND w.wind_kmh IS NOT NULL"))
def join_inner_complete(spark, d):
    both = ad.air(spark, d).join(ad.weather(spark, d), ["series", "t"]).dropna(subset=["temp_c", "apparent_c", "precip_mm", "humidity", "wind_kmh"])
    return both.select("series", "t", "temp_c", "apparent_c")


@query(with_views(SLOTS_SQL, "SELECT series, t FROM air a WHERE NOT EXISTS (SELECT 1 FROM wx WHERE wx.series = a.series AND wx.t = a.t)"))
def join_anti_unpaired(spark, d):
    return ad.air(spark, d).join(ad.weather(spark, d), ["series", "t"], "left_anti").select("series", "t")


@query(with_views(SLOTS_SQL, "SELECT series, t FROM air a WHERE EXISTS (SELECT 1 FROM air b WHERE b.series = a.series AND b.t = a.t + INTERVAL 6 HOURS)"))
def join_semi_future(spark, d):
    a = ad.air(spark, d)
    return a.join(a.select("series", (F.col("t") - F.make_dt_interval(hours=F.lit(6))).alias("t")), ["series", "t"], "left_semi").select("series", "t")


@query(with_views(INDEX_SQL, "SELECT a.series, a.t, round(a.instant, 6) AS instant, round(b.instant, 6) AS target, b.band_i AS target_band FROM idx a JOIN idx b ON b.series = a.series AND b.t = a.t + INTERVAL 6 HOURS"))
def join_exact_six_hours(spark, d):
    a = indexed(spark, d)
    b = a.select("series", (F.col("t") - F.make_dt_interval(hours=F.lit(6))).alias("t"), F.col("instant").alias("target"), F.col("band_i").alias("target_band"))
    return a.join(b, ["series", "t"]).select("series", "t", r6("instant"), r6("target"), "target_band")


@query(with_views(INDEX_SQL, "SELECT a.series, a.t, round(a.instant, 6) AS now, " + ", ".join(f"round(b{n}.instant, 6) AS lag{n}, round(a.instant - b{n}.instant, 6) AS diff{n}" for n in (1, 3, 6)) + " FROM idx a " + " ".join(f"LEFT JOIN idx b{n} ON b{n}.series = a.series AND b{n}.t = a.t - INTERVAL {n} HOURS" for n in (1, 3, 6))))
def exact_time_lags(spark, d):
    """Values exactly 1, 3 and 6 hours before: RANGE frames of one hour's width over one sort, where joins would need three."""
    at = lambda n: F.max("instant").over(se.hours_frame(n, -n))
    rows = indexed(spark, d).withColumns({f"lag{n}": at(n) for n in (1, 3, 6)})
    return rows.select("series", "t", rounded(F.col("instant"), 6).alias("now"), *[r6(f"lag{n}") for n in (1, 3, 6)], *[rounded(F.col("instant") - F.col(f"lag{n}"), 6).alias(f"diff{n}") for n in (1, 3, 6)])


@query(with_views(INDEX_SQL, "SELECT p.phase, count(*)::BIGINT AS n, count(CASE WHEN band_i >= 3 THEN 1 END)::BIGINT AS positives FROM idx JOIN (VALUES ('early', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11'), ('middle', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21'), ('late', TIMESTAMP '2024-01-21', TIMESTAMP '2024-03-01')) p(phase, a, b) ON t >= a AND t + INTERVAL 6 HOURS < b GROUP BY p.phase"))
def range_join_phases(spark, d):
    """Rows in half-open phases with a gap before each boundary; the phases are a constant of three rows."""
    phases = spark.sql("SELECT * FROM VALUES ('early', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-11'), ('middle', TIMESTAMP_NTZ '2024-01-11', TIMESTAMP_NTZ '2024-01-21'), ('late', TIMESTAMP_NTZ '2024-01-21', TIMESTAMP_NTZ '2024-03-01') AS p(phase, a, b)")
    rows = indexed(spark, d)
    inside = (rows["t"] >= phases["a"]) & (rows["t"] + F.make_dt_interval(hours=F.lit(6)) < phases["b"])
    return rows.join(F.broadcast(phases), inside).groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("band_i") >= 3).alias("positives"))


@query(
    with_views(
        LABELLED_SQL,
        """SELECT series, t, round(effective, 2) AS naqi, band_e, label, round(target, 2) AS target, """ + po.label_policy_sql("label", "apparent_c", "precip_mm", "precip_prob") + """ AS decision
FROM lab WHERE temp_c IS NOT NULL AND apparent_c IS NOT NULL AND precip_mm IS NOT NULL AND humidity IS NOT NULL AND wind_kmh IS NOT NULL""",
    )
)
def labelled_dataset(spark, d):
    rows = labelled(spark, d).dropna(subset=["temp_c", "apparent_c", "precip_mm", "humidity", "wind_kmh"])
    return rows.select("series", "t", rounded(F.col("effective"), 2).alias("naqi"), "band_e", "label", rounded(F.col("target"), 2).alias("target"), po.label_policy(F.col("label"), *inputs()[1:]).alias("decision"))
