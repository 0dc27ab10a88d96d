"""Queries that compare forecasts and prepare trials: tests, gates, windows, partitions, picks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy as po
from ..operators import metrics as me
from ..operators import series as se
from ..sources import adapters as ad
from . import hourly as h
from .evaluation import EPI, PRF, episodes
from .hourly import query, rounded
from .sql import INDEX_SQL, LABELLED_SQL, SLOTS_SQL, TRAILING_SQL, with_views

#: Weights of the six classes, of the six horizons, and widths of the coarse fingerprint.
CLASS_WEIGHTS = (1, 1, 1, 4, 16, 16)
HORIZON_WEIGHTS = (1 / 12, 1 / 12, 1 / 12, 1 / 12, 1 / 12, 7 / 12)
WIDTHS = {"effective": 5, "apparent_c": 2, "precip_mm": 0.5, "precip_prob": 10}
REPLICATES, BOOTSTRAP_SEED = 4000, 12345


# --- scores


@query(with_views(f"{PRF}, pd AS (SELECT pred AS class, sum(n) AS p FROM cm GROUP BY pred)", "SELECT round(avg(CASE WHEN support > 0 THEN f1 END), 4) AS truth_only, round(avg(CASE WHEN support > 0 OR p > 0 THEN f1 END), 4) AS truth_or_pred, round(avg(f1), 4) AS all_classes FROM f1 LEFT JOIN pd USING (class)"))
def macro_f1_variants(spark, d):
    """Macro F1 over the classes of the truth, of truth or forecast, and over all."""
    cells = me.confusion(h.labelled(spark, d))
    said = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("p"))
    rows = me.per_class(cells).join(said, "class", "left")
    return rows.agg(rounded(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 4).alias("truth_only"), rounded(F.avg(F.when((F.col("support") > 0) | (F.col("p") > 0), F.col("f1"))), 4).alias("truth_or_pred"), rounded(F.avg("f1"), 4).alias("all_classes"))


@query(with_views(LABELLED_SQL, "SELECT part, round(avg(acc), 4) AS mean, round(stddev_samp(acc), 4) AS sd, count(*)::BIGINT AS n FROM (SELECT series, CASE WHEN series = 0 THEN 'one' ELSE 'rest' END AS part, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM pre GROUP BY series) GROUP BY part"))
def seed_spread(spark, d):
    """Mean and sample deviation of runs; a single run has no deviation."""
    runs = h.labelled(spark, d).groupBy("series").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("acc"))
    return runs.groupBy(F.when(F.col("series") == 0, "one").otherwise("rest").alias("part")).agg(rounded(F.avg("acc"), 4).alias("mean"), rounded(F.stddev_samp("acc"), 4).alias("sd"), F.count("*").alias("n"))


def right(model: str):
    return F.col("label") == F.col(model)


def mcnemar_p(a, b):
    """Exact two-sided p of the discordant counts a and b: twice the lower binomial tail, 1 at most."""
    n, k = a + b, F.least(a, b)
    step = lambda s, i: F.struct((s["log"] + F.ln((n - i + 1) / i)).alias("log"), (s["sum"] + F.exp(s["log"] + F.ln((n - i + 1) / i))).alias("sum"))
    start = F.struct((-n * float(np.log(2))).alias("log"), F.exp(-n * float(np.log(2))).alias("sum"))
    places = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(places, start, step)["sum"])


_DISCORDANT = f"{LABELLED_SQL}, dc AS (SELECT count(CASE WHEN a AND NOT b THEN 1 END)::BIGINT AS only_a, count(CASE WHEN b AND NOT a THEN 1 END)::BIGINT AS only_b FROM (SELECT label = pred AS a, label = band_e AS b FROM pre))"


@query(with_views(_DISCORDANT, "SELECT only_a, only_b, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2::DOUBLE))) FROM unnest(range(0, least(only_a, only_b) + 1)) t(i))), 6) AS p_value FROM dc"))
def mcnemar(spark, d):
    """Exact two-sided test on the discordant counts, one row that stays on Spark."""
    a, b = right("pred"), right("band_e")
    one = h.labelled(spark, d).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))
    return one.select("only_a", "only_b", rounded(mcnemar_p(F.col("only_a"), F.col("only_b"))).alias("p_value"))


@query()
def paired_bootstrap(spark, d):
    """The interval of an accuracy difference over resampled rows.

    A row's difference is -1, 0 or 1, so resampling all rows is one draw of three counts; replicates are spread over tasks.
    """
    diff = right("band_e").cast("int") - right("pred").cast("int")
    counts = h.labelled(spark, d).agg(*[F.count_if(diff == v).alias(c) for v, c in ((-1, "worse"), (0, "same"), (1, "better"))])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, *n in f[["id", "worse", "same", "better"]].itertuples(index=False):
                total = max(sum(n), 1)
                got = np.random.Generator(np.random.PCG64([BOOTSTRAP_SEED, int(k)])).multinomial(sum(n), [x / total for x in n] if sum(n) else [0, 1, 0])
                out.append((got[2] - got[0]) / total)
            yield pd.DataFrame({"difference": out})

    drawn = spark.range(REPLICATES, numPartitions=8).join(F.broadcast(counts), F.lit(True)).mapInPandas(draw, "difference double")  # one row of counts
    return drawn.agg(F.count("*").alias("replicates"), F.avg("difference").alias("mean"), F.percentile("difference", 0.025).alias("low"), F.percentile("difference", 0.975).alias("high"))


@query(with_views(LABELLED_SQL, "SELECT part, n, round(acc, 6) AS accuracy, round(sqrt(acc * (1 - acc) / n), 6) AS se FROM (SELECT part, count(*)::BIGINT AS n, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM (SELECT *, 'all' AS part FROM pre UNION ALL SELECT *, 'moderate' FROM pre WHERE label = 2) GROUP BY part)"))
def accuracy_error(spark, d):
    """Observed accuracy and its binomial standard error, of all rows and of one class."""
    rows = h.labelled(spark, d).select("label", "pred")
    both = rows.withColumn("part", F.explode(F.when(F.col("label") == 2, F.array(F.lit("all"), F.lit("moderate"))).otherwise(F.array(F.lit("all")))))
    g = both.groupBy("part").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("a"))
    return g.select("part", "n", rounded(F.col("a")).alias("accuracy"), rounded(F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n"))).alias("se"))


@query(with_views(INDEX_SQL, "SELECT *, max(mean) OVER () - min(mean) OVER () > 5 AND max(distinct_values) OVER () = 1 AS suspect FROM (SELECT series, count(DISTINCT band_i)::BIGINT AS distinct_values, round(avg(instant), 6) AS mean FROM idx GROUP BY series)"))
def score_health(spark, d):
    """Scores that are constant within each group and far apart between groups are suspect."""
    g = h.indexed(spark, d).groupBy("series").agg(F.count_distinct("band_i").alias("distinct_values"), rounded(F.avg("instant")).alias("mean"))
    whole = g.agg((F.max("mean") - F.min("mean") > 5).alias("apart"), (F.max("distinct_values") == 1).alias("constant"))
    return g.join(F.broadcast(whole), F.lit(True)).select("series", "distinct_values", "mean", (F.col("apart") & F.col("constant")).alias("suspect"))  # one row


@query(with_views(INDEX_SQL, "SELECT series, " + ", ".join(f"count(CASE WHEN {k} IS NULL THEN 1 END)::BIGINT AS no_{k}" for k in se.GAS_COLUMNS) + ", count(CASE WHEN instant IS NULL THEN 1 END)::BIGINT AS no_index, count(*)::BIGINT AS n FROM idx GROUP BY series"))
def exclusion_counts(spark, d):
    rows = h.indexed(spark, d).groupBy("series")
    return rows.agg(*[F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in se.GAS_COLUMNS], F.count_if(F.col("instant").isNull()).alias("no_index"), F.count("*").alias("n"))


@query(with_views(f"{LABELLED_SQL}, sc AS (SELECT series, prob, count(*) AS n, count(CASE WHEN label >= 3 THEN 1 END) AS k FROM pre GROUP BY ALL), cu AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck, sum(k) OVER (PARTITION BY series) AS total FROM sc WINDOW w AS (PARTITION BY series ORDER BY prob DESC))", "SELECT series, round(sum(k::DOUBLE / total * ck::DOUBLE / cn), 6) AS average_precision FROM cu WHERE total > 0 GROUP BY series"))
def average_precision(spark, d):
    """Precision at each score, weighted by the recall that it adds; equal scores count together."""
    scores = h.labelled(spark, d).groupBy("series", "prob").agg(F.count("*").alias("n"), F.count_if(F.col("label") >= 3).alias("k"))
    upto = W.partitionBy("series").orderBy(F.desc("prob")).rowsBetween(W.unboundedPreceding, 0)
    rows = scores.withColumns({"cn": F.sum("n").over(upto), "ck": F.sum("k").over(upto), "total": F.sum("k").over(W.partitionBy("series"))}).where("total > 0")
    return rows.groupBy("series").agg(rounded(F.sum(F.col("k") / F.col("total") * F.col("ck") / F.col("cn"))).alias("average_precision"))


# --- small columns


@query(with_views(INDEX_SQL, "SELECT series, t, concat_ws(',', " + ", ".join(f"CASE WHEN s_{k} IS NOT NULL THEN '{k}=' || CAST(floor(s_{k}) AS BIGINT) END" for k in sorted(se.GAS_COLUMNS)) + ") AS parts FROM idx"))
def index_map(spark, d):
    """The sub-indices that exist, as a map."""
    m = F.map_filter(F.create_map(*[x for k in sorted(se.GAS_COLUMNS) for x in (F.lit(k), F.floor(f"s_{k}").cast("long"))]), lambda k, v: v.isNotNull())
    return h.indexed(spark, d).select("series", "t", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("parts"))


@query(with_views(INDEX_SQL, "SELECT series, t, round(greatest(s_pm25, s_pm10), 6) AS pm_index FROM idx"))
def pm_only_index(spark, d):
    return h.indexed(spark, d).select("series", "t", rounded(F.greatest("s_pm25", "s_pm10")).alias("pm_index"))


@query(with_views(TRAILING_SQL, "SELECT series, t, basis, len(basis) - len(replace(basis, '+', '')) + CASE WHEN basis = '' THEN 0 ELSE 1 END AS parts, CASE WHEN basis = '' THEN NULL ELSE string_split(basis, '+')[1] END AS first_part FROM (SELECT series, t, concat_ws('+', CASE WHEN instant IS NOT NULL THEN 'instant' END, CASE WHEN trail IS NOT NULL THEN 'trailing' END) AS basis FROM tr)"))
def basis_parts(spark, d):
    """What an index rests on, joined by + and split again."""
    basis = F.concat_ws("+", F.when(F.col("instant").isNotNull(), "instant"), F.when(F.col("trail").isNotNull(), "trailing"))
    parts = F.filter(F.split("basis", r"\+"), lambda x: x != "")
    return h.trailing(spark, d).select("series", "t", basis.alias("basis")).select("series", "t", "basis", F.size(parts).cast("long").alias("parts"), F.get(parts, 0).alias("first_part"))


def near_key(decision, is_day, code, measures):
    """What makes two hours nearly the same: decision, day, weather code, and four measures in steps of WIDTHS, halves to even; `na` where there is none."""
    step = lambda c, w: F.coalesce(F.bround(measures[c] / float(w), 0).cast("long").cast("string"), F.lit("na"))
    plain = [F.coalesce(c.cast("string"), F.lit("na")) for c in (decision, is_day, code)]
    return F.concat_ws(":", *plain, *[step(c, w) for c, w in WIDTHS.items()])


_STEPS = " || ':' || ".join(f"coalesce(CAST(CAST(round_even({c} / {float(w)!r}::DOUBLE, 0) AS BIGINT) AS VARCHAR), 'na')" for c, w in WIDTHS.items())


@query(with_views(h.POLICY_SQL, f"SELECT series, t, ['GO', 'WAIT', 'SKIP'][rank + 1] || ':' || coalesce(CAST(is_day AS VARCHAR), 'na') || ':' || coalesce(CAST(weather_code AS VARCHAR), 'na') || ':' || {_STEPS} AS fingerprint FROM pol"))
def near_fingerprint(spark, d):
    rows = h.decided(spark, d)
    return rows.select("series", "t", near_key(po.decision_name(F.col("rank")), F.col("is_day"), F.col("weather_code"), {c: F.col(c) for c in WIDTHS}).alias("fingerprint"))


def quantile_floor(pred, quantile):
    """A forecast is raised to 3 where the quantile, halves to even, is above 200."""
    return F.when(F.bround(quantile, 0) > 200, F.greatest(pred, F.lit(3))).otherwise(pred)


@query(with_views(LABELLED_SQL, "SELECT series, t, greatest(pred, CASE WHEN round_even(instant * 1.5::DOUBLE, 0) > 200 THEN 3 ELSE 0 END)::INTEGER AS floored FROM pre"))
def quantile_floored(spark, d):
    return h.labelled(spark, d).select("series", "t", quantile_floor(F.col("pred"), F.col("instant") * 1.5).cast("int").alias("floored"))


@query(with_views(LABELLED_SQL, f"SELECT label, n, ({list(CLASS_WEIGHTS)})[label + 1]::BIGINT AS fixed, CASE WHEN label >= 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS severe, round(total::DOUBLE / (k * n), 6) AS balanced, round(sqrt(total::DOUBLE / (k * n)), 6) AS damped FROM (SELECT label, n, sum(n) OVER () AS total, count(*) OVER () AS k FROM (SELECT label, count(*)::BIGINT AS n FROM pre GROUP BY label))"))
def class_weights(spark, d):
    """Weights of a class: fixed, doubled from severe on, balanced, and balanced under a root."""
    g = h.labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    whole = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    balanced = F.col("total") / (F.col("k") * F.col("n"))
    fixed = F.get(F.array(*map(F.lit, CLASS_WEIGHTS)), F.col("label")).cast("long")
    return g.join(F.broadcast(whole), F.lit(True)).select("label", "n", fixed.alias("fixed"), F.when(F.col("label") >= 3, 2.0).otherwise(1.0).alias("severe"), rounded(balanced).alias("balanced"), rounded(F.sqrt(balanced)).alias("damped"))  # one row


@query(with_views(LABELLED_SQL, "SELECT series, t, round(target - instant, 6) AS residual, round(instant + (target - instant), 6) AS decoded FROM pre"))
def residuals(spark, d):
    """Targets as their difference from the hour's own value, and back."""
    residual = F.col("target") - F.col("instant")
    return h.labelled(spark, d).select("series", "t", rounded(residual).alias("residual"), rounded(F.col("instant") + residual).alias("decoded"))


@query(with_views(f"{INDEX_SQL}, hz AS (SELECT series, t, instant, " + ", ".join(f"lead(instant, {n}) OVER (PARTITION BY series ORDER BY t) AS h{n}" for n in range(1, 7)) + " FROM idx)", "SELECT series, t, round(" + " + ".join(f"abs(h{n} - instant) * {1 if n < 6 else 7}.0::DOUBLE / 12.0::DOUBLE" for n in range(1, 7)) + ", 6) AS loss FROM hz"))
def horizon_loss(spark, d):
    """Persistence's error over six horizons, the last one weighing most."""
    errors = F.array(*[F.abs(F.lead("instant", n).over(se.by_time()) - F.col("instant")) for n in range(1, 7)])
    weighed = F.zip_with("e", F.array(*map(F.lit, HORIZON_WEIGHTS)), lambda e, w: e * w)
    return h.indexed(spark, d).select("series", "t", errors.alias("e")).select("series", "t", rounded(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x)).alias("loss"))


# --- pairs and gates


@query(with_views(SLOTS_SQL, "SELECT series, count(a)::BIGINT AS n, count(b)::BIGINT AS other, count(CASE WHEN a AND b THEN 1 END)::BIGINT AS joined, count(*)::BIGINT AS keys, count(CASE WHEN a AND b THEN 1 END) = count(*) AS sound FROM (SELECT coalesce(x.series, y.series) AS series, coalesce(x.t, y.t) AS t, CASE WHEN x.t IS NOT NULL THEN true END AS a, CASE WHEN y.t IS NOT NULL THEN true END AS b FROM air x FULL JOIN wx y ON x.series = y.series AND x.t = y.t) GROUP BY series"))
def paired_period(spark, d):
    """Two feeds of one period zipped by key: every key once on both sides, or the period is not sound. The weather has no hour 11."""
    return paired(ad.air(spark, d), ad.weather(spark, d)).select("series", "n", "other", "joined", "keys", "sound")


def paired(a, b):
    """(series, n, other, joined, keys, sound) of two frames of (series, t)."""
    sides = [x.groupBy("series", "t").agg(F.count("*").alias(n)) for x, n in ((a, "_a"), (b, "_b"))]
    both = sides[0].join(sides[1], ["series", "t"], "full")
    once = F.coalesce((F.col("_a") == 1) & (F.col("_b") == 1), F.lit(False))
    sums = both.groupBy("series").agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("other"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("joined"), F.count("*").alias("keys"), F.bool_and(once).alias("sound"))
    return sums


@query(with_views(f"{EPI}, md AS (SELECT series, t, lag(band_i, 6) OVER (PARTITION BY series ORDER BY t) >= 3 AS one, lag(band_i, 3) OVER (PARTITION BY series ORDER BY t) >= 3 AS two FROM idx)", "SELECT series, count(*)::BIGINT AS missed, coalesce(sum(nb), 0)::BIGINT AS new_hits, count(CASE WHEN nb > 0 THEN 1 END)::BIGINT AS rescued FROM (SELECT series, episode, count(CASE WHEN one THEN 1 END) AS na, count(CASE WHEN two THEN 1 END) AS nb FROM e1 JOIN md USING (series, t) GROUP BY ALL) WHERE na = 0 GROUP BY series"))
def new_hits(spark, d):
    """Hours that a second forecast hits within episodes that the first one misses wholly."""
    said = lambda n: F.coalesce(F.lag("band_i", n).over(se.by_time()) >= 3, F.lit(False))
    both = h.indexed(spark, d).select("series", "t", said(6).alias("a"), said(3).alias("b"))
    e = episodes(spark, d).select("series", "t", "episode").join(both, ["series", "t"]).groupBy("series", "episode").agg(F.count_if("a").alias("na"), F.count_if("b").alias("nb"))
    return e.where("na = 0").groupBy("series").agg(F.count("*").alias("missed"), F.sum("nb").alias("new_hits"), F.count_if(F.col("nb") > 0).alias("rescued"))


# Fixed values of the gates: bands of poor and very poor air, and how far a candidate may fall behind.
POOR, VERY_POOR = 3, 4
GATES = {"accuracy": 0.01, "poor": (0.05, 0.01), "very_poor": (0.01, 0.0025), "gain": 0.05, "new_hits": 2}
EPS = 1e-12


def gate_counts(rows, level, name):
    """Per series, for labels of `level` or more: positives, negatives, hits and false alarms of reference (pred) and candidate (band_e), and episodes that each hits."""
    yes, ref, cand = F.col("label") >= level, F.col("pred") >= level, F.col("band_e") >= level
    flat = rows.groupBy("series").agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"), *[F.count_if(yes & m).alias(f"hit_{k}") for k, m in (("r", ref), ("c", cand))], *[F.count_if(~yes & m).alias(f"far_{k}") for k, m in (("r", ref), ("c", cand))])
    e = se.with_episodes(rows, yes).groupBy("series", "episode").agg(F.count_if(ref).alias("r"), F.count_if(cand).alias("c"))
    missed = F.when(F.col("r") == 0, F.col("c"))
    epi = e.groupBy("series").agg(F.count_if(F.col("r") > 0).alias("any_r"), F.count_if(F.col("c") > 0).alias("any_c"), F.max(missed).alias("new"))
    both = flat.join(epi, "series", "left").na.fill(0, ["any_r", "any_c", "new"])
    return both.select("series", *[F.col(c).alias(f"{name}_{c}") for c in both.columns if c != "series"])


def gates(rows):
    """Per series: the six checks, the change of recall, and new hits in one very poor episode that the reference missed altogether."""
    acc = rows.groupBy("series").agg(*[F.avg((F.col("label") == F.col(m)).cast("double")).alias(f"acc_{m}") for m in ("pred", "band_e")])
    g = acc.join(gate_counts(rows, POOR, "poor"), "series").join(gate_counts(rows, VERY_POOR, "very"), "series")

    def alarms(k, cap, more):
        far = lambda m: F.col(f"{k}_far_{m}") / F.nullif(F.col(f"{k}_neg"), F.lit(0))
        return F.coalesce(far("c") <= F.least(F.lit(cap), far("r") + more) + EPS, F.lit(False))

    checks = {
        "accuracy_holds": F.col("acc_band_e") >= F.col("acc_pred") - GATES["accuracy"] - EPS,
        "poor_alarms_hold": alarms("poor", *GATES["poor"]),
        "very_poor_alarms_hold": alarms("very", *GATES["very_poor"]),
        "misses_hold": F.col("very_pos") - F.col("very_hit_c") <= F.col("very_pos") - F.col("very_hit_r"),
        "poor_episodes_hold": F.col("poor_any_c") >= F.col("poor_any_r"),
        "very_poor_episodes_hold": F.col("very_any_c") >= F.col("very_any_r"),
    }
    change = (F.col("poor_hit_c") - F.col("poor_hit_r")) / F.nullif(F.col("poor_pos"), F.lit(0))
    return g.select("series", *[x.alias(n) for n, x in checks.items()], change.alias("recall_change"), F.col("very_new").alias("new_hits"))


def verdict(periods):
    """One row: guardrails (all checks of all periods), and a gain by recall or by new hits where no period loses recall."""
    names = [c for c in periods.columns if c.endswith(("_holds", "_hold"))]
    v = periods.agg(F.bool_and(F.forall(F.array(*names), lambda x: x)).alias("guardrails"), F.bool_and(F.coalesce(F.col("recall_change") >= -EPS, F.lit(False))).alias("_no_loss"), F.bool_or(F.coalesce(F.col("recall_change") >= GATES["gain"] - EPS, F.lit(False))).alias("_gain"), F.bool_or(F.col("new_hits") >= GATES["new_hits"]).alias("_hits"))
    v = v.select("guardrails", (F.col("_no_loss") & F.col("_gain")).alias("recall_gain"), (F.col("_no_loss") & F.col("_hits")).alias("episode_gain"))
    return v.withColumn("passes", F.col("guardrails") & (F.col("recall_gain") | F.col("episode_gain")))


def _gate_sql(level, k):
    return f"""{k}f AS (SELECT series, count(CASE WHEN label >= {level} THEN 1 END) AS pos, count(CASE WHEN label < {level} THEN 1 END) AS neg, {', '.join(f"count(CASE WHEN label >= {level} AND {m} >= {level} THEN 1 END) AS hit_{s}, count(CASE WHEN label < {level} AND {m} >= {level} THEN 1 END) AS far_{s}" for s, m in (('r', 'pred'), ('c', 'band_e')))} FROM pre GROUP BY series),
{k}0 AS (SELECT series, t, pred, band_e, CASE WHEN t - lag(t) OVER (PARTITION BY series ORDER BY t) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM pre WHERE label >= {level}),
{k}1 AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS ep FROM {k}0),
{k}2 AS (SELECT series, ep, count(CASE WHEN pred >= {level} THEN 1 END) AS r, count(CASE WHEN band_e >= {level} THEN 1 END) AS c FROM {k}1 GROUP BY ALL),
{k} AS (SELECT f.*, coalesce(any_r, 0) AS any_r, coalesce(any_c, 0) AS any_c, coalesce(new, 0) AS new FROM {k}f f LEFT JOIN (SELECT series, count(CASE WHEN r > 0 THEN 1 END) AS any_r, count(CASE WHEN c > 0 THEN 1 END) AS any_c, max(CASE WHEN r = 0 THEN c END) AS new FROM {k}2 GROUP BY series) e USING (series))"""


def _alarm_sql(k, cap, more):
    return f"coalesce({k}.far_c::DOUBLE / nullif({k}.neg, 0) <= least({cap}::DOUBLE, {k}.far_r::DOUBLE / nullif({k}.neg, 0) + {more}::DOUBLE) + 1e-12, false)"


GATES_SQL = f"""{LABELLED_SQL}, {_gate_sql(3, 'p')}, {_gate_sql(4, 'v')},
ac AS (SELECT series, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r, avg(CASE WHEN label = band_e THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM pre GROUP BY series),
gt AS (SELECT ac.series, ac.c >= ac.r - 0.01 - 1e-12 AS accuracy_holds, {_alarm_sql('p', 0.05, 0.01)} AS poor_alarms_hold, {_alarm_sql('v', 0.01, 0.0025)} AS very_poor_alarms_hold,
  v.hit_c >= v.hit_r AS misses_hold, p.any_c >= p.any_r AS poor_episodes_hold, v.any_c >= v.any_r AS very_poor_episodes_hold, (p.hit_c - p.hit_r)::DOUBLE / nullif(p.pos, 0) AS recall_change, v.new AS new_hits
  FROM ac JOIN p ON p.series = ac.series JOIN v ON v.series = ac.series)"""


@query(with_views(GATES_SQL, "SELECT series, accuracy_holds, poor_alarms_hold, very_poor_alarms_hold, misses_hold, poor_episodes_hold, very_poor_episodes_hold, round(recall_change, 6) AS recall_change, new_hits::BIGINT AS new_hits FROM gt"))
def utility_gates(spark, d):
    """The paired checks of a second forecast (the band of the effective index) against persistence, per period."""
    return gates(h.labelled(spark, d)).withColumn("recall_change", rounded(F.col("recall_change")))


@query(with_views(GATES_SQL, """SELECT *, guardrails AND (recall_gain OR episode_gain) AS passes FROM (SELECT bool_and(accuracy_holds AND poor_alarms_hold AND very_poor_alarms_hold AND misses_hold AND poor_episodes_hold AND very_poor_episodes_hold) AS guardrails,
bool_and(coalesce(recall_change >= -1e-12, false)) AND bool_or(coalesce(recall_change >= 0.05 - 1e-12, false)) AS recall_gain, bool_and(coalesce(recall_change >= -1e-12, false)) AND bool_or(new_hits >= 2) AS episode_gain FROM gt)"""))
def utility_verdict(spark, d):
    return verdict(gates(h.labelled(spark, d)))


@query(with_views(ad.JOURNAL_SQL, "SELECT outcome, species, n, round(rate, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY rate DESC, species) AS k FROM (SELECT outcome, species, count(*)::BIGINT AS n, avg(CASE WHEN reached = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM journal GROUP BY ALL) WHERE n >= 10) WHERE k = 1"))
def candidate_choice(spark, d):
    """The candidate of the highest rate, then of the first name, among those with enough rows."""
    g = ad.journal(spark, d).groupBy("outcome", "species").agg(F.count("*").alias("n"), F.avg((F.col("reached") == 1).cast("double")).alias("rate")).where("n >= 10")
    best = g.groupBy("outcome").agg(F.min(F.struct((-F.col("rate")).alias("r"), "species", "n")).alias("b"))
    return best.select("outcome", "b.species", "b.n", rounded(-F.col("b.r")).alias("rate"))


@query(with_views(LABELLED_SQL, "SELECT 'table' AS place, count(*)::BIGINT AS numbers, count(*)::BIGINT AS agree FROM (SELECT series FROM pre GROUP BY series)"))
def published_numbers(spark, d):
    """Each series' accuracy, published in a Markdown table from the counts of its confusion, against that of its rows, to half a thousandth."""
    from ..sources import payloads as pl

    rows = h.labelled(spark, d)
    cells = rows.groupBy("series", "label", "pred").agg(F.count("*").alias("n"))
    said = cells.groupBy("series").agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    line = F.concat(F.lit("| run "), F.col("series").cast("string"), F.lit(" | **"), F.format_number("accuracy", 4), F.lit("** |"))
    read = pl.table_cells(said.select(F.col("series").alias("row"), line.alias("line"))).where("place = 1").select(F.col("row").alias("series"), "number")
    acc = rows.groupBy("series").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return acc.join(read, "series", "left").agg(F.lit("table").alias("place"), F.count("number").alias("numbers"), F.count_if(F.abs(F.col("number") - F.col("accuracy")) <= 5e-4).alias("agree"))


@query("SELECT lang, round(avg(length(text)), 6) AS derived, coalesce(abs(round_even(avg(n_chars), 3) - avg(length(text))) <= 0.0005, false) AS agrees FROM documents GROUP BY lang")
def published_lengths(spark, d):
    """Means of the stored lengths, published in a Markdown table to three places, against those of the texts themselves, to half a thousandth; rows without a language are one of them."""
    from ..sources import payloads as pl

    docs = ad.table(spark, d, "documents")
    said = docs.groupBy("lang").agg(F.bround(F.avg("n_chars"), 3).alias("mean"))
    line = F.concat(F.lit("| "), F.translate(F.coalesce("lang", F.lit("")), "|", "/"), F.lit(" | **"), F.format_number("mean", 3), F.lit("** |"))
    cells = pl.table_cells(said.select(F.col("lang").alias("row"), line.alias("line"))).where("place = 1").select(F.col("row").alias("said_lang"), "number")
    derived = docs.groupBy("lang").agg(F.avg(F.length("text")).alias("derived"))
    return derived.join(cells, derived["lang"].eqNullSafe(F.col("said_lang")), "left").select("lang", rounded(F.col("derived")).alias("derived"), F.coalesce(F.abs(F.col("number") - F.col("derived")) <= 5e-4, F.lit(False)).alias("agrees"))


# --- windows and partitions


@query(with_views(f"{INDEX_SQL}, ta AS (SELECT series, t - INTERVAL 6 HOUR AS t, instant AS target FROM idx), tw AS (SELECT series, t, s % 28 + 12 AS temp FROM (SELECT CAST(user_id % 4 AS INTEGER) AS series, date_trunc('hour', ts) - INTERVAL 6 HOUR AS t, hour(ts) AS h, sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS s FROM events GROUP BY ALL) WHERE h <> 11)", "SELECT series, t, round(target, 6) AS target, temp::DOUBLE AS target_temp FROM idx JOIN ta USING (series, t) LEFT JOIN tw USING (series, t)"))
def target_weather(spark, d):
    """The weather of the hour that is forecast, beside its index."""
    rows = h.indexed(spark, d).select("series", "t")
    shifted = lambda df, c, new: df.select("series", (F.col("t") - F.make_dt_interval(hours=F.lit(6))).alias("t"), F.col(c).alias(new))
    out = rows.join(shifted(h.indexed(spark, d), "instant", "target"), ["series", "t"]).join(shifted(ad.weather(spark, d), "temp_c", "target_temp"), ["series", "t"], "left")
    return out.select("series", "t", rounded(F.col("target")).alias("target"), "target_temp")


def _frame_sql(before: int, after: int) -> str:
    edge = f"INTERVAL {after} HOURS FOLLOWING" if after else "CURRENT ROW"
    return f"(PARTITION BY series ORDER BY t RANGE BETWEEN INTERVAL {before} HOURS PRECEDING AND {edge})"


@query(with_views(INDEX_SQL, f"SELECT series, t, CASE WHEN n24 = 24 THEN round(m24, 6) END AS mean24, CASE WHEN n8 = 8 THEN round(m8, 6) END AS mean8 FROM (SELECT series, t, count(instant) OVER a AS n24, avg(instant) OVER a AS m24, count(instant) OVER b AS n8, avg(instant) OVER b AS m8 FROM idx WINDOW a AS {_frame_sql(17, 6)}, b AS {_frame_sql(1, 6)}) WHERE n8 = 8"))
def target_means(spark, d):
    """Means of the 24 and the 8 hours that end six hours on, where none of them is missing."""
    a, b = se.hours_frame(17, 6), se.hours_frame(1, 6)
    rows = h.indexed(spark, d).select("series", "t", F.count("instant").over(a).alias("n24"), F.avg("instant").over(a).alias("m24"), F.count("instant").over(b).alias("n8"), F.avg("instant").over(b).alias("m8"))
    return rows.where("n8 = 8").select("series", "t", F.when(F.col("n24") == 24, rounded(F.col("m24"))).alias("mean24"), rounded(F.col("m8")).alias("mean8"))


_PHASE = "(day({x}) - 1) // 10"


@query(with_views(INDEX_SQL, "SELECT series, t, n24 = 30 AND p23 = pe AS whole24, n48 = 54 AND p47 = pe AS whole48, n72 = 78 AND p71 = pe AS whole72 FROM (SELECT series, t, " + ", ".join(f"count(instant) OVER w{k} AS n{k + 1}, month(t - INTERVAL {k} HOUR) * 10 + {_PHASE.format(x=f'(t - INTERVAL {k} HOUR)')} AS p{k}" for k in (23, 47, 71)) + f", month(t + INTERVAL 6 HOUR) * 10 + {_PHASE.format(x='(t + INTERVAL 6 HOUR)')} AS pe FROM idx WINDOW " + ", ".join(f"w{k} AS {_frame_sql(k, 6)}" for k in (23, 47, 71)) + ") WHERE n24 = 30"))
def supported_windows(spark, d):
    """Hours whose window from 23, 47 or 71 hours before to six after is complete and lies within one phase of ten days."""
    at = lambda n: F.col("t") + F.make_dt_interval(hours=F.lit(n))
    phase = lambda t: F.month(t) * 10 + F.floor((F.dayofmonth(t) - 1) / 10)
    n = lambda k: F.count("instant").over(se.hours_frame(k, 6))
    rows = h.indexed(spark, d).select("series", "t", *[n(k).alias(f"n{k}") for k in (23, 47, 71)]).where("n23 = 30")
    return rows.select("series", "t", *[((F.col(f"n{k}") == k + 7) & (phase(at(-k)) == phase(at(6)))).alias(f"whole{k + 1}") for k in (23, 47, 71)])


@query(with_views(f"{INDEX_SQL}, sp AS (SELECT series, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM idx GROUP BY series), sl AS (SELECT sp.series, sp.t, idx.t IS NOT NULL AS here, coalesce(CAST(floor(instant) AS BIGINT)::VARCHAR, '-') || '/' || hour(sp.t) AS slot FROM sp LEFT JOIN idx ON sp.series = idx.series AND sp.t = idx.t)", "SELECT series, t, steps FROM (SELECT series, t, here, array_to_string(list(slot) OVER w, ' ') AS steps, count(*) OVER w AS n FROM sl WINDOW w AS (PARTITION BY series ORDER BY t ROWS 23 PRECEDING)) WHERE n = 24 AND here"))
def causal_windows(spark, d):
    """The 24 hours up to each one, flattened in order; hours that are missing keep their slot."""
    rows = h.indexed(spark, d).select("series", "t", "instant")
    ends = rows.groupBy("series").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = ends.select("series", F.explode(F.sequence("a", "b", F.make_dt_interval(hours=F.lit(1)))).alias("t"))
    slots = spine.join(rows.withColumn("here", F.lit(True)), ["series", "t"], "left")
    slot = F.concat(F.coalesce(F.floor("instant").cast("string"), F.lit("-")), F.lit("/"), F.hour("t").cast("string"))
    frame = se.by_time().rowsBetween(-23, 0)
    out = slots.select("series", "t", "here", F.collect_list(slot).over(frame).alias("s"), F.count("*").over(frame).alias("n"))
    return out.where("n = 24 AND here").select("series", "t", F.array_join("s", " ").alias("steps"))


@query(with_views(f"{LABELLED_SQL}, dy AS (SELECT series, CAST(t AS DATE) AS day, count(CASE WHEN label >= 3 THEN 1 END) AS p, count(CASE WHEN label < 3 THEN 1 END) AS q FROM pre GROUP BY ALL), cu AS (SELECT series, day, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM dy WINDOW w AS (PARTITION BY series ORDER BY day))", "SELECT series, min(CASE WHEN cp >= 20 AND cq >= 200 THEN day END) AS cut, max(cp)::BIGINT AS positives, max(cq)::BIGINT AS negatives FROM cu GROUP BY series"))
def support_cut(spark, d):
    """The earliest day by which a series has enough rows of both kinds."""
    rows = h.labelled(spark, d).groupBy("series", F.to_date("t").alias("day")).agg(F.count_if(F.col("label") >= 3).alias("p"), F.count_if(F.col("label") < 3).alias("q"))
    upto = W.partitionBy("series").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    cum = rows.withColumns({"cp": F.sum("p").over(upto), "cq": F.sum("q").over(upto)})
    return cum.groupBy("series").agg(F.min(F.when((F.col("cp") >= 20) & (F.col("cq") >= 200), F.col("day"))).alias("cut"), F.max("cp").alias("positives"), F.max("cq").alias("negatives"))


#: Phases of the chained search, each from where the last one ends; the rows a phase needs of either kind, and the hours kept free before its end.
PHASES, LEAST_POSITIVE, LEAST_NEGATIVE, GAP_HOURS = ("development", "calibration"), 20, 200, 6


def support_partitions_of(rows, least_positive=LEAST_POSITIVE, least_negative=LEAST_NEGATIVE, gap_hours=GAP_HOURS):
    """(series, t, label) -> (series, phase, begin, stop): daily cuts, each the earliest at which its phase has enough rows of both kinds.

    A row counts for a phase that begins at or before it and ends more than `gap_hours` after it. The last phase takes what is left. A series
    in which a phase lacks support is refused from there on: that phase has NULL for its end, the later ones for both.
    The prefix sums of a series' days are made once; each phase joins them with one row a series.
    """
    day = lambda t: F.date_trunc("day", t).cast("timestamp_ntz")
    cut = F.make_interval(hours=F.lit(gap_hours))
    yes = F.col("label") >= 3
    # Rows count from the first midnight that is after them by the day, and after the gap for the sums that a phase ends with.
    both = rows.select("series", yes.alias("yes"), F.explode(F.array(F.struct(F.lit(True).alias("begins"), (day(F.col("t")) + F.make_interval(days=F.lit(1))).alias("day")), F.struct(F.lit(False).alias("begins"), (day(F.col("t") + cut) + F.make_interval(days=F.lit(1))).alias("day")))).alias("x")).select("series", "yes", "x.*")
    span = rows.groupBy("series").agg(day(F.min("t")).alias("a"), (day(F.max("t")) + F.make_interval(days=F.lit(1))).alias("z"))
    days = span.select("series", F.explode(F.expr("sequence(a, z + INTERVAL 1 DAY, INTERVAL 1 DAY)")).alias("day"))
    kinds = {f"{k}{s}": F.count_if((F.col("begins") == b) & (F.col("yes") == y)) for k, b in (("p", True), ("q", False)) for s, y in (("y", True), ("n", False))}
    daily = days.join(both.groupBy("series", "day").agg(*[x.alias(n) for n, x in kinds.items()]), ["series", "day"], "left").na.fill(0)
    upto = W.partitionBy("series").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    sums = daily.select("series", "day", *[F.sum(n).over(upto).alias(n) for n in kinds])
    at = sums.select("series", F.col("day").alias("begin"), "py", "pn")
    ends = sums.select("series", F.col("day").alias("stop"), "qy", "qn")
    enough = (F.col("qy") - F.col("py") >= least_positive) & (F.col("qn") - F.col("pn") >= least_negative)
    cursor, out = span.select("series", F.col("a").alias("begin"), "z"), None
    for phase in PHASES:
        found = cursor.join(at, ["series", "begin"]).join(ends, "series").where((F.col("stop") > F.col("begin")) & (F.col("stop") < F.col("z")) & enough).groupBy("series").agg(F.min("stop").alias("stop"))
        step = cursor.join(found, "series", "left")
        own = step.select("series", F.lit(phase).alias("phase"), "begin", "stop")
        out = own if out is None else out.unionByName(own)
        cursor = step.select("series", F.col("stop").alias("begin"), "z")
    last = cursor.join(at, ["series", "begin"], "left").join(ends, (cursor["series"] == ends["series"]) & (cursor["z"] == ends["stop"]), "left").select(cursor["series"], F.lit("threshold_selection").alias("phase"), "begin", F.when(enough, F.col("z")).alias("stop"))
    return out.unionByName(last)


def _phase_sql(k, begin):
    return f"{k} AS (SELECT c.series, c.b, c.z, (SELECT min(s.day) FROM dd s WHERE s.series = c.series AND s.day > c.b AND s.day < c.z AND (SELECT count(CASE WHEN label >= 3 THEN 1 END) >= 20 AND count(CASE WHEN label < 3 THEN 1 END) >= 200 FROM pre WHERE pre.series = c.series AND t >= c.b AND t + INTERVAL 6 HOUR < s.day)) AS e FROM (SELECT series, {begin[0]} AS b, z FROM {begin[1]}) c)"


@query(with_views(f"""{LABELLED_SQL}, sp AS (SELECT series, date_trunc('day', min(t))::TIMESTAMP AS a, date_trunc('day', max(t))::TIMESTAMP + INTERVAL 1 DAY AS z FROM pre GROUP BY series),
dd AS (SELECT series, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM sp), {_phase_sql('ph1', ('a', 'sp'))}, {_phase_sql('ph2', ('e', 'ph1'))}""",
"""SELECT series, 'development' AS phase, b AS begin, e AS stop FROM ph1 UNION ALL SELECT series, 'calibration', b, e FROM ph2
UNION ALL SELECT series, 'threshold_selection', e, CASE WHEN (SELECT count(CASE WHEN label >= 3 THEN 1 END) >= 20 AND count(CASE WHEN label < 3 THEN 1 END) >= 200 FROM pre WHERE pre.series = ph2.series AND t >= ph2.e AND t + INTERVAL 6 HOUR < ph2.z) THEN z END FROM ph2"""))
def support_partitions(spark, d):
    return support_partitions_of(h.labelled(spark, d).select("series", "t", "label"))


@query(with_views(f"{LABELLED_SQL}, og AS (SELECT series, a + k * INTERVAL 5 DAY AS origin FROM (SELECT series, CAST(min(t)::DATE AS TIMESTAMP) AS a FROM pre GROUP BY series), unnest(range(1, 6)) r(k))", "SELECT og.series, origin, count(CASE WHEN t < origin - INTERVAL 6 HOUR THEN 1 END)::BIGINT AS train, count(CASE WHEN t >= origin - INTERVAL 6 HOUR AND t < origin THEN 1 END)::BIGINT AS embargo, count(CASE WHEN t >= origin AND t < origin + INTERVAL 5 DAY THEN 1 END)::BIGINT AS validation FROM og JOIN pre ON og.series = pre.series AND t < origin + INTERVAL 5 DAY GROUP BY ALL"))
def rolling_origins(spark, d):
    """Rows of growing training spans and of the validation days after each, six hours apart."""
    rows = h.labelled(spark, d).select("series", "t")
    start = rows.groupBy("series").agg(F.to_date(F.min("t")).cast("timestamp_ntz").alias("a"))
    origins = start.select("series", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("a") + F.make_dt_interval(days=k * 5))).alias("origin"))
    hours = lambda n: F.make_dt_interval(hours=F.lit(n))
    # At most five origins a series: the small side is bounded by the series.
    both = rows.join(origins, "series").where(F.col("t") < F.col("origin") + hours(120))
    t, o = F.col("t"), F.col("origin")
    return both.groupBy("series", "origin").agg(F.count_if(t < o - hours(6)).alias("train"), F.count_if((t >= o - hours(6)) & (t < o)).alias("embargo"), F.count_if(t >= o).alias("validation"))


_STAMP = "sha256(strftime(t, '%Y-%m-%dT%H:%M') || ':' || series)"


@query(with_views(f"{LABELLED_SQL}, f0 AS (SELECT series, t, label, CAST(floor(effective / 25) AS BIGINT) || ':' || label AS fp, {_STAMP} AS k FROM pre), f1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS i FROM f0), f2 AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY i, label) AS first_ FROM f1)", "SELECT label, series, t, fp, place FROM (SELECT *, row_number() OVER (ORDER BY i, label) AS place FROM f2 WHERE first_ = 1) WHERE place <= 20"))
def interleaved_pick(spark, d):
    """Rows of the classes in turn, in order of a digest, the first of each fingerprint, twenty in all."""
    rows = h.labelled(spark, d)
    key = F.sha2(F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm"), F.lit(":"), F.col("series").cast("string")).cast("binary"), 256)
    rows = rows.select("series", "t", "label", F.concat(F.floor(F.col("effective") / 25).cast("string"), F.lit(":"), F.col("label").cast("string")).alias("fp"), key.alias("k"))
    # A fingerprint holds its class, so its first row is that of the least digest; only these are numbered.
    number = F.row_number().over(W.partitionBy("label").orderBy("k"))
    first = rows.withColumn("i", number).groupBy("fp").agg(F.min(F.struct("i", "label", "series", "t")).alias("m")).select("fp", "m.*")
    top = first.orderBy("i", "label").limit(20)
    return top.withColumn("place", F.row_number().over(W.orderBy("i", "label")).cast("long")).select("label", "series", "t", "fp", "place")  # twenty rows


@query(with_views(INDEX_SQL, "SELECT series, t FROM (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY t) AS n, row_number() OVER (PARTITION BY series, CAST(t AS DATE) ORDER BY t) AS k FROM idx WHERE band_i >= 2) WHERE n <= 2 OR k = 1"))
def day_spread(spark, d):
    """The first two rows of a series, then the first of each day that has none yet."""
    rows = h.indexed(spark, d).where("band_i >= 2").select("series", "t")
    day = W.partitionBy("series", F.to_date("t")).orderBy("t")
    return rows.withColumns({"n": F.row_number().over(se.by_time()), "k": F.row_number().over(day)}).where("n <= 2 OR k = 1").select("series", "t")


@query(with_views(f"{INDEX_SQL}, gn AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS i, coalesce(instant > lag(instant) OVER (PARTITION BY series ORDER BY t), false) AS gain FROM idx)", "SELECT series, (max(i) - coalesce(max(CASE WHEN gain THEN i END), 0))::BIGINT AS no_gain FROM gn GROUP BY series"))
def trailing_no_gain(spark, d):
    """Rows at the end of a series since the last one that was above the one before it."""
    rows = h.indexed(spark, d).withColumns({"i": F.row_number().over(se.by_time()), "gain": F.coalesce(F.col("instant") > F.lag("instant").over(se.by_time()), F.lit(False))})
    return rows.groupBy("series").agg((F.max("i") - F.coalesce(F.max(F.when(F.col("gain"), F.col("i"))), F.lit(0))).cast("long").alias("no_gain"))
