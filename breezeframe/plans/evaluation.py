"""Queries over labelled hours: metrics, sessions, windows, splits, gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy as po
from ..operators import metrics as me
from ..operators import series as se
from . import hourly as h
from .hourly import query, r6, rounded
from .sql import INDEX_SQL, LABELLED_SQL, with_views

CM = f"{LABELLED_SQL},\ncm AS (SELECT label AS truth, pred, count(*)::BIGINT AS n FROM pre GROUP BY ALL)"
PRF = f"""{CM},
cl AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(class)),
pc AS (SELECT class, coalesce((SELECT sum(n) FROM cm WHERE truth = class AND pred = class), 0)::DOUBLE AS tp, coalesce((SELECT sum(n) FROM cm WHERE pred = class), 0)::DOUBLE AS p, coalesce((SELECT sum(n) FROM cm WHERE truth = class), 0)::DOUBLE AS s FROM cl),
pr AS (SELECT class, coalesce(tp / nullif(p, 0), 0.0) AS pv, coalesce(tp / nullif(s, 0), 0.0) AS rv, s FROM pc),
f1 AS (SELECT class, round(pv, 4) AS precision, round(rv, 4) AS recall, round(coalesce(2 * pv * rv / nullif(pv + rv, 0), 0.0), 4) AS f1, s::BIGINT AS support FROM pr)"""




@query(with_views(CM, "SELECT * FROM cm"))
def confusion_matrix(spark, d):
    return me.confusion(h.labelled(spark, d))


@query(with_views(PRF, "SELECT class, precision, recall, f1, support FROM f1"))
def class_scores(spark, d):
    out = me.per_class(me.confusion(h.labelled(spark, d)))
    return out.select("class", "precision", "recall", "f1", "support")


@query(with_views(PRF, "SELECT round((SELECT sum(n) FROM cm WHERE truth = pred)::DOUBLE / (SELECT sum(n) FROM cm), 4) AS accuracy, round(avg(CASE WHEN support > 0 THEN f1 END), 4) AS macro_f1, sum(support)::BIGINT AS n FROM f1"))
def accuracy_macro_f1(spark, d):
    """Macro F1 over classes with support; class scores are rounded before they are averaged."""
    cells = me.confusion(h.labelled(spark, d))
    hits = cells.agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))).alias("hits"))
    g = me.per_class(cells).agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("f"), F.sum("support").alias("n"))
    return g.join(hits, F.lit(True)).select(rounded(F.col("hits") / F.col("n"), 4).alias("accuracy"), rounded(F.col("f"), 4).alias("macro_f1"), "n")


@query(
    with_views(
        LABELLED_SQL,
        f"""SELECT n_skip, skip_as_go, round(skip_as_go::DOUBLE / nullif(n_skip, 0), 6) AS skip_as_go_rate, round(skip_as_skip::DOUBLE / nullif(n_skip, 0), 6) AS skip_recall, n_go, go_as_skip, round(same::DOUBLE / n, 6) AS decision_accuracy
FROM (SELECT count(*)::BIGINT AS n, count(CASE WHEN a = 2 THEN 1 END)::BIGINT AS n_skip, count(CASE WHEN a = 2 AND b = 0 THEN 1 END)::BIGINT AS skip_as_go, count(CASE WHEN a = 2 AND b = 2 THEN 1 END)::BIGINT AS skip_as_skip,
  count(CASE WHEN a = 0 THEN 1 END)::BIGINT AS n_go, count(CASE WHEN a = 0 AND b = 2 THEN 1 END)::BIGINT AS go_as_skip, count(CASE WHEN a = b THEN 1 END)::BIGINT AS same
  FROM (SELECT {po.label_policy_sql('label', 'apparent_c', 'precip_mm', 'precip_prob')} AS a, {po.label_policy_sql('pred', 'apparent_c', 'precip_mm', 'precip_prob')} AS b FROM pre))""",
    )
)
def safety_metrics(spark, d):
    both = h.labelled(spark, d).select(*[po.label_policy(F.col(c), *h.inputs()[1:]).alias(x) for c, x in (("label", "a"), ("pred", "b"))])
    a, b = F.col("a"), F.col("b")
    g = both.agg(F.count("*").alias("n"), F.count_if(a == 2).alias("n_skip"), F.count_if((a == 2) & (b == 0)).alias("skip_as_go"), F.count_if((a == 2) & (b == 2)).alias("ss"), F.count_if(a == 0).alias("n_go"), F.count_if((a == 0) & (b == 2)).alias("go_as_skip"), F.count_if(a == b).alias("same"))
    rate = lambda x, y: rounded(me.share(F.col(x), F.col(y)))
    return g.select("n_skip", "skip_as_go", rate("skip_as_go", "n_skip").alias("skip_as_go_rate"), rate("ss", "n_skip").alias("skip_recall"), "n_go", "go_as_skip", rate("same", "n").alias("decision_accuracy"))


@query(
    with_views(
        LABELLED_SQL,
        f"""SELECT CASE WHEN c = '' THEN 'unknown' ELSE c END AS cause, count(*)::BIGINT AS n FROM (SELECT concat_ws('+', CASE WHEN label >= 4 THEN 'air' END, CASE WHEN apparent_c >= 35 THEN 'heat' END, CASE WHEN coalesce(precip_mm, 0) >= 2.5 OR coalesce(precip_prob, 0) >= 70 THEN 'rain' END) AS c
FROM pre WHERE {po.label_policy_sql('label', 'apparent_c', 'precip_mm', 'precip_prob')} = 2) GROUP BY 1""",
    )
)
def skip_causes(spark, d):
    rows = h.labelled(spark, d).where(po.label_policy(F.col("label"), *h.inputs()[1:]) == 2)
    return rows.groupBy(po.skip_cause(F.col("label"), *h.inputs()[1:]).alias("cause")).agg(F.count("*").alias("n"))


_RISK = "count(*)::BIGINT AS n, count(CASE WHEN label >= 3 THEN 1 END)::BIGINT AS positives, count(CASE WHEN pred >= 3 THEN 1 END)::BIGINT AS alarms, count(CASE WHEN label >= 3 AND pred >= 3 THEN 1 END)::BIGINT AS tp, avg((prob - CASE WHEN label >= 3 THEN 1.0 ELSE 0.0 END) ** 2) AS brier"


@query(with_views(f"{LABELLED_SQL}, g AS (SELECT series, {_RISK} FROM pre GROUP BY series)", "SELECT series, n, positives, positives - tp AS misses, round(tp::DOUBLE / nullif(positives, 0), 6) AS recall, alarms - tp AS false_alarms, round((alarms - tp)::DOUBLE / nullif(n - positives, 0), 6) AS false_alarm_rate, round(tp::DOUBLE / nullif(alarms, 0), 6) AS precision, round(brier, 6) AS brier FROM g"))
def risk_metrics(spark, d):
    return me.risk(h.labelled(spark, d), ["series"]).select("series", "n", "positives", "misses", r6("recall"), "false_alarms", r6("false_alarm_rate"), r6("precision"), r6("brier"))


@query(with_views(LABELLED_SQL, "SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*)::BIGINT AS n, round(avg(prob), 6) AS probability, round(avg(CASE WHEN label >= 3 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM pre GROUP BY 1"))
def reliability_bins(spark, d):
    return me.reliability(h.labelled(spark, d)).select("bin", "n", r6("probability"), r6("observed"))


@query(with_views(f"{LABELLED_SQL}, rb AS (SELECT least(floor(prob * 10), 9) AS bin, count(*)::BIGINT AS n, avg(prob) AS p, avg(CASE WHEN label >= 3 THEN 1.0 ELSE 0.0 END) AS o FROM pre GROUP BY 1)", "SELECT round(sum(n * abs(p - o)) / sum(n), 6) AS ece FROM rb"))
def calibration_error(spark, d):
    b = me.reliability(h.labelled(spark, d))
    return b.agg(rounded(F.sum(F.col("n") * F.abs(F.col("probability") - F.col("observed"))) / F.sum("n")).alias("ece"))


@query(with_views(LABELLED_SQL, "SELECT series, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(greatest(0.9 * e, -0.1 * e)), 6) AS pinball, round(avg(CASE WHEN e <= 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM (SELECT series, target - instant AS e FROM pre) GROUP BY series"))
def numeric_forecast(spark, d):
    g = h.labelled(spark, d).groupBy("series").agg(*me.numeric_errors(F.col("target") - F.col("instant"), 0.9))
    return g.select("series", r6("mae"), r6("rmse"), r6("pinball"), r6("coverage"))


@query(with_views(f"{LABELLED_SQL}, g6 AS (SELECT series, " + ", ".join(f"lead({k}, 6) OVER (PARTITION BY series ORDER BY t) - {k} AS {k}" for k in se.GAS_COLUMNS) + ", band_i >= 3 AS poor FROM slots), u AS (UNPIVOT g6 ON pm25, pm10, no2, o3, co INTO NAME gas VALUE e)", "SELECT gas, poor, count(*)::BIGINT AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM u WHERE poor IS NOT NULL GROUP BY ALL"))
def gas_errors(spark, d):
    """Errors of persistence for each gas and for hours of poor air and others, from one unpivoted pass."""
    ahead = h.indexed(spark, d).select("series", *[(F.lead(k, 6).over(se.by_time()) - F.col(k)).alias(k) for k in se.GAS_COLUMNS], (F.col("band_i") >= 3).alias("poor"))
    u = ahead.unpivot(["poor"], list(se.GAS_COLUMNS), "gas", "e").where("e IS NOT NULL AND poor IS NOT NULL")
    g = u.groupBy("gas", "poor").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))
    return g.select("gas", "poor", "n", r6("mae"), r6("rmse"), r6("bias"))


@query(with_views(LABELLED_SQL, "SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_persistence' WHEN b THEN 'only_trailing' ELSE 'neither' END AS hit, count(*)::BIGINT AS n FROM (SELECT label = pred AS a, label = band_e AS b FROM pre) GROUP BY 1"))
def hit_transitions(spark, d):
    a, b = F.col("label") == F.col("pred"), F.col("label") == F.col("band_e")
    return h.labelled(spark, d).groupBy(F.when(a & b, "both").when(a, "only_persistence").when(b, "only_trailing").otherwise("neither").alias("hit")).agg(F.count("*").alias("n"))


@query(with_views(LABELLED_SQL, "SELECT CAST(band_i AS VARCHAR) || '->' || CAST(band_e AS VARCHAR) AS move, count(*)::BIGINT AS n, round(min(effective - instant), 6) AS least, round(avg(effective - instant), 6) AS mean, round(max(effective - instant), 6) AS most FROM pre GROUP BY 1"))
def band_transitions(spark, d):
    gap = F.col("effective") - F.col("instant")
    g = h.labelled(spark, d).groupBy(F.concat_ws("->", "band_i", "band_e").alias("move")).agg(F.count("*").alias("n"), F.min(gap).alias("least"), F.avg(gap).alias("mean"), F.max(gap).alias("most"))
    return g.select("move", "n", r6("least"), r6("mean"), r6("most"))


@query(with_views(LABELLED_SQL, "SELECT pred, count(*)::BIGINT AS n, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, grouping(pred)::BIGINT AS total FROM pre GROUP BY GROUPING SETS ((), (pred))"))
def grouped_hit_rate(spark, d):
    """Overall and for each class in one pass, by grouping sets."""
    h.labelled(spark, d).createOrReplaceTempView("bf_labelled")
    g = spark.sql("SELECT pred, count(*) AS n, avg(CAST(label = pred AS INT)) AS hit_rate, CAST(grouping(pred) AS BIGINT) AS total FROM bf_labelled GROUP BY GROUPING SETS ((), (pred))")
    return g.select("pred", "n", r6("hit_rate"), "total")


@query(with_views(LABELLED_SQL, "SELECT CAST(date_trunc('week', t) AS DATE) AS week, count(*)::BIGINT AS n, round(avg(abs(target - instant)), 6) AS mae FROM pre GROUP BY ROLLUP (CAST(date_trunc('week', t) AS DATE))"))
def rollup_by_week(spark, d):
    rows = h.labelled(spark, d).withColumn("week", F.date_trunc("week", "t").cast("date"))
    return rows.rollup("week").agg(F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("target") - F.col("instant")))).alias("mae"))


@query(with_views(LABELLED_SQL, "SELECT series, max(CASE WHEN k = greatest(1, CAST(ceil(0.95 * n) AS BIGINT)) THEN e END) AS p95, round(median(e), 6) AS med FROM (SELECT series, round(abs(target - instant), 6) AS e, row_number() OVER (PARTITION BY series ORDER BY abs(target - instant)) AS k, count(*) OVER (PARTITION BY series) AS n FROM pre) GROUP BY series"))
def error_percentiles(spark, d):
    e = h.labelled(spark, d).select("series", rounded(F.abs(F.col("target") - F.col("instant"))).alias("e"))
    return e.groupBy("series").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY e)").alias("p95"), rounded(F.median("e")).alias("med"))


@query(with_views(LABELLED_SQL, "SELECT series, round(median(instant), 6) AS med, round(avg(instant), 6) AS mean, round(greatest(stddev_pop(instant), 1e-6), 6) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS k, count(*) OVER (PARTITION BY series) AS n FROM pre) WHERE k <= greatest(1, floor(n * 0.8)) GROUP BY series"))
def train_statistics(spark, d):
    train = se.chronological_split(h.labelled(spark, d)).where("part = 'train'")
    return train.groupBy("series").agg(rounded(F.median("instant")).alias("med"), rounded(F.avg("instant")).alias("mean"), rounded(F.greatest(F.stddev_pop("instant"), F.lit(1e-6))).alias("sd"))


@query(with_views(LABELLED_SQL, "SELECT series, part, label, count(*)::BIGINT AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY t) <= greatest(1, floor(count(*) OVER (PARTITION BY series) * 0.8)) THEN 'train' ELSE 'test' END AS part FROM pre) GROUP BY ALL"))
def chronological_split(spark, d):
    return se.chronological_split(h.labelled(spark, d)).groupBy("series", "part", "label").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(with_views(LABELLED_SQL, "SELECT DISTINCT label FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) <= greatest(1, floor(count(*) OVER (PARTITION BY series) * 0.1)) AS tr FROM pre) a WHERE NOT tr AND NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) <= greatest(1, floor(count(*) OVER (PARTITION BY series) * 0.1)) AS tr FROM pre) b WHERE b.tr AND b.label = a.label)"))
def unsupported_classes(spark, d):
    rows = se.chronological_split(h.labelled(spark, d), 0.9)
    return rows.where("part = 'test'").select("label").distinct().join(rows.where("part = 'train'").select("label"), "label", "left_anti")


@query(with_views(LABELLED_SQL, "SELECT label, round(count(*)::DOUBLE / 1, 6) AS n, round(sqrt((SELECT count(*) FROM pre)::DOUBLE / ((SELECT count(DISTINCT label) FROM pre) * count(*))), 6) AS weight, CASE WHEN label >= 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS floor_weight FROM pre GROUP BY label"))
def sample_weights(spark, d):
    """Root-damped balanced weights of the classes."""
    g = h.labelled(spark, d).groupBy("label").agg(F.count("*").cast("double").alias("n"))
    total = g.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return g.join(F.broadcast(total), F.lit(True)).select("label", "n", rounded(F.sqrt(F.col("_all") / (F.col("_k") * F.col("n")))).alias("weight"), F.when(F.col("label") >= 3, 2.0).otherwise(1.0).alias("floor_weight"))


@query(with_views(LABELLED_SQL, "SELECT series, t, CASE WHEN prob >= 0.6 THEN greatest(pred, 3) ELSE pred END AS floored, round(ln(greatest(1e-6, least(1 - 1e-6, prob)) / (1 - greatest(1e-6, least(1 - 1e-6, prob)))), 6) AS logit FROM pre"))
def risk_floor(spark, d):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prob")))
    return h.labelled(spark, d).select("series", "t", F.when(F.col("prob") >= 0.6, F.greatest(F.col("pred"), F.lit(3))).otherwise(F.col("pred")).alias("floored"), rounded(F.ln(p / (1 - p))).alias("logit"))


_TRY = "SELECT th, count(CASE WHEN label >= 3 THEN 1 END)::DOUBLE AS pos, count(CASE WHEN label < 3 THEN 1 END)::DOUBLE AS neg, count(CASE WHEN label >= 3 AND f >= 3 THEN 1 END) AS tp, count(CASE WHEN label < 3 AND f >= 3 THEN 1 END) AS fp, avg(CASE WHEN label = f THEN 1.0 ELSE 0.0 END) AS acc FROM (SELECT th, label, CASE WHEN prob >= th THEN greatest(pred, 3) ELSE pred END AS f FROM pre, (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS th)) GROUP BY th"


@query(with_views(LABELLED_SQL, f"SELECT round(th, 6) AS threshold, round(tp / nullif(pos, 0), 6) AS recall, round(acc, 6) AS accuracy FROM ({_TRY}) WHERE fp / nullif(neg, 0) <= 0.3 ORDER BY tp / nullif(pos, 0) DESC, acc DESC, th DESC LIMIT 1"))
def threshold_choice(spark, d):
    """All thresholds in one pass: each row is expanded by a constant array, then the best eligible one is an aggregate."""
    rows = h.labelled(spark, d).select("label", "pred", "prob", F.explode(F.array(*[F.lit(k / 20.0) for k in range(1, 20)])).alias("th"))
    f = F.when(F.col("prob") >= F.col("th"), F.greatest(F.col("pred"), F.lit(3))).otherwise(F.col("pred"))
    t = F.col("label") >= 3
    g = rows.groupBy("th").agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"), F.count_if(t & (f >= 3)).alias("tp"), F.count_if(~t & (f >= 3)).alias("fp"), F.avg((F.col("label") == f).cast("double")).alias("acc"))
    best = F.max(F.struct(me.share(F.col("tp"), F.col("pos")).alias("recall"), "acc", "th")).alias("b")
    return g.where(me.share(F.col("fp"), F.col("neg")) <= 0.3).agg(best).where("b IS NOT NULL").select(rounded(F.col("b.th")).alias("threshold"), rounded(F.col("b.recall")).alias("recall"), rounded(F.col("b.acc")).alias("accuracy"))


@query(with_views(LABELLED_SQL, "SELECT label, n, k, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4) AS high FROM (SELECT label, count(*)::BIGINT AS n, count(CASE WHEN pred = label THEN 1 END)::BIGINT AS k, count(CASE WHEN pred = label THEN 1 END)::DOUBLE / count(*) AS p FROM pre GROUP BY label)"))
def wilson_intervals(spark, d):
    g = h.labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("k"))
    low, high = me.wilson(F.col("k"), F.col("n"))
    return g.select("label", "n", "k", low.alias("low"), high.alias("high"))


# --- sessions and windows

EPI = f"""{INDEX_SQL},
e0 AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS b FROM idx WHERE band_i >= 3),
e1 AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b > INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t) AS episode FROM e0)"""


def episodes(spark, d):
    return se.with_episodes(h.indexed(spark, d), F.col("band_i") >= 3)


@query(with_views(EPI, "SELECT series, episode::BIGINT AS episode, min(t) AS first_t, max(t) AS last_t, count(*)::BIGINT AS hours, round(max(instant), 6) AS peak FROM e1 GROUP BY series, episode"))
def episode_list(spark, d):
    return episodes(spark, d).groupBy("series", "episode").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("hours"), rounded(F.max("instant")).alias("peak"))


@query(with_views(f"{EPI}, pv AS (SELECT series, t, lag(band_i, 6) OVER (PARTITION BY series ORDER BY t) >= 3 AS hit FROM idx), eh AS (SELECT series, episode, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS k, arg_min(coalesce(hit, false), t) AS onset FROM e1 JOIN pv USING (series, t) GROUP BY ALL)", "SELECT series, count(*)::BIGINT AS episodes, count(CASE WHEN k > 0 THEN 1 END)::BIGINT AS any_hit, count(CASE WHEN k = n THEN 1 END)::BIGINT AS full_hit, count(CASE WHEN k = 0 THEN 1 END)::BIGINT AS missed, count(CASE WHEN onset THEN 1 END)::BIGINT AS onset_hit, max(n)::BIGINT AS largest FROM eh GROUP BY series"))
def episode_hits(spark, d):
    """Episodes that the forecast of six rows before hits at all, wholly, never, and at their first hour."""
    rows = h.indexed(spark, d).withColumn("hit", F.coalesce(F.lag("band_i", 6).over(se.by_time()) >= 3, F.lit(False)))
    e = se.with_episodes(rows, F.col("band_i") >= 3).groupBy("series", "episode").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"), F.min_by("hit", "t").alias("onset"))
    return e.groupBy("series").agg(F.count("*").alias("episodes"), F.count_if(F.col("k") > 0).alias("any_hit"), F.count_if(F.col("k") == F.col("n")).alias("full_hit"), F.count_if(F.col("k") == 0).alias("missed"), F.count_if("onset").alias("onset_hit"), F.max("n").alias("largest"))


@query(with_views(EPI, "SELECT series, t, CASE WHEN k = 1 THEN 'onset' WHEN t = top THEN 'peak' WHEN t < top THEN 'rising' ELSE 'falling' END AS phase FROM (SELECT series, t, row_number() OVER (PARTITION BY series, episode ORDER BY t) AS k, first_value(t) OVER (PARTITION BY series, episode ORDER BY instant DESC, t) AS top FROM e1)"))
def episode_phases(spark, d):
    within = W.partitionBy("series", "episode")
    rows = episodes(spark, d).withColumns({"k": F.row_number().over(within.orderBy("t")), "top": F.first("t").over(within.orderBy(F.desc("instant"), "t"))})
    return rows.select("series", "t", F.when(F.col("k") == 1, "onset").when(F.col("t") == F.col("top"), "peak").when(F.col("t") < F.col("top"), "rising").otherwise("falling").alias("phase"))


@query(with_views(INDEX_SQL, "SELECT series, t FROM (SELECT series, t, count(CASE WHEN pm25 IS NOT NULL AND pm10 IS NOT NULL THEN 1 END) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND INTERVAL 2 HOURS FOLLOWING) AS n FROM idx) WHERE n = 8"))
def complete_windows(spark, d):
    """Hours whose window from five hours before to two after is complete, by the clock and not by position."""
    ok = F.count(F.when(F.col("pm25").isNotNull() & F.col("pm10").isNotNull(), 1)).over(se.hours_frame(5, 2))
    return h.indexed(spark, d).withColumn("n", ok).where("n = 8").select("series", "t")


@query(with_views(INDEX_SQL, "SELECT series, t, round(m, 6) AS mean_pm25 FROM (SELECT series, t, avg(pm25) OVER w AS m, count(pm25) OVER w AS n FROM idx WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW)) WHERE n = 4"))
def complete_means(spark, d):
    frame = se.hours_frame(3, 0)
    rows = h.indexed(spark, d).withColumns({"m": F.avg("pm25").over(frame), "n": F.count("pm25").over(frame)})
    return rows.where("n = 4").select("series", "t", rounded(F.col("m")).alias("mean_pm25"))


@query(with_views(INDEX_SQL, "SELECT series, t, coalesce(lag(t, 6) OVER (PARTITION BY series ORDER BY t) = t - INTERVAL 6 HOURS, false) AS contiguous FROM idx"))
def contiguity(spark, d):
    return h.indexed(spark, d).select("series", "t", F.coalesce(F.lag("t", 6).over(se.by_time()) == F.col("t") - F.make_dt_interval(hours=F.lit(6)), F.lit(False)).alias("contiguous"))


@query(with_views(INDEX_SQL, "SELECT series, t, " + ", ".join(f"round(lead(instant, {n}) OVER (PARTITION BY series ORDER BY t), 6) AS h{n}" for n in range(1, 7)) + " FROM idx"))
def horizons(spark, d):
    return h.indexed(spark, d).select("series", "t", *[rounded(F.lead("instant", n).over(se.by_time())).alias(f"h{n}") for n in range(1, 7)])


@query(with_views(INDEX_SQL, "SELECT series, t, day_no::BIGINT AS day_no, CASE WHEN day_no <= floor(days * 0.7) THEN 'train' WHEN day_no <= floor(days * 0.7) + 2 THEN 'purged' WHEN day_no <= floor(days * 0.85) THEN 'validation' ELSE 'test' END AS part FROM (SELECT series, t, dense_rank() OVER (PARTITION BY series ORDER BY CAST(t AS DATE)) AS day_no, dd.days FROM idx JOIN (SELECT series, count(DISTINCT CAST(t AS DATE)) AS days FROM idx GROUP BY series) dd USING (series))"))
def day_split(spark, d):
    """Days to train, purge, validate and test, by dense rank."""
    rows = h.indexed(spark, d).withColumn("date", F.col("t").cast("date"))
    days = rows.groupBy("series").agg(F.count_distinct("date").alias("days"))
    n = F.dense_rank().over(W.partitionBy("series").orderBy("date"))
    out = rows.withColumn("day_no", n).join(days, "series")
    part = F.when(F.col("day_no") <= F.floor(F.col("days") * 0.7), "train").when(F.col("day_no") <= F.floor(F.col("days") * 0.7) + 2, "purged").when(F.col("day_no") <= F.floor(F.col("days") * 0.85), "validation").otherwise("test")
    return out.select("series", "t", F.col("day_no").cast("long").alias("day_no"), part.alias("part"))


def digest_of_days(rows):
    """(series, digest, n) of rows (series, t): each day's sorted hours make a digest, and those in order of days the whole one.

    At most 24 hours, then the days, of a series meet in one row. A repeated hour is refused.
    """
    stamp = F.date_format("t", "yyyy-MM-dd'T'HH:mm")
    digest = lambda parts: F.sha2(F.array_join(parts, ",").cast("binary"), 256)
    once = rows.groupBy("series", "t").agg(F.count("*").alias("k"))
    once = once.withColumn("k", F.when(F.col("k") == 1, F.col("k")).otherwise(F.raise_error(F.concat(F.lit("repeated origin "), stamp)).cast("long")))
    days = once.groupBy("series", F.to_date("t").alias("day")).agg(digest(F.array_sort(F.collect_list(stamp))).alias("digest"), F.sum("k").alias("k"))
    inorder = F.transform(F.array_sort(F.collect_list(F.struct("day", "digest"))), lambda s: s["digest"])
    return days.groupBy("series").agg(digest(inorder).alias("digest"), F.sum("k").alias("n"))


@query(with_views(INDEX_SQL, "SELECT series, sha256(string_agg(digest, ',' ORDER BY day)) AS digest, sum(k)::BIGINT AS n FROM (SELECT series, CAST(t AS DATE) AS day, sha256(string_agg(strftime(t, '%Y-%m-%dT%H:%M'), ',' ORDER BY t)) AS digest, count(*) AS k FROM idx GROUP BY ALL) GROUP BY series"), also="origins_digest_all")
def origins_digest(spark, d):
    return digest_of_days(h.indexed(spark, d).select("series", "t"))


@query(with_views(LABELLED_SQL, "SELECT count(CASE WHEN effective < instant THEN 1 END)::BIGINT AS below_instant, count(CASE WHEN target_t <= t THEN 1 END)::BIGINT AS not_ahead, (count(*) - count(DISTINCT {'s': series, 't': t}))::BIGINT AS repeated FROM pre"))
def dataset_checks(spark, d):
    rows = h.labelled(spark, d)
    return rows.agg(F.count_if(F.col("effective") < F.col("instant")).alias("below_instant"), F.count_if(F.col("target_t") <= F.col("t")).alias("not_ahead"), (F.count("*") - F.count_distinct(F.struct("series", "t"))).alias("repeated"))


@query(with_views(LABELLED_SQL, "SELECT count(CASE WHEN a AND NOT b THEN 1 END)::BIGINT AS only_a, count(CASE WHEN b AND NOT a THEN 1 END)::BIGINT AS only_b, round(sqrt(avg(a::INTEGER) * (1 - avg(a::INTEGER)) / count(*)), 6) AS se FROM (SELECT label = pred AS a, label = band_e AS b FROM pre)"))
def discordant_pairs(spark, d):
    a, b = F.col("label") == F.col("pred"), F.col("label") == F.col("band_e")
    return h.labelled(spark, d).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), rounded(F.sqrt(F.avg(a.cast("double")) * (1 - F.avg(a.cast("double"))) / F.count("*"))).alias("se"))
