"""Model queries: fit on the first part of each series, score the rest; rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import calibration as ca
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import series as se
from . import hourly as h
from .hourly import query, rounded
from .sql import LABELLED_SQL, with_views


def parts(spark, d):
    rows = se.chronological_split(se.with_lags(h.labelled(spark, d)))
    rows = mo.as_doubles(rows).select("series", "t", "part", "label", "pred", "target", *mo.INPUTS)
    return mo.packed(rows.where("part = 'train'")), rows.where("part = 'test'")


def hit_rate(scored, name):
    return scored.agg(F.lit(name).alias("model"), F.count("*").alias("n"), rounded(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query()
def model_logistic(spark, d):
    train, test = parts(spark, d)
    return hit_rate(mo.logistic().fit(train).transform(test), "logistic")


@query()
def model_forest(spark, d):
    train, test = parts(spark, d)
    return hit_rate(mo.forest().fit(mo.with_class_weights(train)).transform(test), "forest")


@query()
def model_boosted(spark, d):
    train, test = parts(spark, d)
    return hit_rate(mo.boosted().fit(train).transform(test), "boosted")


@query()
def model_blend(spark, d):
    """Two models' probabilities blended, then the rule for the moderate class."""
    train, test = parts(spark, d)
    drop = ["rawPrediction", "probability", "prediction", "raw", "features", *[f"{c}_f" for c in mo.INPUTS]]
    one = mo.probabilities(mo.logistic().fit(train).transform(test), "p1").drop(*drop)
    two = mo.probabilities(mo.forest().fit(mo.with_class_weights(train)).transform(one), "p2").drop(*drop)
    return hit_rate(two.withColumn("prediction", mo.moderate_rule(mo.blend([("p1", 0.5), ("p2", 0.5)]), 0.35).cast("double")), "blend")


@query()
def model_softmax(spark, d):
    """Boosting of all classes at once, beside the share that persistence gets right."""
    train, test = parts(spark, d)
    scored = bo.with_chances(test, bo.fit(train, mo.INPUTS), "p").withColumn("prediction", mo.most_likely(F.col("p")))
    out = scored.agg(F.lit("softmax").alias("model"), F.count("*").alias("n"), *[rounded(F.avg((F.col(c) == F.col("label")).cast("double")), 4).alias(name) for c, name in (("prediction", "accuracy"), ("pred", "persistence"))])
    return out


@query()
def model_consensus(spark, d):
    """Three models' probabilities at fixed weights: boosting, boosting with classes weighed by the root of their balance, and a forest; then the rule for the moderate class."""
    train, test = parts(spark, d)
    damped = mo.with_class_weights(train).withColumn("weight", F.sqrt("weight"))
    scored = bo.with_chances(bo.with_chances(test, bo.fit(train, mo.INPUTS), "p1"), bo.fit(damped, mo.INPUTS), "p2")
    plain = train.withColumn("weight", F.lit(1.0))
    scored = mo.probabilities(mo.forest(depth=14, least=3).fit(plain).transform(scored), "p3")
    return hit_rate(scored.withColumn("prediction", mo.moderate_rule(mo.blend(list(zip(("p1", "p2", "p3"), mo.CONSENSUS))), mo.MODERATE).cast("double")), "consensus")


@query()
def model_ridge(spark, d):
    train, test = parts(spark, d)
    train = train.where("target IS NOT NULL")
    scored = mo.ridge("target", 10.0, train.count()).fit(train).transform(test.where("target IS NOT NULL"))
    return scored.select("series", (F.col("target") - F.greatest(F.col("prediction"), F.lit(0.0))).alias("e")).groupBy("series").agg(*me.numeric_errors(F.col("e"), 0.5))


_SPLIT = "row_number() OVER (PARTITION BY series ORDER BY t) <= greatest(1, floor(count(*) OVER (PARTITION BY series) * 0.8))"


@query(with_views(f"{LABELLED_SQL}, sp AS (SELECT label, pred, {_SPLIT} AS tr FROM pre), mj AS (SELECT label FROM sp WHERE tr GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)", "SELECT count(*)::BIGINT AS n, count(CASE WHEN sp.label = mj.label THEN 1 END)::BIGINT AS majority_hits, count(CASE WHEN sp.label = pred THEN 1 END)::BIGINT AS persistence_hits FROM sp, mj WHERE NOT tr"))
def model_baselines(spark, d):
    rows = se.chronological_split(h.labelled(spark, d))
    counts = rows.where("part = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    top = counts.agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("majority"))
    test = rows.where("part = 'test'").join(F.broadcast(top), F.lit(True))
    return test.agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("majority")).alias("majority_hits"), F.count_if(F.col("label") == F.col("pred")).alias("persistence_hits"))


@query()
def model_risk(spark, d):
    """A row for each weight of the grid with its choice on development rows; the chosen one with its threshold and calibration errors before and after."""
    rows = ca.with_phase(mo.as_doubles(se.with_lags(h.labelled(spark, d))).withColumn("pred", F.col("pred").cast("double"))).select("series", "t", "phase", "label", "pred", *mo.INPUTS)
    rows = mo.packed(rows)
    train, development, calibration, selection = (rows.where(F.col("phase") == p) for p in ca.PHASES)
    model, weight, found = ca.weighted_grid(train, development)
    scaler = ca.platt(ca.with_risk(model, calibration))
    raw = ca.with_risk(model, selection)
    own = ca.calibrated(scaler, raw)
    baseline = selection.agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).first()[0] or 0.0
    choice = ca.choose(own, baseline)
    before, after = (ca.calibration_error(x).first()["ece"] for x in (raw, own))
    out = [(w, c and c.threshold, c and c.recall, c and c.false_alarms, w == weight, *((choice and choice.threshold, before, after) if w == weight else (None, None, None))) for w, c in found.items()]
    rows.unpersist()
    return spark.createDataFrame(out, "weight double, threshold double, recall double, false_alarms double, chosen boolean, final_threshold double, ece_before double, ece_after double")
