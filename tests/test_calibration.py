"""Threshold, calibration and grid against plain loops."""

import math
import random

import numpy as np
import pytest

from breezeframe.operators import calibration as ca
from breezeframe.operators import models as mo
from breezeframe.plans import QUERIES


def made(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        label = rng.choice([0, 0, 0, 1, 2, 3, 4])
        out.append((float(label), float(rng.choice([0, 1, 2, 3, label])), min(1.0, max(0.0, rng.gauss(0.55 if label >= 3 else 0.3, 0.2)))))
    return out


def plain(rows, baseline, most, loss):
    found = []
    for th in ca.THRESHOLDS:
        f = [max(p, 3.0) if q >= th else p for _, p, q in rows]
        pos, neg = sum(y >= 3 for y, *_ in rows), sum(y < 3 for y, *_ in rows)
        if not pos or not neg:
            continue
        recall, far = sum(y >= 3 and x >= 3 for (y, *_), x in zip(rows, f)) / pos, sum(y < 3 and x >= 3 for (y, *_), x in zip(rows, f)) / neg
        acc = sum(y == x for (y, *_), x in zip(rows, f)) / len(rows)
        if far <= most and acc >= baseline - loss:
            found.append((recall, acc, th))
    return max(found, default=None)


@pytest.mark.parametrize("seed, most, baseline", [(1, 0.3, 0.0), (2, 0.4, 0.5), (3, 0.1, 0.0), (4, 1.0, 0.99)])
def test_choice_against_a_loop(spark, seed, most, baseline):
    rows = made(seed)
    got = ca.choose(spark.createDataFrame(rows, "label double, pred double, prob double"), baseline, most)
    want = plain(rows, baseline, most, ca.MAX_ACCURACY_LOSS)
    assert (got and (got.recall, pytest.approx(got.accuracy), got.threshold)) == want


def test_no_choice_without_positives(spark):
    assert ca.choose(spark.createDataFrame([(0.0, 0.0, 0.2)], "label double, pred double, prob double")) is None


def test_scaling_is_at_its_optimum(spark):
    """The gradient of loss and penalty vanishes; probabilities of 0 and 1 are clamped; the error falls on crooked scores."""
    rows = [(y, p, 0.0 if k == 0 else 1.0 if k == 1 else q**3) for k, (y, p, q) in enumerate(made(5))]
    df = spark.createDataFrame(rows, "label double, pred double, prob double")
    model = ca.platt(df)
    slope, bias = model.stages[-1].coefficients[0], model.stages[-1].intercept
    q = np.clip(np.array([r[2] for r in rows]), ca.CLAMP, 1 - ca.CLAMP)
    x, y = np.log(q / (1 - q)), np.array([r[0] >= 3 for r in rows], float)
    p = 1 / (1 + np.exp(-(slope * x + bias)))
    assert abs(((p - y) * x).sum() + slope) < 0.05 and abs((p - y).sum()) < 0.05
    out = ca.calibrated(model, df)
    got = np.array([r["prob"] for r in out.collect()])
    assert np.allclose(np.sort(got), np.sort(p))

    def error(prob):
        at = np.minimum((prob * 10).astype(int), 9)
        return sum((at == b).sum() * abs(prob[at == b].mean() - y[at == b].mean()) for b in set(at.tolist())) / len(prob)

    raw = np.array([r[2] for r in rows])
    assert math.isclose(ca.calibration_error(df).first()["ece"], error(raw)) and math.isclose(ca.calibration_error(out).first()["ece"], error(p)) and error(p) < error(raw)


def test_phases_follow_time(spark):
    df = ca.with_phase(spark.range(100).selectExpr("CAST(id % 2 AS INT) AS series", "id AS t"))
    ends = {r["phase"]: r["z"] for r in df.groupBy("phase").agg({"t": "max"}).withColumnRenamed("max(t)", "z").collect()}
    assert list(sorted(ends, key=ends.get)) == list(ca.PHASES) and mo.CLASSES == 6


def test_grid_query(spark):
    rows = QUERIES["model_risk"](spark, "/root/testdata/sf0.01").collect()
    (best,) = [r for r in rows if r["chosen"]]
    assert len(rows) == len(ca.WEIGHTS) and all(r["false_alarms"] is None or r["false_alarms"] <= ca.MAX_FALSE_ALARMS for r in rows)
    assert best["recall"] == max(r["recall"] for r in rows if r["recall"] is not None) and best["ece_after"] is not None
