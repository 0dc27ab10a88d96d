"""Boosting against plain loops over the same rows, on any split of them, and held out against persistence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeframe.operators import boosting as bo
from breezeframe.plans import QUERIES
from breezeframe.plans import models as model_plans


def rows_of(spark, n=1200):
    """The class is told by two inputs together and by a missing third."""
    r = np.random.default_rng(4)
    a, b, c = r.random(n), r.random(n), r.random(n)
    c[r.random(n) < 0.2] = np.nan
    label = np.where(np.isnan(c), 4, np.where((a > 0.5) == (b > 0.5), 0, 2))
    data = [(int(y), float(x), float(z), None if k % 2 and np.isnan(v) else float(v), "clash") for k, (y, x, z, v) in enumerate(zip(label, a, b, c))]
    return spark.createDataFrame(data, "label int, a double, b double, c double, bins string")


def chances(spark, model, rows):
    out = bo.with_chances(rows, model).collect()
    return np.array([r["probability"] for r in out]), np.array([r["label"] for r in out])


def test_learns_and_unseen_classes_have_no_chance(spark):
    rows = rows_of(spark)
    train, test = rows.where("a < 0.8"), rows.where("a >= 0.8")
    p, y = chances(spark, bo.fit(train, ("a", "b", "c"), rounds=15), test)
    assert (p.argmax(axis=1) == y).mean() > 0.93 and np.allclose(p.sum(axis=1), 1) and not p[:, [1, 3, 5]].any()


def test_first_split_is_the_best_of_all(spark):
    """One tree of one level against every input and every cut, by sums over the rows themselves."""
    rows = rows_of(spark, 400).withColumn("weight", 1.0 + F.col("label") / 2)
    model = bo.fit(rows, ("a", "b", "c"), rounds=1, depth=1, rate=1.0)
    got = rows.collect()
    x = np.array([[np.nan if v is None else v for v in (r["a"], r["b"], r["c"])] for r in got])
    y, w, bins = np.array([r["label"] for r in got]), np.array([r["weight"] for r in got])[:, None], model.bins(x)
    p = np.exp(model.start)[None, :]
    g, h = w * (p - np.eye(6)[y]), w * p * (1 - p)
    side = lambda m: ((g[m].sum(0) ** 2) / (h[m].sum(0) + bo.L2)).sum()
    every = {(k, c): side(bins[:, k] <= c) + side(bins[:, k] > c) for k in range(3) for c in range(bo.BINS) if min((bins[:, k] <= c).sum(), (bins[:, k] > c).sum()) >= bo.LEAST_ROWS}
    tree = model.trees[0]
    chosen = (tree.feature[0], tree.cut[0])
    assert every[chosen] == pytest.approx(max(every.values()))
    low = bins[:, chosen[0]] <= chosen[1]
    assert tree.values[0] == pytest.approx(-g[low].sum(0) / (h[low].sum(0) + bo.L2)) and tree.values[1] == pytest.approx(-g[~low].sum(0) / (h[~low].sum(0) + bo.L2))


def test_same_on_any_split_of_the_rows(spark):
    rows = rows_of(spark, 600)
    one, two = (bo.fit(rows.repartition(n), ("a", "b", "c"), rounds=3) for n in (1, 7))
    assert np.allclose(chances(spark, one, rows)[0], chances(spark, two, rows)[0])


def test_odd_rows(spark):
    none = rows_of(spark, 10).limit(0)
    p, _ = chances(spark, bo.fit(none, ("a", "b", "c")), rows_of(spark, 10))
    assert np.allclose(p, 1 / 6)
    few = spark.createDataFrame([(1, None, 2.0), (None, 1.0, 1.0), (1, None, 2.0)], "label int, a double, b double")
    p, _ = chances(spark, bo.fit(few, ("a", "b"), rounds=2), few)
    assert np.allclose(p[:, 1], 1)


def test_beats_persistence(spark):
    r = QUERIES["model_softmax"](spark, "/root/testdata/sf0.01").first()
    assert r["n"] > 0 and r["accuracy"] >= r["persistence"]


def test_passes_start_no_more_tasks_than_the_rows_need(spark):
    """Rows in 40 partitions, most of them as good as empty: only passes before the first tree start 40 tasks, none of the 12 for its levels."""
    rows = rows_of(spark, 600).repartition(40)
    sc = spark.sparkContext
    sc.setJobGroup("few-tasks", "fit")
    try:
        bo.fit(rows, ("a", "b", "c"), rounds=4)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 40 * 8


def test_training_rows_lie_in_few_partitions(spark):
    train, _ = model_plans.parts(spark, "/root/testdata/sf0.01")
    assert train.count() > 0 and train.rdd.getNumPartitions() == 1
