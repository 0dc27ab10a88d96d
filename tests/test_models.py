"""Class weights, and a weighted forest on rows whose class one input tells."""

from pyspark.sql import functions as F

from breezeframe.operators import models as mo


def test_weights_and_held_out_classes(spark):
    k = F.col("id") % 40
    rows = spark.range(800).select("id", F.when(k == 0, 5.0).when(k < 14, 1.0).otherwise(0.0).alias("label"))
    rows = rows.select("id", "label", *[(F.col("label") * 10 + F.rand(3) if c == "effective" else F.rand(n)).alias(c) for n, c in enumerate(mo.INPUTS)])
    train, test = rows.where("id < 600"), rows.where("id >= 600")
    weighted = mo.with_class_weights(train)
    n = {r["label"]: (r["n"], r["w"]) for r in weighted.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert sum(c for c, _ in n.values()) == 600 and all(abs(w - 200) < 1e-6 for _, w in n.values())
    scored = mo.forest(20).fit(weighted).transform(test)
    wrong = scored.where("prediction <> label").count()
    assert wrong <= 10, wrong
