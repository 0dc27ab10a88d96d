"""Saved models: equal scores, and None for whatever is broken."""

import json

import pytest
from pyspark.sql import functions as F

from breezeframe.functions import text as tx
from breezeframe.operators import artifacts as ar
from breezeframe.operators import models as mo


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.range(200).select(*[((F.col("id") * (k + 3)) % 17).cast("double").alias(c) for k, c in enumerate(mo.INPUTS)], (F.col("id") % 3).cast("double").alias("label"))
    return mo.logistic().fit(rows), rows


def scores(model, rows):
    return [r[0] for r in model.transform(rows).select("probability").collect()]


def test_scores_are_equal_after_loading(spark, fitted, tmp_path):
    model, rows = fitted
    ar.save(model, mo.INPUTS, f"file://{tmp_path}/a", {"seed": 7})
    back = ar.load(spark, f"file://{tmp_path}/a")
    assert back.features == mo.INPUTS and back.about == {"seed": 7} and scores(back, rows) == scores(model, rows)
    with pytest.raises(ValueError, match="lack lag6"):
        back.transform(rows.drop("lag6"))


def test_what_is_broken_is_none(spark, fitted, tmp_path):
    model, _ = fitted
    folder = f"file://{tmp_path}/b"
    assert ar.load(spark, folder) is None
    with pytest.raises(ValueError):
        ar.save(model, mo.INPUTS[:-1], folder)
    ar.save(model, mo.INPUTS, folder)

    def said(**change):
        line = json.dumps({"format": 1, "features": list(mo.INPUTS), "about": {}} | change)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/features")
        return ar.load(spark, folder)

    assert said() is not None
    assert said(features=list(mo.INPUTS[1:])) is None and said(features=[mo.INPUTS[0]] * len(mo.INPUTS)) is None and said(format=2) is None
    spark.createDataFrame([("not json",)], "value string").write.mode("overwrite").text(f"{folder}/features")
    assert ar.load(spark, folder) is None


@pytest.mark.parametrize("text, want", [("One two. Three four! Five six?", "One two. Three four!"), ("One two three.", "One two three."), ("a b c d e f g", "a b c d e..."), ("One. " + "w " * 9, "One."), ("", ""), (None, None)])
def test_whole_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.whole_sentences(F.col("t"), 5)).first()[0] == want


@pytest.mark.parametrize(
    "response, want",
    [
        ('{"candidates": [{"content": {"parts": [{"text": "hm", "thought": true}, {"text": " a "}, {"text": "b"}]}, "finishReason": "STOP"}]}', ("ab", "STOP", None)),
        ('{"candidates": [{"content": {"parts": [{"text": "a"}]}}]}', ("a", "UNKNOWN", None)),
        ('{"candidates": [{"content": {"parts": [{"text": "hm", "thought": true}]}}]}', (None, None, "a thought alone")),
        ('{"candidates": [{"finishReason": "SAFETY"}], "promptFeedback": {"blockReason": "X"}}', (None, None, "empty: X")),
        ('{"candidates": []}', (None, None, "no candidates")),
        ("nonsense", (None, None, "no candidates")),
    ],
)
def test_answers(spark, response, want):
    df = spark.createDataFrame([(response,)], "r string")
    assert tuple(df.select(tx.answer_parts(F.col("r")).alias("a")).select("a.*").first()) == want
