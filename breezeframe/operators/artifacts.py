"""Fitted models as artifacts: a saved pipeline with the order of its features, checked when it is loaded.

`load` never raises: what is absent, damaged, of another format, or takes another number of features than its order has is None, and the
caller goes on without a model. Scores before and after are the same, as the pipeline is Spark ML's own persistence.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


@dataclass(frozen=True)
class Artifact:
    model: PipelineModel
    features: tuple[str, ...]
    about: dict

    def transform(self, rows: DataFrame) -> DataFrame:
        """Scores of rows that have all features; ValueError names those that they lack."""
        lacking = [c for c in self.features if c not in rows.columns]
        if lacking:
            raise ValueError(f"the rows lack {', '.join(lacking)}")
        return self.model.transform(rows)


def width(model: PipelineModel) -> int | None:
    """How many features the last stage takes, if it tells."""
    return getattr(model.stages[-1], "numFeatures", None)


def save(model: PipelineModel, features: tuple[str, ...], folder: str, about: dict | None = None) -> None:
    """Write a model, and beside it, last, what it takes; an earlier artifact of that folder is replaced."""
    if not features or len(set(features)) < len(features) or width(model) not in (None, len(features)):
        raise ValueError(f"the model takes {width(model)} features, its order has {len(features)}, each once")
    spark = SparkSession.active()
    model.write().overwrite().save(f"{folder}/model")
    line = json.dumps({"format": FORMAT, "features": list(features), "about": about or {}}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/features")


def load(spark: SparkSession, folder: str) -> Artifact | None:
    try:
        said = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/features").limit(2).collect()))
        model, features = PipelineModel.load(f"{folder}/model"), tuple(said["features"])
        if said["format"] != FORMAT or len(set(features)) < len(features) or width(model) not in (None, len(features)):
            return None
        return Artifact(model, features, said["about"])
    except Exception:  # whatever is wrong with the files, there is no model
        return None
