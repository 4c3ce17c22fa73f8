"""The one door to external models: a vectorised function over arrays, on the edge of a plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scoring rules over an array of squared errors, without Python: the mean, the last step, the mean of the last five.
SCORING_RULES: dict[str, Callable[[Column], Column]] = {
    "window_mean": lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e),
    "last_step": lambda e: F.element_at(e, -1),
    "last_five": lambda e: F.aggregate(F.slice(e, -5, 5), F.lit(0.0), lambda a, x: a + x) / F.size(F.slice(e, -5, 5)),
}


def predictor(model: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function that gives a batch of equally long arrays to ``model``, (n, width) to (n, classes). Null arrays have null results."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        there = [x for x in xs if x is not None]
        got = iter(np.asarray(model(np.stack(there)), dtype=float) if there else ())
        return pd.Series([None if x is None else next(got) for x in xs], dtype=object)

    return run


def boosted_classifier(train: DataFrame, features: str, label: str, rounds: int = 100, depth: int = 3, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """Fits boosted trees, one model for each class against the rest, and returns what adds ``pred``, the likeliest class, to a frame.

    ``features`` is an array of numbers, ``label`` a class from 0. Its trees aren't those of other libraries with the same settings.
    """
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    packed = lambda df: df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, featuresCol="_features", labelCol="_label")
    model = OneVsRest(classifier=one, featuresCol="_features", labelCol="_label", predictionCol="_pred").fit(packed(train).select("_features", F.col(label).cast("double").alias("_label")))
    return lambda df: model.transform(packed(df)).withColumn("pred", F.col("_pred").cast("int")).select(*df.columns, "pred")
