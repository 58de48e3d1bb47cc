"""Closed-set scoring: class probabilities as identity scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F


def classifier_scores(train: DataFrame, probes: DataFrame, codes: DataFrame, rounds: int = 20) -> DataFrame:
    """Multinomial logistic regression on ``vec``; ``probe_id, true_identity, identity, score``.

    ``codes(label, code)`` maps labels to 0..N-1.
    """
    coded = train.join(codes, "label").select(
        array_to_vector("vec").alias("features"), F.col("code").cast("double").alias("code")
    )
    model = LogisticRegression(labelCol="code", maxIter=rounds, regParam=1e-3).fit(coded)
    features = probes.select("id", "label", array_to_vector("vec").alias("features"))
    scored = model.transform(features).select(
        F.col("id").alias("probe_id"),
        F.col("label").alias("true_identity"),
        F.posexplode(vector_to_array("probability")).alias("code", "score"),
    )
    names = codes.select(F.col("code").cast("int").alias("code"), F.col("label").alias("identity"))
    return scored.join(names, "code").drop("code")
