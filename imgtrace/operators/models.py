"""Models from Spark's own library: classification of regions and principal components of movies."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict(rows: DataFrame, key: str, label: str, features: list[str], strength: float = 100.0) -> DataFrame:
    """key, probability and label by a regularised logistic regression on the logarithm of the features."""
    logs = rows.select(key, F.col(label).cast("double").alias("label"), *(F.log1p(f).alias(f) for f in features))
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(logs)
    n = max(1, ready.count())
    model = LogisticRegression(regParam=1.0 / (strength * n), standardization=False, maxIter=50).fit(ready)
    probability = vector_to_array("probability")[1]
    return model.transform(ready).select(key, F.round(probability, 4).alias("probability"), (probability > 0.5).alias("is_positive"))


def principal_components(frames: DataFrame, frame: str, values: str, count: int) -> DataFrame:
    """frame, component and projection of each frame on the first components; a component's greatest loading by size is positive."""
    vectors = frames.select(frame, array_to_vector(F.col(values).cast("array<double>")).alias("v"))
    model = PCA(k=count, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(count)])
    sign = F.element_at(F.array(*(F.lit(float(s)) for s in signs)), F.col("component") + 1)
    return model.transform(vectors).select(frame, F.posexplode(vector_to_array("p")).alias("component", "projection")).withColumn("projection", F.round(F.col("projection") * sign, 4))
