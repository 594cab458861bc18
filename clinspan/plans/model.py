"""Risk models with Spark ML on feature tables and series windows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.functions import scalars

from . import evaluate


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    rows = df.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows)


def prepared(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Both with nulls imputed by the training means (0 where a column has no training value), and as vectors."""
    means = evaluate.fit_means(train, columns)
    return tuple(assembled(evaluate.impute(d, means, columns).na.fill(0.0, columns), columns, label) for d in (train, test))


def scored(model, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, "label", vector_to_array("probability")[1].alias("score"))


def fit_logistic(train: DataFrame, weight: str | None = None, max_iter: int = 5000, tol: float = 1e-9):
    """L2 with C = 1 on the sum of (weighted) losses: Spark's mean loss takes 1 / the sum of weights; columns aren't
    standardised in the penalty. The tolerance is small enough that scores are the optimum's, not the stopping rule's."""
    total = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    model = LogisticRegression(maxIter=max_iter, tol=tol, regParam=1.0 / max(1.0, total or 0.0), elasticNetParam=0.0, standardization=False)
    return (model.setWeightCol(weight) if weight else model).fit(train)


def fit_boosted_trees(train: DataFrame, seed: int = 42):
    return GBTClassifier(maxDepth=4, maxIter=50, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(train)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """With weight: negatives over positives for positive rows (1 if there are none), 1 for others."""
    counts = train.agg(F.count_if(F.col(label).cast("int") == 1).alias("_p"), F.count_if(F.col(label).cast("int") == 0).alias("_n"))
    positive = F.coalesce(F.try_divide("_n", "_p"), F.lit(1.0))
    weight = scalars.literals(counts.select(positive.alias("w")))["w"]
    return train.withColumn("weight", F.when(F.col(label).cast("int") == 1, weight).otherwise(1.0))


def fit_encoder(vectors: DataFrame, k: int, column: str = "features"):
    """A linear encoder of windows: principal components."""
    return PCA(k=k, inputCol=column, outputCol="code").fit(vectors)


def window_vectors(windows: DataFrame) -> DataFrame:
    """Windows' steps side by side as one vector."""
    return windows.withColumn("features", array_to_vector(F.flatten("steps")))


def reconstruction(encoder, vectors: DataFrame, column: str = "features") -> DataFrame:
    """With error: the mean squared difference of each centred vector and its projection on the components.

    Spark's components are applied to vectors as they are, so the mean of the training vectors isn't subtracted here
    either: the projection of v is C Ct v."""
    components = encoder.pc.toArray().tolist()  # dimensions x k, a parameter of the model
    coded = encoder.transform(vectors).withColumn("_v", vector_to_array(column)).withColumn("_c", vector_to_array("code"))
    table = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in components))
    back = F.transform(table, lambda row: F.aggregate(F.zip_with(row, F.col("_c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    error = F.aggregate(F.zip_with("_v", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("_v")
    return coded.withColumn("error", error).drop("_v", "_c")


def embeddings(encoder, vectors: DataFrame, key: str = "subject_id") -> DataFrame:
    """One mean code per subject."""
    return encoder.transform(vectors).groupBy(key).agg(Summarizer.mean(F.col("code")).alias("embedding"))


def projected(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """With x, y: the first two principal components."""
    two = PCA(k=2, inputCol=column, outputCol="_xy").fit(vectors)
    out = two.transform(vectors).withColumn("_xy", vector_to_array("_xy"))
    return out.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]).drop("_xy")
