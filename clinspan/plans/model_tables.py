"""Fitted models as tables: coefficients, tree nodes and components as rows, and scores from these rows alone.

A table of a model can be stored, compared and used without the library that fitted it. Scores are column expressions or
joins with the rows; what a fit has to fulfil (no slope left at a regression's optimum) is one aggregate over its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspan.operators.series import on_grid

INTERCEPT = "(intercept)"


def coefficients(model, columns: list[str], spark) -> DataFrame:
    """feature, coefficient of a fitted logistic regression; the intercept's row is (intercept)."""
    rows = [*zip(columns, map(float, model.coefficients.toArray()), strict=True), (INTERCEPT, float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def linear_score(table: DataFrame, columns: list[str]) -> Column:
    """The probability of a row of columns, by the table's coefficients (as many as columns)."""
    found = {r["feature"]: r["coefficient"] for r in table.toLocalIterator()}
    margin = sum((F.col(c).cast("double") * F.lit(found[c]) for c in columns), F.lit(found[INTERCEPT]))
    return 1 / (1 + F.exp(-margin))


def slopes(rows: DataFrame, table: DataFrame, columns: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """feature, slope, scale, n: how the penalised loss (sum of weighted log losses and half the squared coefficients) still
    changes with each coefficient, and the sum of the absolute parts of that slope. One aggregate over all rows."""
    found = {r["feature"]: r["coefficient"] for r in table.toLocalIterator()}
    w = F.col(weight) if weight else F.lit(1.0)
    miss = w * (linear_score(table, columns) - F.col(label).cast("double"))
    parts = {c: miss * F.col(c).cast("double") for c in columns} | {INTERCEPT: miss}
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.sum(p).alias("s"), F.sum(F.abs(p)).alias("a")).alias(c) for c, p in parts.items()))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`.s") + F.lit(found[c] if c != INTERCEPT else 0.0)).alias("slope"), F.col(f"`{c}`.a").alias("scale"), F.col("n").alias("n")) for c in parts))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def tree_nodes(model, path: str, spark) -> DataFrame:
    """tree, node, feature (its place), threshold, lower, upper (nodes), prediction, weight of fitted boosted trees, as the
    model's own files at path have them. Leaves have no feature. All splits are of numbers."""
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    inner = F.col("leftChild") >= 0
    pick = lambda c: F.when(inner, c)
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), pick(F.col("split.featureIndex")).alias("feature"), pick(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        pick(F.col("leftChild")).alias("lower"), pick(F.col("rightChild")).alias("upper"), "prediction", "weight",
    )


def tree_scores(rows: DataFrame, nodes: DataFrame, features: Column, depth: int, *keep: str) -> DataFrame:
    """keep and score: the probability by the trees of ``tree_nodes``. features: an array of doubles.

    Every row starts at every tree's root and goes down one level with each join; then leaves are added up for each row.
    nodes: a few thousand rows, joined by their size."""
    at = rows.select(*keep, features.alias("_f")).withColumn("_id", F.monotonically_increasing_id())
    roots = nodes.where("node = 0").select("tree").distinct().agg(F.sort_array(F.collect_list("tree")).alias("_trees"))
    at = at.join(F.broadcast(roots)).withColumn("tree", F.explode("_trees")).withColumn("node", F.lit(0)).drop("_trees")  # one row, an array of tree numbers
    for _ in range(depth):
        step = F.when(F.col("lower").isNull(), F.col("node")).when(F.get("_f", F.col("feature")) <= F.col("threshold"), F.col("lower")).otherwise(F.col("upper"))
        at = at.join(nodes.select("tree", "node", "feature", "threshold", "lower", "upper"), ["tree", "node"]).select(*keep, "_id", "_f", "tree", step.alias("node"))
    leaves = at.join(nodes.select("tree", "node", (F.col("weight") * F.col("prediction")).alias("_p")), ["tree", "node"])
    return leaves.groupBy("_id", *keep).agg((1 / (1 + F.exp(-2 * F.sum("_p")))).alias("score")).drop("_id")


def covariance(vectors: DataFrame, column: str, dimensions: int) -> np.ndarray:
    """The sample covariance of an array column, as a parameter of dimensions x dimensions: one aggregate over the rows, whose
    sums are those of each pair of places, about the rows' mean."""
    mean = vectors.agg(*(F.avg(F.get(column, F.lit(i))).alias(f"m{i}") for i in range(dimensions))).first()
    centred = F.transform(F.arrays_zip(F.col(column).alias("v"), F.array(*(F.lit(float(x)) for x in mean)).alias("m")), lambda x: x["v"] - x["m"])
    rows = vectors.select(centred.alias("_v")).select(F.posexplode("_v").alias("i", "a"), "_v")
    sums = rows.groupBy("i").agg(*(F.sum(F.col("a") * F.get("_v", F.lit(j))).alias(f"s{j}") for j in range(dimensions)), F.count(F.lit(1)).alias("n"))
    out = np.zeros((dimensions, dimensions))
    for r in sums.toLocalIterator():
        out[r["i"]] = [r[f"s{j}"] / max(1, r["n"] - 1) for j in range(dimensions)]
    return (out + out.T) / 2


def components(covariances: np.ndarray, k: int, spark) -> DataFrame:
    """component (from 1), place, loading, variance, share (of all variance): the first k principal components as rows."""
    values, vectors = np.linalg.eigh(covariances)
    total = float(values.sum())
    rows = [(c + 1, i, float(vectors[i, -1 - c]), float(values[-1 - c]), float(values[-1 - c]) / total) for c in range(k) for i in range(len(values))]
    return spark.createDataFrame(rows, "component int, place int, loading double, variance double, share double")


def coded(vectors: DataFrame, table: DataFrame, column: str, k: int) -> DataFrame:
    """vectors with code: their products with each component, and error: the mean squared rest. A component's sign is free, so
    is a code's."""
    loads: dict[int, list[float]] = {}
    for r in table.orderBy("component", "place").toLocalIterator():
        loads.setdefault(r["component"], []).append(r["loading"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(column)
    codes = F.array(*(dot(v, F.array(*(F.lit(x) for x in loads[c + 1]))) for c in range(k)))
    out = vectors.withColumn("code", codes)
    return out.withColumn("error", (dot(v, v) - dot(F.col("code"), F.col("code"))) / F.size(column))


def same_scores(by_table: DataFrame, by_model: DataFrame, key: str, within: float = 1e-9) -> DataFrame:
    """key, label, same: whether both scores of a row are equal."""
    return by_model.join(by_table.select(key, F.col("score").alias("_s")), key).select(key, "label", (F.abs(F.col("score") - F.col("_s")) <= within).alias("same"))


def as_array(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn(column, vector_to_array(column))


def window_covariance(series: DataFrame | None, items: list[str], step: int, length: int, **settings) -> np.ndarray:
    """The sample covariance of the aligned series' windows of length grid points, side by side as vectors (as
    ``model.window_vectors``: step by step, items and then masks).

    Windows aren't written out, not even in a task: the products of two places are those of a point and the one lag points on.
    From one place to the next a slice's sum loses its first product and gets one more. A column of ones gives sums and counts."""
    names = _columns(items)
    m = len(names) + 1

    def sums(s):
        x = np.stack([*(s.columns[c] for c in names), np.ones(s.size.sum())])
        n = _windows(s, length)
        begins = x * (s.places() < np.repeat(n, s.size))
        at, n = s.at[n > 0], n[n > 0]
        found = []
        for lag in range(length if len(n) else 0):
            total = begins[:, : x.shape[1] - lag] @ x[:, lag:].T
            for a in range(length - lag):
                found.append(((lag * length + a) * m * m + np.arange(m * m), total.ravel()))
                if a + lag + 1 < length:
                    total = total - x[:, at + a] @ x[:, at + a + lag].T + x[:, at + a + n] @ x[:, at + a + n + lag].T
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["cell", "total"])

    found = on_grid(series, items, step, sums, "cell long, total double", overlap=length - 1, **settings)
    out = np.zeros((length, m, length, m))
    for cell, total in found.groupBy("cell").agg(F.sum("total")).collect():  # as many as pairs of places, a parameter
        lag, a, i, j = np.unravel_index(cell, (length, length, m, m))
        out[a, i, a + lag, j] = out[a + lag, j, a, i] = total
    n = max(1.0, out[0, -1, 0, -1])
    mean = np.stack([out[a, :-1, a, -1] for a in range(length)]).ravel() / n
    size = len(mean)
    products = (out[:, :-1, :, :-1].reshape(size, size) - n * np.outer(mean, mean)) / max(1, n - 1)
    return (products + products.T) / 2


def window_codes(series: DataFrame | None, items: list[str], step: int, length: int, table: DataFrame, k: int, **settings) -> DataFrame:
    """subject_id, embedding (its windows' mean code by the table of ``components``), error (the mean squared rest of a
    window) and n_windows. Codes are sums of each place's part, without the windows."""
    names = _columns(items)
    loads = np.zeros((len(names) * length, k))
    for r in table.toLocalIterator():
        loads[r["place"], r["component"] - 1] = r["loading"]
    loads = loads.reshape(length, len(names), k)

    def sums(s):
        n = _windows(s, length)
        if not n.any():
            return
        x = np.stack([s.columns[c] for c in names])
        squares = (x * x).sum(axis=0)
        until = x.shape[1] - length + 1
        (at,) = np.nonzero(s.places() < np.repeat(n, s.size))
        code = sum(loads[a].T @ x[:, a : a + until] for a in range(length))[:, at]
        error = (sum(squares[a : a + until] for a in range(length))[at] - (code * code).sum(axis=0)) / loads[:, :, 0].size
        add = lambda v: np.add.reduceat(v, (np.cumsum(n) - n)[n > 0])
        yield pa.RecordBatch.from_arrays([pa.array(s.subject[n > 0]), pa.array(n[n > 0]), pa.array(add(error)), *(pa.array(add(c)) for c in code)], names=["subject_id", "n", "e", *(f"c{j}" for j in range(k))])

    schema = "subject_id long, n long, e double, " + ", ".join(f"c{j} double" for j in range(k))
    own = on_grid(series, items, step, sums, schema, overlap=length - 1, **settings).groupBy("subject_id")
    n = F.sum("n")
    return own.agg(F.array(*(F.sum(f"c{j}") / n for j in range(k))).alias("embedding"), (F.sum("e") / n).alias("error"), n.alias("n_windows"))


def _columns(items: list[str]) -> list[str]:
    return [*items, *(f"{i}_mask" for i in items)]


def _windows(s, length: int) -> np.ndarray:
    """How many windows begin in each slice: at its first points."""
    return np.maximum(0, np.minimum(s.own, s.size - length + 1)).astype("int64")
