"""Imputation and rank metrics as aggregates.

Scores are grouped first, so a curve has a row per distinct score. Running sums over these rows use a window over score
ranges of about as many distinct scores each and one inside each range, not a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clinspan.functions import scalars
from clinspan.sources import scratch


def fit_means(train: DataFrame, columns: list[str]) -> DataFrame:
    return train.agg(*(F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in columns))


def impute(df: DataFrame, means: DataFrame, columns: list[str]) -> DataFrame:
    """Null cells take their column's mean of the training rows."""
    found = scalars.literals(means)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), found[f"{c}_mean"]) for c in columns})


def curve(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score, from the highest: p (positives), n (rows), tp and seen (running sums), positives, negatives."""
    by = by or []
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    # Ranges are Spark's own, cut by a sample of the scores, so that risks near 0 don't meet in one; the number of a row's
    # range is written with it, since a partition read again may stand elsewhere.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.kept(at.repartitionByRange(parts, *by, F.col("score").desc()).withColumn("_r", F.spark_partition_id()), "curve")
    sums = rows.groupBy(*by, "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_r").alias("_k"), F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bn"), F.sum("_p").over(group).alias("positives"), F.sum(F.col("_n") - F.col("_p")).over(group).alias("negatives"))
    inside = Window.partitionBy(*by, "_r").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("tp", F.sum("p").over(inside)).withColumn("seen", F.sum("n").over(inside))
    # A row for each group and range: Spark joins it by its size.
    out = running.join(bases, [*(F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.col("_r") == F.col("_k")])
    return out.select(*by, "score", "p", "n", (F.col("tp") + F.col("_bp")).alias("tp"), (F.col("seen") + F.col("_bn")).alias("seen"), "positives", "negatives")


def roc_points(points: DataFrame) -> DataFrame:
    """score, fpr, tpr; the point (0, 0) is left to the reader. Null rates where a class is missing."""
    return points.select("score", F.try_divide(F.col("seen") - F.col("tp"), F.col("negatives")).alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def pr_points(points: DataFrame) -> DataFrame:
    return points.select("score", F.try_divide("tp", "positives").alias("recall"), F.try_divide("tp", "seen").alias("precision"))


def rank_metrics(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auroc and auprc (trapezoids), average_precision (steps), prevalence; null where a class is missing.

    Each point's trapezoid needs only itself: the point before it has tp - p positives among seen - n rows.
    """
    by = by or []
    tp0, seen0 = F.col("tp") - F.col("p"), F.col("seen") - F.col("n")
    fp, fp0 = F.col("seen") - F.col("tp"), seen0 - tp0
    precision = F.col("tp") / F.col("seen")
    precision0 = F.when(seen0 == 0, 1.0).otherwise(tp0 / F.when(seen0 != 0, seen0))
    area = F.sum((fp - fp0) * (F.col("tp") + tp0) / 2.0)
    pr = F.sum(F.col("p") * (precision + precision0) / 2.0)
    steps = F.sum(F.col("p") * precision)
    p, n = F.first("positives"), F.first("negatives")
    both = (p > 0) & (n > 0)
    out = points.groupBy(*by) if by else points.groupBy()
    return out.agg(F.when(both, area / p / n).alias("auroc"), F.when(both, pr / p).alias("auprc"), F.when(both, steps / p).alias("average_precision"), (p / (p + n)).alias("prevalence"))


def f1_scan(df: DataFrame, score: str, label: str, thresholds: int = 101) -> DataFrame:
    """threshold, f1 for thresholds 0, 0.01, ... 1; a row counts as positive at score >= threshold.

    One pass: rows are counted by the highest threshold that they reach; the sums over thresholds are of that many rows.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("long")
    known = df.where(s.isNotNull() & y.isNotNull())
    top = thresholds - 1
    guess = F.least(F.greatest(F.floor(s * top), F.lit(-1)), F.lit(top))
    # Thresholds are i / 100 as doubles; the guess may be one off where s * 100 is rounded.
    reach = F.when((guess < top) & (s >= (guess + 1) / F.lit(float(top))), guess + 1).when((guess >= 0) & (s < guess / F.lit(float(top))), guess - 1).otherwise(guess)
    counts = known.groupBy(reach.cast("int").alias("i")).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(-1, thresholds).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").na.fill(0, ["p", "n"])
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # thresholds + 1 rows
    sums = every.withColumn("tp", F.sum("p").over(above)).withColumn("seen", F.sum("n").over(above)).withColumn("positives", F.sum("p").over(Window.partitionBy()))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("seen") + F.col("positives")), F.lit(0.0))
    return sums.where("i >= 0").select((F.col("i") / F.lit(float(top))).alias("threshold"), f1.alias("f1"))


def best_f1(scan: DataFrame) -> DataFrame:
    """The largest f1 and the lowest threshold that has it; (0, 0) if all are 0."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    one = scan.agg(best.alias("b"))
    return one.select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.0).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))
