"""Deterministic splits: rows are ranked by a hash of their id and a seed.

Ranks come from counts per hash range and a window inside each range, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.functions import scalars

#: Ranges of the order for each shuffle partition, so that more of them sort where the cluster has more.
RANGES_PER_PARTITION = 8


def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def arithmetic_order(key: str, seed: int) -> Column:
    """An order that other engines can compute too."""
    return F.pmod(F.col(key) * 7919 + seed, F.lit(10007)).cast("long")


def ranked(df: DataFrame, key: str, order: Column, by: str | None = None) -> DataFrame:
    """df with _rank (from 0, by order and key) and _total, within groups of by if given."""
    groups = ["_g"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")  # null is a group too
    rows = df.withColumn("_g", group).withColumn("_o", order)
    ends = scalars.literals(rows.agg(F.min("_o").alias("_a"), F.max("_o").alias("_b")))
    span = (F.col("_b").cast("double") - F.col("_a").cast("double")) / ranges
    place = F.when(span == 0, 0).otherwise(F.least(F.floor((F.col("_o").cast("double") - F.col("_a").cast("double")) / span), F.lit(ranges - 1))).cast("int")
    rows = rows.withColumns(ends).withColumn("_r", place).drop("_a", "_b")
    counts = rows.groupBy(*groups, "_r").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*groups)
    bases = counts.withColumn("_base", F.sum("_n").over(own.orderBy("_r")) - F.col("_n")).withColumn("_total", F.sum("_n").over(own)).drop("_n")
    inside = Window.partitionBy(*groups, "_r").orderBy("_o", key)
    at = rows.withColumn("_i", F.row_number().over(inside)).join(bases, [*groups, "_r"])  # ranges rows per group, joined by their size
    return at.withColumn("_rank", F.col("_base") + F.col("_i") - 1).drop("_g", "_o", "_r", "_i", "_base")


def random_split(df: DataFrame, key: str = "subject_id", test_size: float = 0.3, seed: int = 42, order: Column | None = None) -> DataFrame:
    """df with is_test: ceil(n * test_size) rows."""
    rows = ranked(df, key, hash_order(key, seed) if order is None else order)
    return rows.withColumn("is_test", F.col("_rank") < F.ceil(F.col("_total") * F.lit(test_size))).drop("_rank", "_total")


def shuffled_split(df: DataFrame, key: str = "subject_id", train_size: float = 0.7, seed: int = 42, overlap: bool = False, order: Column | None = None) -> DataFrame:
    """df with is_train and is_test: the first floor(n * train_size) rows of the shuffle, and the rest. overlap: the row at
    the border is in both."""
    rows = ranked(df, key, hash_order(key, seed) if order is None else order)
    n = F.floor(F.col("_total") * F.lit(train_size))
    return rows.withColumn("is_train", F.col("_rank") <= n if overlap else F.col("_rank") < n).withColumn("is_test", F.col("_rank") >= n).drop("_rank", "_total")


def stratified_exact(df: DataFrame, label: str, n_positive: int, n_negative: int, key: str = "subject_id", seed: int = 42, order: Column | None = None) -> DataFrame:
    """df with is_test: exactly so many rows of each class; raises if a class is too small. label: 0 or 1."""
    have = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if have["p"] < n_positive or have["n"] < n_negative:
        raise ValueError(f"wanted {n_positive} and {n_negative}, have {have['p']} and {have['n']}")
    rows = ranked(df, key, hash_order(key, seed) if order is None else order, by=label)
    wanted = F.when(F.col(label) == 1, n_positive).otherwise(n_negative)
    return rows.withColumn("is_test", F.col("_rank") < wanted).drop("_rank", "_total")


def stratified_capped(df: DataFrame, label: str, train_size: float = 0.7, positive_share: float = 0.5, key: str = "subject_id", seed: int = 42, order: Column | None = None) -> DataFrame:
    """df with is_test: max(1, floor(n (1 - train_size))) rows, positive_share of them positive (rounded half to even),
    but a class of two or more keeps one row for training. Raises if a side is empty."""
    have = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    total = have["p"] + have["n"]
    size = max(1, int(total * (1 - train_size)))
    positive = round(size * positive_share)
    cap = lambda n: n - 1 if n >= 2 else n
    chosen = {1: max(0, min(positive, cap(have["p"]))), 0: max(0, min(size - positive, cap(have["n"])))}
    if not sum(chosen.values()) or sum(chosen.values()) == total:
        raise ValueError("a side of the split is empty")
    rows = ranked(df, key, hash_order(key, seed) if order is None else order, by=label)
    return rows.withColumn("is_test", F.col("_rank") < F.when(F.col(label) == 1, chosen[1]).otherwise(chosen[0])).drop("_rank", "_total")
