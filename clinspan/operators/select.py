"""Subjects, operations and events: choosing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440


def of_subjects(events: DataFrame, operations: DataFrame, key: str = "subject_id") -> DataFrame:
    """Events whose subject has an operation."""
    return events.join(operations.select(key), key, "left_semi")


def one_row(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the given order; ties beyond it are broken by no rule, so orders should be total."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def lowest_operation(operations: DataFrame) -> DataFrame:
    """The operation of the smallest op_id of each subject."""
    return one_row(operations, "subject_id", F.col("op_id"))


def first_operation(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    """By orin_time; of equal times the later row in file order."""
    return one_row(operations.where("orin_time is not null"), "subject_id", F.col("orin_time"), F.col(ord_col).desc())


def last_operation(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    return one_row(operations.where("orin_time is not null"), "subject_id", F.col("orin_time").desc(), F.col(ord_col).desc())


def last_in_file(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    return one_row(operations, "subject_id", F.col(ord_col).desc())


def operation_ends(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    """subject_id, first, last (structs of the operation's columns): one aggregate, combined before the shuffle."""
    own = F.struct(*operations.columns)
    timed = operations.where("orin_time is not null")
    return timed.groupBy("subject_id").agg(
        F.max_by(own, F.struct(-F.col("orin_time"), F.col(ord_col))).alias("first"),
        F.max_by(own, F.struct("orin_time", ord_col)).alias("last"),
    )


def died_30_days(operations: DataFrame, minutes: int = 30 * MINUTES_PER_DAY, ord_col: str = "_ord") -> DataFrame:
    """subject_id, died: the first operation's death time against the last one's orout_time + minutes."""
    ends = operation_ends(operations, ord_col)
    return ends.select("subject_id", F.coalesce(F.col("first.inhosp_death_time") < F.col("last.orout_time") + minutes, F.lit(False)).alias("died"))


def ever_died(operations: DataFrame) -> DataFrame:
    """subject_id, died: any operation has a time of death in hospital."""
    return operations.groupBy("subject_id").agg(F.bool_or(F.col("inhosp_death_time").isNotNull()).alias("died"))


def age_at_last_operation(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    return last_operation(operations, ord_col).select("subject_id", "age")


def scheduled_for_score(operations: DataFrame) -> DataFrame:
    """asa below 6; rows without it go too."""
    return operations.where(F.col("asa") < 6)


def before_operation(events: DataFrame, operations: DataFrame, days: int = 5) -> DataFrame:
    """Events of the days before an operation: orin_time - days <= chart_time <= orin_time - 1. operations: one per subject."""
    until = operations.select("subject_id", "orin_time")
    joined = events.join(until, "subject_id")
    return joined.where(F.col("chart_time").between(F.col("orin_time") - days * MINUTES_PER_DAY, F.col("orin_time") - 1)).drop("orin_time")


def every_item(subjects: DataFrame, items: list[str]) -> DataFrame:
    """subject_id, item_name: each subject once with each of the caller's items."""
    return subjects.select("subject_id").distinct().select("subject_id", F.explode(F.array(*map(F.lit, items))).alias("item_name"))


def item_grid(subjects: DataFrame, items: list[str], events: DataFrame) -> DataFrame:
    """subject_id, item_name, n: a row for every subject and wanted item, n = 0 where it has no events."""
    counts = events.where(F.col("item_name").isin(items)).groupBy("subject_id", "item_name").agg(F.count("value").alias("n"))
    return every_item(subjects, items).join(counts, ["subject_id", "item_name"], "left").na.fill(0, ["n"])


def with_evidence(events: DataFrame, least: int = 2) -> DataFrame:
    """Events of subjects that have at least so many observations."""
    enough = events.groupBy("subject_id").count().where(F.col("count") >= least).select("subject_id")
    return events.join(enough, "subject_id", "left_semi")


def last_value(events: DataFrame, ord_col: str = "_ord", keys: tuple[str, ...] = ("subject_id", "item_name", "chart_time")) -> DataFrame:
    """keys and value: of repeated observations the last in file order."""
    return events.groupBy(*keys).agg(F.max_by("value", ord_col).alias("value"))


def operation_ordinals(operations: DataFrame, ord_col: str = "_ord") -> DataFrame:
    """With ordinal (from 1, by orin_time) and n_operations of the subject."""
    own = Window.partitionBy("subject_id")
    return operations.withColumn("ordinal", F.row_number().over(own.orderBy("orin_time", ord_col)).cast("long")).withColumn("n_operations", F.count(F.lit(1)).over(own))
