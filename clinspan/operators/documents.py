"""Nested subject documents from long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nest(subjects: DataFrame, tables: dict[str, DataFrame], key: str = "subject_id") -> DataFrame:
    """One row per subject with an array of each table's rows (empty where it has none), in order of their columns.

    Tables are united as tagged rows and collected in one aggregate, so one shuffle on the subject serves all of them.
    """
    own = lambda df: F.struct(*(c for c in df.columns if c != key)).cast(row_type(df, key))
    nested = nest_rows([df.select(key, own(df).alias(name)) for name, df in tables.items()], key)
    empty = {n: F.coalesce(F.col(n), F.array().cast(nested.schema[n].dataType)) for n in tables}
    return subjects.select(key).distinct().join(nested, key, "left").withColumns(empty)


def nest_rows(rows: list[DataFrame], key: str = "subject_id") -> DataFrame:
    """One row per subject with an array of each struct column's values, in their order, nulls left out. A row may hold
    several structs, or one of several, so that what is read, joined or dealt once gives entries of more than one array.

    Rows that are dealt by the key already (a join, a window or ``repartition`` on it) stay where they are.
    """
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return every.groupBy(key).agg(*(F.array_sort(F.collect_list(n)).alias(n) for n in every.columns if n != key))


def row_type(df: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != key])


def with_outcome(documents: DataFrame, died: DataFrame) -> DataFrame:
    """With outcome died or survived, from (subject_id, died)."""
    flags = died.select("subject_id", F.when(F.col("died"), "died").otherwise("survived").alias("outcome"))
    return documents.join(flags, "subject_id", "left").na.fill("survived", ["outcome"])


def of_subjects(nested: DataFrame, name: str, death: str, key: str = "subject_id") -> DataFrame:
    """Documents of the subjects with entries of name, with outcome died where one of these has a time of death, else survived.
    As in joins on the key, no rows belong to a null one: its document is empty."""
    arrays = {n: F.when(F.col(key).isNotNull(), F.col(n)).otherwise(F.array().cast(nested.schema[n].dataType)) for n in nested.columns if n != key}
    died = F.exists(name, lambda x: x[death].isNotNull())
    return nested.where(F.size(name) > 0).withColumns(arrays).withColumn("outcome", F.when(died, "died").otherwise("survived"))


def unnest(documents: DataFrame, name: str, key: str = "subject_id") -> DataFrame:
    """The long table again."""
    return documents.select(key, F.explode(name).alias("x")).select(key, "x.*")
