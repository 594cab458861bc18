"""Sinks: Spark writers only, so that a lost task is written again and a job commits whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, partitioned by outcome (died or survived). A compressed file (gzip) is read by one task, as it was written."""
    documents.write.mode("overwrite").option("compression", compression).partitionBy("outcome").json(path)


#: Between indented documents of one file: an empty line, which no document has inside.
PARAGRAPH = "\n\n"


def write_pretty_documents(documents: DataFrame, path: str, one_file_each: bool = True) -> None:
    """Documents indented over many lines, in a folder for each outcome: for people and other programs to open. A file of its
    own for each document, or, as large tables need, one for all of a task's, with an empty line between two."""
    text = F.to_json(F.struct(*(c for c in documents.columns if c != "outcome")), {"pretty": "true"}).alias("text")
    writer = documents.select("outcome", text).write.mode("overwrite").partitionBy("outcome")
    (writer.option("maxRecordsPerFile", 1) if one_file_each else writer.option("lineSep", PARAGRAPH).option("compression", "gzip")).text(path)


def write_feature_table(features: DataFrame, path: str, as_parquet: bool = False) -> None:
    writer = features.write.mode("overwrite")
    writer.parquet(path) if as_parquet else writer.option("header", True).csv(path)


def write_vital_stats(stats: DataFrame, path: str) -> None:
    """One JSON row per item."""
    stats.write.mode("overwrite").json(path)


def write_counters(counts: DataFrame, path: str) -> None:
    """Item counts, one folder per source."""
    counts.write.mode("overwrite").partitionBy("source").json(path)


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """df as Parquet files in the order of keys: of ranges that Spark cuts by a sample, each sorted; the names of the files
    rise with the ranges, so ``readers.with_order`` reads the whole order."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: str = "subject_id", sort: tuple[str, ...] = ("item_name", "chart_time"), buckets: int = 64) -> DataFrame:
    """df as a table of so many buckets by a column, each sorted, registered as name at path: groupings, windows and as-of
    joins by that column read it without an exchange. One shuffle, once."""
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(*sort).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
