"""Small dimensions as DataFrames; their sizes are fixed, so joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinspan.functions import codes


def hfrs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.hfrs_points(), "code string, points double")


def icd_chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.chapters(), "place int, chapter string, block string, first_code string, last_code string, title string")


def vital_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in codes.vital_names()], "item_name string")


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.departments(), "department string, full_name string, of_interest boolean")
