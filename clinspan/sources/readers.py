"""Readers: CSV with fixed schemas, subject documents in labelled folders, dimensions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas, scratch, sinks


def read_text_table(spark: SparkSession, path: str, subjects: DataFrame | None = None) -> DataFrame:
    """All columns as text. subjects (subject_id): only rows of these, by a semi join next to the scan."""
    df = spark.read.option("header", True).csv(path)
    if subjects is None:
        return df
    keys = subjects.select(F.col("subject_id").cast("string")).distinct()
    return df.join(keys, "subject_id", "left_semi")


def read_table(spark: SparkSession, path: str, table: str, corrupt: bool = False) -> DataFrame:
    """A table by its explicit schema; blank cells are null, blanks around numbers are ignored, NaN is null.

    corrupt: rows that don't fit come with their text in _corrupt_record instead of nulls alone.
    """
    schema = schemas.TABLES[table]
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.csv(path)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


#: The columns of a row's place in file order.
PLACE = ("file", "block", "row")


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """_ord: the place in file order, where results depend on it. keys: columns of the data that give it (op_id, event_id).

    Without any, df has to be as a reader gave it (columns may have been added): _ord is (file, block, row), by the file's
    path, the place of the row's block in the file and the number of the row among those of its block's task. Files stand in
    the order of their paths, rows as in their file, and the order is the same however files are cut into blocks; only the
    numbers aren't. One pass, no shuffle."""
    if keys:
        return df.withColumn("_ord", F.struct(*keys) if len(keys) > 1 else F.col(keys[0]))
    row = F.monotonically_increasing_id()
    try:
        df.select("_metadata.file_path")
    except AnalysisException:  # rows of no file stand as their partitions do
        return df.withColumn("_ord", row)
    at = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), row)
    return df.withColumn("_ord", F.struct(*(c.alias(name) for c, name in zip(at, PLACE, strict=True))))


def numbered(df: DataFrame, across: bool = False) -> DataFrame:
    """df of ``with_order`` with _row, from 0 in each file (across: over all files): the same for every cut into blocks.

    df is written once, since rows have to stand as they did when they were counted; then one row a block (file, first row,
    how many rows came before) is joined to its rows."""
    rows = scratch.kept(df, "ordered")
    blocks = rows.groupBy("_ord.file", "_ord.block").agg(F.min("_ord.row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy("file", "block") if across else Window.partitionBy("file").orderBy("block")  # a row for each block
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.kept(blocks.select("file", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "blocks")
    on = (rows["_ord.file"] == bases["file"]) & (rows["_ord.block"] == bases["block"])
    return rows.join(bases, on).withColumn("_row", F.col("_ord.row") + F.col("_shift")).drop("file", "block", "_shift")


def first_rows(df: DataFrame, k: int) -> DataFrame:
    """The first k rows of df in file order, with place (from 1): each task keeps its first k, one meets those."""
    ordered = with_order(df)
    first = ordered.orderBy("_ord").limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_ord")).cast("long")).drop("_ord")


def read_documents(spark: SparkSession, path: str, pretty: bool = False, paragraphs: bool = False) -> DataFrame:
    """Subject documents below path, at any depth; label 1 or 0 from a folder died or survived (or outcome=...), else null.
    pretty: a file holds one document over many lines, or an array of such; paragraphs: many, with an empty line between two;
    else each line is one."""
    reader = spark.read.schema(schemas.DOCUMENT).option("recursiveFileLookup", True).option("multiLine", pretty)
    df = (reader.option("lineSep", sinks.PARAGRAPH) if paragraphs else reader).json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:outcome=)?(died|survived)/", 1)
    return df.withColumn("label", F.when(folder == "died", 1).when(folder == "survived", 0))


def first_parameters(parameters: DataFrame) -> DataFrame:
    """label, unit, description: of rows with one label, the first by _ord."""
    first = Window.partitionBy("Label").orderBy("_ord")
    return parameters.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("Label").alias("label"), F.col("Unit").alias("unit"), F.col("Description").alias("description"))


def read_atc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ATC).option("header", True).csv(path).select("atc_code", "atc_name")


def read_hfrs(spark: SparkSession, path: str) -> DataFrame:
    """The published frailty table with all its columns; scores need code and points alone (``dimensions.hfrs``)."""
    return spark.read.schema(schemas.HFRS).option("header", True).csv(path)


def read_icd(spark: SparkSession, path: str) -> DataFrame:
    """code, billable, description of a JSON object code -> [billable, description], gzip or plain."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("code", "v"))
    return pairs.select("code", F.col("v")[0].cast("boolean").alias("billable"), F.col("v")[1].alias("description"))


def read_excluded_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """prefix, cause: the comma lists of the first column, one row for each code prefix."""
    df = spark.read.schema("codes string, cause string").option("header", True).csv(path)
    return df.select(F.explode(F.split(F.trim("codes"), r"\s*,\s*")).alias("prefix"), "cause").where("prefix <> ''")


def read_vital_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VITAL_STATS).json(path)
