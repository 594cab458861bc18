"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is joined by a broadcast of such keys: at most one of them for so many rows.
HOT_ROWS = 1_000_000
#: Any key of a text that is null is read as the empty text.
EMPTY = ""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones: other columns, whatever their names, are left out of the scan."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit(EMPTY)).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; a temporary one only where it is unset (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "") or ""
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from those files, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, prefix: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def join_copies(rows: DataFrame, facts: DataFrame, key: str, copies: str = "copies", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with facts (one row per key, how many rows have it as ``copies``) on key. Keys of very many rows, a few at
    most, meet their rows by a broadcast, so that no task takes all copies of one text; the others by a shuffle."""
    hot, cold = facts.where(F.col(copies) > hot_rows).drop(copies), facts.where(F.col(copies) <= hot_rows).drop(copies)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))
