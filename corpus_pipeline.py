"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to documents. All but the last return
the columns of documents (doc_id, text, lang, source, n_chars). Rows without an id, null texts, repeated rows and empty
tables pass as the operators' docstrings say; further columns of docs are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clinspan.llm import mixing, packing, secret_scan, simhash, toxicity
from clinspan.llm._common import fresh_dir, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the model is fitted on labelled rows of the corpus."""
    rows, population = toxicity.training_rows(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(_own(docs), toxicity.fit(rows, population=population))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more): the one with the
    smallest doc_id, of repeated rows the first by text. Rows without an id stay, since no id could name them as a copy."""
    return simhash.keep_first(_own(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark, other texts stay as they are."""
    return secret_scan.redact_documents(_own(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each round that takes it, cut to the words taken where a source's last block ends in it."""
    return mixing.mixed_documents(_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row of docs: its sequence and place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Toxicity, SimHash near-duplicates, secret scans, mixing of sources, best-fit packing.
STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixed), ("packing", packed)]

#: Scores and SimHash links aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
