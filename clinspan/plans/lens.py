"""Clinical tables as arithmetic over order, event and line-item tables, in Spark and as SQL for other engines.

The expressions are portable; only the difference in minutes is spelled per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspan.functions import codes

DEPARTMENTS = [d[0] for d in codes.departments()]
#: Sources of the series, by item.
SOURCES = {"labs": ("view", "signup"), "ward_vitals": ("error", "click"), "vitals": ("purchase",)}
ITEMS = ("view", "signup", "error", "click", "purchase")
DX = ("F05", "N39", "R29", "A41", "I10", "C50", "E11", "R00", "w19", "S72.0")
ATC_CODES = ("M01AE01", "G03AC", "A01AA01", "N02BE01", "J01CA04", "0BAD", "C09AA02", "M01")
#: A part of the drug hierarchy, enough for the codes above but for one level.
ATC_NAMES = {
    "M": "musculo-skeletal system", "M01": "antiinflammatory products", "M01A": "non-steroids", "M01AE": "propionic acid derivatives", "M01AE01": "ibuprofen",
    "G": "genito-urinary system", "G03": "sex hormones", "G03A": "hormonal contraceptives", "G03AC": "progestogens",
    "A": "alimentary tract", "A01": "stomatological preparations", "A01A": "stomatological preparations", "A01AA": "caries prophylactic agents", "A01AA01": "sodium fluoride",
    "N": "nervous system", "N02": "analgesics", "N02B": "other analgesics", "N02BE": "anilides", "N02BE01": "paracetamol",
    "J": "antiinfectives", "J01": "antibacterials", "C": "cardiovascular system", "C09": "renin-angiotensin agents", "C09A": "ace inhibitors",
}


def _minutes(engine: str, column: str, base: str) -> str:
    return f"timestampdiff(MINUTE, TIMESTAMP_NTZ'{base}', {column})" if engine == "spark" else f"date_diff('minute', TIMESTAMP '{base}', {column})"


def _list(engine: str, values, index: str) -> str:
    text = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({text}), CAST({index} + 1 AS INT))" if engine == "spark" else f"([{text}])[CAST({index} + 1 AS INT)]"


def _operations(engine: str) -> tuple[list[str], list[str]]:
    first = ["o_orderkey AS op_id", "o_custkey AS subject_id", "o_orderpriority", f"{_minutes(engine, 'o_orderdate', '1995-01-01')} AS orin_time"]
    then = [
        "op_id", "subject_id", "orin_time", "orin_time + 60 + op_id % 300 AS orout_time", "orin_time + 15 AS opstart_time", "orin_time + 45 + op_id % 300 AS opend_time",
        "CASE WHEN op_id % 19 = 0 THEN NULL ELSE orin_time + 10 END AS anstart_time", "orin_time + 50 + op_id % 300 AS anend_time",
        "20 + subject_id % 70 AS age", "CASE WHEN subject_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex", "CAST(o_orderpriority = '1-URGENT' AS INT) AS emop",
        "CASE WHEN op_id % 17 = 0 THEN NULL ELSE 1 + op_id % 6 END AS asa", "CASE WHEN op_id % 13 = 0 THEN NULL ELSE 45 + subject_id % 60 END AS weight",
        "CASE WHEN op_id % 97 = 0 THEN 10 ELSE 140 + subject_id % 50 END AS height", f"{_list(engine, DEPARTMENTS, 'subject_id % 16')} AS department",
        f"{_list(engine, ('General', 'Neuraxial', 'MAC'), 'op_id % 3')} AS antype",
        "CASE WHEN subject_id % 11 = 0 THEN max(orin_time) OVER (PARTITION BY subject_id) + (subject_id % 90) * 1440 END AS inhosp_death_time", "op_id AS _ord",
    ]
    return first, then


def _series(engine: str) -> list[str]:
    return ["user_id AS subject_id", f"last_orin - 43200 + {_minutes(engine, 'ts', '2024-01-01')} AS chart_time", "event_type AS item_name", "value", "event_id AS _ord"]


def _diagnosis(engine: str) -> list[str]:
    return ["o_custkey AS subject_id", f"{_minutes(engine, 'l_shipdate', '1995-01-01')} AS chart_time", f"{_list(engine, DX, 'l_partkey % 10')} AS icd10_cm", "l_orderkey * 10 + l_linenumber AS _ord"]


def _medications(engine: str) -> list[str]:
    return [
        "o_custkey AS subject_id", f"{_minutes(engine, 'l_shipdate', '1995-01-01')} AS chart_time", "concat('drug', CAST(l_partkey % 20 AS VARCHAR(20))) AS drug_name",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'arginine' END AS drug_name2", "CASE WHEN l_linenumber % 4 = 0 THEN 'saline' END AS drug_name3",
        f"{_list(engine, ATC_CODES, 'l_suppkey % 8')} AS atc_code", "CASE WHEN l_linenumber % 2 = 0 THEN 'B05XB01' END AS atc_code2", "CASE WHEN l_linenumber % 4 = 0 THEN 'B05XA03' END AS atc_code3",
        "l_orderkey * 10 + l_linenumber AS _ord",
    ]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, then = _operations("spark")
    return read(spark, sf_dir, "orders").selectExpr(*first).selectExpr(*then)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = _minutes("spark", "o_orderdate", "1995-01-01")
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max(F.expr(minutes)).alias("last_orin"))
    return read(spark, sf_dir, "events").join(last, "user_id").selectExpr(*_series("spark"))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return series(spark, sf_dir).where(F.col("item_name").isin(*SOURCES[name]))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: source(spark, sf_dir, name) for name in SOURCES}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(*_diagnosis("spark"))


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(*_medications("spark"))


def lines(spark: SparkSession, sf_dir: str, **columns: tuple[str, ...]) -> DataFrame:
    """Line items dealt by subject, each with these columns of the diagnosis and of the medication made of it, as structs: joined
    and shuffled once for both, as numbers."""
    rows = _lines(spark, sf_dir).repartition("o_custkey")
    views = {"diagnosis": _diagnosis("spark"), "medication": _medications("spark")}
    made = (F.struct(*(F.expr(e) for e in views[v] if e.rsplit(" AS ", 1)[1] in names)).alias(v) for v, names in columns.items())
    return rows.select(F.col("o_custkey").alias("subject_id"), *made)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with conflicting units, from parts: the table of labels grows with it."""
    return read(spark, sf_dir, "part").selectExpr("p_brand AS Label", "p_type AS Unit", "p_name AS Description", "p_partkey AS _ord")


def _subquery(select: list[str], of: str) -> str:
    return f"SELECT {', '.join(select)} FROM {of}"


_FIRST, _THEN = _operations("duckdb")
#: The views as common table expressions.
SQL = f"""
WITH operations_v AS ({_subquery(_THEN, f"({_subquery(_FIRST, 'orders')})")}),
series_v AS ({_subquery(_series("duckdb"), f"events JOIN (SELECT o_custkey AS user_id, max({_minutes('duckdb', 'o_orderdate', '1995-01-01')}) AS last_orin FROM orders GROUP BY 1) USING (user_id)")}),
labs_v AS (SELECT * FROM series_v WHERE item_name IN ('view', 'signup')),
ward_vitals_v AS (SELECT * FROM series_v WHERE item_name IN ('error', 'click')),
vitals_v AS (SELECT * FROM series_v WHERE item_name = 'purchase'),
lines_v AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
diagnosis_v AS ({_subquery(_diagnosis("duckdb"), "lines_v")}),
medications_v AS ({_subquery(_medications("duckdb"), "lines_v")}),
parameters_v AS (SELECT p_brand AS label, p_type AS unit, p_name AS description, p_partkey AS _ord FROM part),
first_v AS (SELECT * FROM operations_v QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY orin_time, _ord DESC) = 1),
last_v AS (SELECT * FROM operations_v QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY orin_time DESC, _ord DESC) = 1),
dedup_v AS (SELECT subject_id, item_name, chart_time, arg_max(value, _ord) AS value FROM series_v GROUP BY ALL),
stats_v AS (SELECT item_name, avg(value) AS mean, stddev_samp(value) AS stdev, median(value) AS median, mad(value) AS mad, count(value) AS length FROM dedup_v GROUP BY 1 HAVING count(value) >= 2)
"""
