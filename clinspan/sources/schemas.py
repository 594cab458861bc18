"""Explicit schemas of the tables; nothing is inferred. Times are whole minutes from each subject's own time zero."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _schema(text: str) -> T.StructType:
    """Columns as "name type", between commas; without a session, unlike Spark's own parser."""
    columns = (c.strip().rsplit(" ", 1) for c in text.split(","))
    return T.StructType([T.StructField(name.strip("`"), TYPES[kind]) for name, kind in columns])


OPERATIONS = _schema(
    "op_id long, subject_id long, hadm_id long, case_id long, opdate long, age long, sex string, weight double, height double, "
    "race string, asa int, emop int, department string, antype string, icd10_pcs string, orin_time long, orout_time long, "
    "opstart_time long, opend_time long, admission_time long, discharge_time long, anstart_time long, anend_time long, "
    "cpbon_time long, cpboff_time long, icuin_time long, icuout_time long, inhosp_death_time long, allcause_death_time long"
)
LABS = _schema("subject_id long, chart_time long, item_name string, value double")
VITALS = _schema("op_id long, subject_id long, chart_time long, item_name string, value double")
WARD_VITALS = LABS
DIAGNOSIS = _schema("subject_id long, chart_time long, icd10_cm string")
MEDICATIONS = _schema("subject_id long, chart_time long, drug_name string, route string, drug_name2 string, drug_name3 string, atc_code string, atc_code2 string, atc_code3 string")
PARAMETERS = _schema("`Table` string, Label string, Unit string, Description string")
DEPARTMENT = _schema("Abbreviations string, `Full name` string")
ATC = _schema("atc_code string, atc_name string, ddd double, uom string, adm_r string, note string")

HFRS = _schema("code string, description string, n_dev int, n_frail int, points double, pct_dev double, pct_frail double")

TABLES = {"operations": OPERATIONS, "labs": LABS, "vitals": VITALS, "ward_vitals": WARD_VITALS, "diagnosis": DIAGNOSIS, "medications": MEDICATIONS, "parameters": PARAMETERS, "department": DEPARTMENT}

#: A subject's document: its rows of six tables.
DOCUMENT = T.StructType(
    [T.StructField("subject_id", T.LongType())]
    + [T.StructField(name, T.ArrayType(T.StructType([f for f in TABLES[table].fields if f.name != "subject_id"]))) for name, table in (("labs", "labs"), ("vitals", "vitals"), ("operations", "operations"), ("ward_vitals", "ward_vitals"), ("diagnoses", "diagnosis"), ("medications", "medications"))]
)
VITAL_STATS = _schema("item_name string, mean double, stdev double, median double, mad double, length long")
