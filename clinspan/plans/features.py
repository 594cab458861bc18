"""The pre-operative feature table: one plan from operations and laboratory values to a row per subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.functions import codes, scalars
from clinspan.operators import asof, select

OUTCOME = "inhosp_death_30day"
TOLERANCE = scalars.MONTHS_6


def feature_names(items=codes.PREOP_LABS) -> list[str]:
    return ["age", "sex", "emop", "bmi", "andur", *(f"preop_{i}" for i in items)]


def preop_features(operations: DataFrame, labs: DataFrame, items=codes.PREOP_LABS, by_op_id: bool = False, tolerance: int | None = TOLERANCE, label: str = "table", bmi: str = "table", keep: tuple[str, ...] = ()) -> DataFrame:
    """subject_id, the features, the outcome and the columns of keep.

    by_op_id: the operation of the smallest op_id, else the first by orin_time. label: "table" takes death and discharge
    from that operation, "subject" the first operation's death against the last one's discharge. bmi: "table" or "subject",
    which differ in the heights that they accept. tolerance None: however old the value is.
    """
    chosen = select.lowest_operation(operations) if by_op_id else select.first_operation(operations)
    if label == "subject":
        outcome = select.died_30_days(operations).withColumnRenamed("died", OUTCOME)
        chosen = chosen.join(outcome, "subject_id")
    else:
        chosen = chosen.withColumn(OUTCOME, scalars.died_within(F.col("inhosp_death_time"), F.col("orout_time")))
    chosen = select.scheduled_for_score(chosen)
    index = scalars.bmi_of_table if bmi == "table" else scalars.bmi_of_subject
    base = chosen.select(
        "subject_id", "orin_time", "age", scalars.sex_is_male(F.col("sex")).alias("sex"), "emop",
        index(F.col("weight"), F.col("height")).alias("bmi"),
        scalars.minutes_between(F.col("anstart_time"), F.col("anend_time")).alias("andur"), *keep, OUTCOME,
    )
    wide = asof.asof_items(base, labs, list(items), "orin_time", tolerance)
    return wide.select("subject_id", *feature_names(items), *keep, OUTCOME)
