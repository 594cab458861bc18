"""Early-warning scores on a stream of observations: stateless columns, so any streaming source takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.functions import scores


def news2_stream(observations: DataFrame) -> DataFrame:
    """observations with score; columns resp_rate, spo2, temp, systolic_bp, heart_rate, oxygen, consciousness."""
    inputs = {name: F.col(name) for name in scores.NEWS2_BANDS}
    return observations.withColumn("score", scores.news2(inputs, F.col("oxygen"), F.col("consciousness")))
