"""Clinical scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of the early-warning score by closed bands (low, high, points); None is open. Values between two bands score 0
# (fixed values).
NEWS2_BANDS = {
    "resp_rate": ((None, 8, 3), (9, 11, 1), (21, 24, 2), (25, None, 3)),
    "spo2": ((None, 91, 3), (92, 93, 2), (94, 95, 1)),
    "temp": ((None, 35.0, 3), (35.1, 36.0, 1), (38.1, 39.0, 1), (39.1, None, 2)),
    "systolic_bp": ((None, 90, 3), (91, 100, 2), (101, 110, 1), (220, None, 3)),
    "heart_rate": ((None, 40, 3), (41, 50, 1), (91, 110, 1), (111, 130, 2), (131, None, 3)),
}
OXYGEN_POINTS, ALERT_POINTS, NOT_ALERT = 2, 3, ("C", "V", "P", "U")

# Coefficients of the emergency-laparotomy risk; a name with * is a product (fixed values).
NELA_INTERCEPT = -3.04678
NELA_TERMS = {
    "age_cent": 0.06660, "asa_3": 1.13007, "asa_4": 1.76293, "asa_5": 2.55345,
    "asa_3*age_cent": -0.03021, "asa_4*age_cent": -0.03356, "asa_5*age_cent": -0.04676, "albumin": -0.04323,
    "pulse_cent": 0.01265, "pulse_cent2": -0.00012, "systolic_bp_cent": -0.00683, "systolic_bp_cent2": 0.00011,
    "ln_urea_cent": 0.38002, "ln_wbc_cent": 0.02041, "ln_wbc_cent2": 0.24153, "gcs_14": 0.41557, "gcs_3_13": 0.64480,
    "malignancy_primary": 0.19201, "malignancy_nodal": 0.50610, "malignancy_distant": 0.94309,
    "respiratory_2": 0.35378, "respiratory_3": 0.60700, "urgency_6_18": 0.03782, "urgency_2_6": 0.14779,
    "urgency_lt_2": 0.57310, "indication_sepsis": 0.02812, "indication_ischaemia": 0.56948,
    "indication_bleeding": -0.40615, "soiling_severe": 0.29453,
}


def band_points(value: Column, bands) -> Column:
    """Points of the band that holds value, else 0; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for low, high, points in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        out = out.when(inside, points)
    return out.otherwise(0)


def news2(inputs: dict[str, Column], oxygen: Column, consciousness: Column) -> Column:
    """Early-warning score. inputs: the five measured columns by their names in NEWS2_BANDS. A null input gives null."""
    parts = [band_points(inputs[name], bands) for name, bands in NEWS2_BANDS.items()]
    parts.append(F.when(oxygen, OXYGEN_POINTS).otherwise(0))
    parts.append(F.when(F.upper(consciousness).isin(*NOT_ALERT), ALERT_POINTS).otherwise(0))
    return reduce(lambda a, b: a + b, parts)


def nela_logit(inputs: dict[str, Column]) -> Column:
    """inputs by the names in NELA_TERMS; those that are missing count as 0."""
    total = F.lit(NELA_INTERCEPT)
    for name, weight in NELA_TERMS.items():
        factors = [inputs.get(n, F.lit(0.0)) for n in name.split("*")]
        total = total + weight * reduce(lambda a, b: a * b, factors)
    return total


def nela_risk(inputs: dict[str, Column]) -> Column:
    return 1 / (1 + F.exp(-nela_logit(inputs)))


def frailty_category(score: Column, has_diagnoses: Column) -> Column:
    """Below 5 low, below 15 intermediate, else high."""
    return F.when(~has_diagnoses, "unknown (no diagnoses)").when(score < 5, "low").when(score < 15, "intermediate").otherwise("high")


def modified_z(value: Column, median: Column, mad: Column) -> Column:
    """0.6745 (v - median) / MAD; null where MAD is 0."""
    return F.try_divide(0.6745 * (value - median), mad)
