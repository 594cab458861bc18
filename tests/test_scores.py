"""Golden values of scores and column expressions."""

import pytest
from pyspark.sql import functions as F

from clinspan.functions import codes, scalars, scores
from clinspan.operators import series as S
from clinspan.operators import stats
from clinspan.sources import dimensions
from clinspan.streaming import scoring

VITALS = [(22, 93.0, 37.2, 105, 95, "A", True, 8), (25, 92.0, 37.5, 130, 100, "A", False, 6), (15, 95.0, 36.5, 110, 80, "C", True, 7), (30, 88.0, 38.0, 90, 120, "p", True, 16), (15, 91.5, 36.5, 120, 80, "A", False, 0), (15, 97.0, 35.05, 120, 80, "A", False, 0)]
SHAPE = "resp_rate int, spo2 double, temp double, systolic_bp int, heart_rate int, consciousness string, oxygen boolean, want int"


def test_early_warning_score(spark):
    df = scoring.news2_stream(spark.createDataFrame(VITALS, SHAPE))
    assert all(r["score"] == r["want"] for r in df.collect())
    one = spark.createDataFrame([(None, 97.0, 36.5, 120, 80, "A", False, 0)], SHAPE)
    assert scoring.news2_stream(one).first()["score"] is None


def test_score_on_a_stream(spark, tmp_path):
    spark.createDataFrame(VITALS, SHAPE).write.json(f"{tmp_path}/in")
    stream = scoring.news2_stream(spark.readStream.schema(SHAPE).json(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("news2").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["score"] for r in spark.table("news2").collect()) == sorted(v[-1] for v in VITALS)


def test_laparotomy_risk(spark):
    values = {"age_cent": 5, "asa_3": 1, "albumin": 35, "pulse_cent": 10, "pulse_cent2": 100, "systolic_bp_cent": -5, "systolic_bp_cent2": 25, "ln_urea_cent": 0.3, "ln_wbc_cent": 0.2, "ln_wbc_cent2": 0.04, "gcs_14": 1, "malignancy_primary": 1, "respiratory_2": 1, "urgency_2_6": 1, "indication_sepsis": 1, "soiling_severe": 1}
    inputs = {n: F.lit(float(v)) for n, v in values.items()}
    row = spark.range(1).select(scores.nela_logit(inputs).alias("l"), scores.nela_risk(inputs).alias("p")).first()
    assert row["l"] == pytest.approx(-1.536861, abs=1e-6) and row["p"] == pytest.approx(0.176992, abs=1e-6)


def test_robust_statistics(spark):
    v = spark.createDataFrame([("x", float(n)) for n in (10, 12, 11, 13, 12, 11, 100)] + [("y", 1.0), ("z", 2.0), ("z", 2.0)], "item_name string, value double")
    st = {r["item_name"]: r for r in stats.population_stats(v).collect()}
    assert set(st) == {"x", "z"} and (st["x"]["median"], st["x"]["mad"], st["x"]["length"]) == (12, 1, 7)
    assert st["x"]["mean"] == pytest.approx(24.142857, abs=1e-6) and st["x"]["stdev"] == pytest.approx(33.463555, abs=1e-6)
    table = stats.population_stats(v)
    z = stats.modified_z_scores(v.where("item_name = 'x'"), table)
    assert sorted(round(r["modified_z"], 4) for r in z.collect()) == [-1.349, -0.6745, -0.6745, 0, 0, 0.6745, 59.356]
    assert [r["outlier"] for r in z.collect()].count(True) == 1
    flat = v.where("item_name = 'z'")
    assert {r["modified_z"] for r in stats.modified_z_scores(flat, table).collect()} == {None}
    assert {r["modified_z"] for r in stats.modified_z_scores(flat, table, fallback=True).collect()} == {None}


def test_body_mass_index(spark):
    df = spark.createDataFrame([(50.0, 155.0), (50.0, 10.0), (0.0, 170.0), (None, 170.0)], "w double, h double")
    rows = df.select(scalars.bmi_of_table(F.col("w"), F.col("h")).alias("t"), scalars.bmi_of_subject(F.col("w"), F.col("h")).alias("s")).collect()
    assert rows[0]["t"] == pytest.approx(20.811655, abs=1e-6)
    assert (rows[1]["t"], round(rows[1]["s"])) == (None, 5000) and (rows[2]["t"], rows[2]["s"]) == (0, None) and rows[3]["t"] is None


def test_numbers(spark):
    df = spark.createDataFrame([(" 4 ",), ("",), (None,), ("x",), ("NaN",), ("-1.5",)], "c string")
    assert [r[0] for r in df.select(scalars.lenient_number(F.col("c"))).collect()] == [4.0, None, None, None, None, -1.5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(scalars.strict_number(F.col("c"))).collect()


def test_codes(spark):
    assert len(codes.hfrs_points()) == 109 and dict(codes.hfrs_points())["G81"] == 4.4
    assert len(codes.vital_names()) == len(set(codes.vital_names())) == 74 and len(codes.chapters()) == 22 and len(codes.departments()) == 16
    df = spark.createDataFrame([("M01AE01",), ("G03AC",), ("0BAD",), ("M01",)], "c string")
    rows = df.select(*(c.alias(n) for n, c in scalars.atc_levels(F.col("c")).items())).collect()
    assert tuple(rows[0]) == ("M", "M01", "M01A", "M01AE", "M01AE01") and rows[1]["level_5"] == "G03AC" and set(rows[2]) == set(rows[3]) == {None}
    icd = spark.createDataFrame([("j20.0",), ("A41",)], "c string").select(scalars.normal_icd(F.col("c")), scalars.dotted_icd(F.col("c"))).collect()
    assert [tuple(r) for r in icd] == [("J200", "J20.0"), ("A41", "A41")]


def test_frailty(spark):
    from clinspan.operators import joins

    dx = spark.createDataFrame([(1, c) for c in ("F05", "f05", "N39.0", "Z99", "E11")] + [(2, "E11")], "subject_id long, icd10_cm string")
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    got = {r["subject_id"]: (r["hfrs"], r["category"]) for r in stats.frailty_scores(subjects, joins.with_hfrs_points(dx, dimensions.hfrs(spark))).collect()}
    assert got == {1: (10.4, "intermediate"), 2: (0.0, "low"), 3: (0.0, "unknown (no diagnoses)")}
    edge = spark.createDataFrame([(5.0,), (15.0,), (4.99,)], "s double").select(scores.frailty_category(F.col("s"), F.lit(True))).collect()
    assert [r[0] for r in edge] == ["intermediate", "high", "low"]


def test_positional_encoding(spark):
    import numpy as np

    rows = {r["position"]: r["encoding"] for r in S.positional_encoding(spark, 20, 6).collect()}
    want = [np.sin(7 / 10000 ** (2 * (i // 2) / 6)) if i % 2 == 0 else np.cos(7 / 10000 ** (2 * (i // 2) / 6)) for i in range(6)]
    assert rows[7] == pytest.approx(want)
