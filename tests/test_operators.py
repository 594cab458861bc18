"""Operators on literal tables."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from clinspan.operators import asof, documents, joins, kept_stats, select, series, split, stats
from clinspan.plans import evaluate
from clinspan.sources import dimensions, readers, sinks

EVENTS = "subject_id long, item_name string, chart_time long, value double, _ord long"


def test_asof(spark):
    labs = spark.createDataFrame([(1, "hb", -2175, 12.9, 0), (1, "hb", 6300, 11.3, 1), (1, "hb", 9100, 11.4, 2), (1, "hb", 9100, 99.0, 3), (2, "hb", 5, None, 4)], EVENTS)
    left = spark.createDataFrame([(1, 3500), (1, 9100), (1, -3000), (2, 9), (3, 9), (1, None)], "subject_id long, orin_time long")
    out = {(r[0], r[1]): (r["preop_hb"], r["preop_na"]) for r in asof.asof_items(left, labs, ["hb", "na"]).collect()}
    assert out == {(1, 3500): (12.9, None), (1, 9100): (11.4, None), (1, -3000): (None, None), (2, 9): (None, None), (3, 9): (None, None), (1, None): (None, None)}
    near = asof.asof_items(left, labs, ["hb"], tolerance=100)
    assert {r["preop_hb"] for r in near.where("subject_id = 1 and orin_time is not null").collect()} == {None, 11.4}
    keys = spark.createDataFrame([(1, "x", t, float(t), t) for t in (0, 4, 8, 12)], EVENTS)
    want = spark.createDataFrame([(1, t) for t in (4, 3, 12, 0)], "subject_id long, orin_time long")
    assert {r["orin_time"]: r["value_at"] for r in asof.nearest_preceding(want, keys, "x").collect()} == {4: 0, 3: 0, 12: 8, 0: None}


def test_displaced(spark):
    rows = [(1, "x", 5, 1.0, 0), (1, "x", 5, 2.0, 1), (1, "x", 4, 3.0, 2), (1, "x", 5, 4.0, 3)]
    out = {r["value"]: r["chart_time"] for r in asof.displaced(spark.createDataFrame(rows, EVENTS)).collect()}
    assert out == {1.0: 5, 2.0: 4, 3.0: 3, 4.0: 2}


def plain_displaced(rows):
    """Row by row in file order, each to the latest free minute up to its own."""
    taken, out = set(), {}
    for subject, item, t, _, o in sorted(rows, key=lambda r: r[4]):
        while t is not None and (subject, item, t) in taken:
            t -= 1
        taken.add((subject, item, t))
        out[o] = t
    return out


@pytest.mark.parametrize(("n", "minutes"), [(400, 500), (400, 120), (300, 4), (600, 40)])
def test_displaced_against_row_by_row(spark, n, minutes):
    rng = np.random.default_rng(n + minutes)
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 3)), "xy"[int(rng.integers(0, 2))], None if rng.random() < 0.02 else int(rng.integers(-5, minutes)), float(i), i) for i in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, EVENTS)
    out = asof.displaced(df)
    assert out.schema.simpleString() == df.schema.simpleString() and "Python" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert len(got) == n and {r["_ord"]: r["chart_time"] for r in got} == plain_displaced(rows)
    assert all(r["value"] == float(r["_ord"]) for r in got)


def test_displaced_long_runs_and_none(spark):
    # A run of 6,000 rows, and a minute of 20,000.
    rng = np.random.default_rng(11)
    long_run = [(1, "x", int(t), 0.0, i) for i, t in enumerate(rng.integers(0, 3_000, 6_000))]
    hot = [(2, "x", 7, 0.0, 10_000 + i) for i in range(20_000)]
    got = {r["_ord"]: r["chart_time"] for r in asof.displaced(spark.createDataFrame(long_run + hot, EVENTS)).collect()}
    assert {o: t for o, t in got.items() if o < 10_000} == plain_displaced(long_run)
    assert all(got[10_000 + i] == 7 - i for i in range(20_000))
    assert asof.displaced(spark.createDataFrame([], EVENTS)).collect() == []


def test_first_and_last_operation(spark):
    rows = [(1, 1, 100, 150, None), (2, 1, 100, 160, 90000), (3, 1, 200, 250, None), (4, 2, None, None, None)]
    ops = spark.createDataFrame(rows, "op_id long, subject_id long, orin_time long, orout_time long, inhosp_death_time long").withColumn("_ord", F.col("op_id"))
    assert [r["op_id"] for r in select.first_operation(ops).collect()] == [2] and [r["op_id"] for r in select.last_operation(ops).collect()] == [3]
    assert select.operation_ends(ops).select("first.op_id", "last.op_id").collect() == [(2, 3)]
    assert select.died_30_days(ops).collect() == [(1, False)] and {tuple(r) for r in select.ever_died(ops).collect()} == {(1, True), (2, False)}


def grid(points, g, fade=None):
    """Plain interpolation with lines beyond the ends."""
    points = dict(points)
    if len(points) == 1:
        (t, v), = points.items()
        points[t + 1] = v
    x = sorted(points)
    y = [points[t] for t in x]
    out = []
    for t in g:
        i = min(max(np.searchsorted(x, t, side="right") - 1, 0), len(x) - 2)
        v = y[i] + (y[i + 1] - y[i]) * (t - x[i]) / (x[i + 1] - x[i])
        d = max(x[0] - t, t - x[-1], 0)
        if fade and d:
            w = np.exp(-d / fade)
            v = w * v + (1 - w) * np.mean(y)
        out.append((v, 1.0 if t in points else 0.0))
    return out


@pytest.mark.parametrize("fade", [None, 1.0])
@pytest.mark.parametrize("length", [None, 9])
def test_align(spark, fade, length):
    rng = np.random.default_rng(4)
    data = {(s, i): {int(t): float(rng.normal()) for t in rng.choice(30, size=rng.integers(1, 7), replace=False)} for s in range(6) for i in "abc" if (s, i) != (2, "b")}
    rows = [(s, i, t, v, k) for (s, i), p in data.items() for k, (t, v) in enumerate(p.items())]
    out = {}
    for r in series.align(spark.createDataFrame(rows, EVENTS), full_length=length, fade=fade).collect():
        out.setdefault((r["subject_id"], r["item_name"]), {})[r["chart_time"]] = (r["value"], r["mask"])
    for (s, i), p in data.items():
        times = [t for (q, _), x in data.items() if q == s for t in x]
        g = range(min(times), min(times) + length) if length else range(min(times), max(times) + 1)
        assert sorted(out[(s, i)]) == list(g)
        assert np.allclose([out[(s, i)][t] for t in g], grid(p, g, fade))


def test_fade_golden(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.0, 0), (1, "a", 4, 8.0, 1), (1, "b", 5, 1.0, 2)], EVENTS)
    got = {r["chart_time"]: r["value"] for r in series.align(df, fade=1.0).where("item_name = 'a'").collect()}
    assert [got[t] for t in range(5)] == [0, 2, 4, 6, 8] and got[5] == pytest.approx(6.207277, abs=1e-6)


def test_windows_padding_and_scaling(spark):
    rows = [(s, t, float(t + s), 1.0) for s, n in ((1, 7), (2, 3)) for t in range(n)]
    frame = spark.createDataFrame(rows, "subject_id long, chart_time long, x double, x_mask double")
    out = series.windows(frame, ["x"], 5).collect()
    assert sorted((r["subject_id"], r["start"]) for r in out) == [(1, 0), (1, 1), (1, 2)] and out[0]["steps"][1] == [out[0]["steps"][0][0] + 1, 1.0]
    assert series.windows(frame, ["x"], 5, stride=2).count() == 2
    pad = {r["subject_id"]: r for r in series.padded(frame, ["x"], 5).collect()}
    assert pad[2]["attention"] == [1, 1, 1, 0, 0] and pad[2]["steps"][3] == [0.0, 0.0] and len(pad[1]["steps"]) == 5
    scaled = series.scale(frame, series.fit_scaler(frame, ["x"]), ["x"])
    x = np.array([r[2] for r in rows])
    assert sorted(r["x"] for r in scaled.collect()) == pytest.approx(sorted((x - x.mean()) / x.std()))
    flat = frame.withColumn("x", F.lit(3.0))
    assert {r["x"] for r in series.scale(flat, series.fit_scaler(flat, ["x"]), ["x"]).collect()} == {0.0}
    assert series.window_length(5 * 1440) == 180 and series.window_length(1000) == 25 and series.window_length(10) == 5


def test_rank_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    m = evaluate.rank_metrics(evaluate.curve(df, "s", "y")).first()
    assert (m["auroc"], round(m["auprc"], 6), round(m["average_precision"], 6), m["prevalence"]) == (0.75, 0.791667, 0.833333, 0.5)
    one = evaluate.rank_metrics(evaluate.curve(df.where("y = 1"), "s", "y")).first()
    assert (one["auroc"], one["auprc"]) == (None, None)
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([(int(y), float(np.round(s + y * 0.3, 2))) for y, s in zip(rng.integers(0, 2, 800), rng.normal(size=800), strict=True)], "y int, s double")
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(many)
    assert evaluate.rank_metrics(evaluate.curve(many, "s", "y")).first()["auroc"] == pytest.approx(want)


def test_best_f1(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    best = (0.0, 0.0)
    for i in range(101):
        tp, fp, fn = ((s >= i / 100) & (y == 1)).sum(), ((s >= i / 100) & (y == 0)).sum(), ((s < i / 100) & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        if f1 > best[1]:
            best = (i / 100, f1)
    assert tuple(evaluate.best_f1(evaluate.f1_scan(df, "s", "y")).first()) == pytest.approx(best)
    none = df.withColumn("y", F.lit(0))
    assert tuple(evaluate.best_f1(evaluate.f1_scan(none, "s", "y")).first()) == (0.0, 0.0)


def test_splits(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(203)], "subject_id long, label int")
    random_ = split.random_split(df).collect()
    assert sum(r["is_test"] for r in random_) == 61 and random_ is not None
    assert {r[0] for r in random_ if r["is_test"]} == {r[0] for r in split.random_split(df.repartition(7)).collect() if r["is_test"]}
    cut = split.shuffled_split(df).agg(F.count_if("is_train"), F.count_if("is_test"), F.count_if(F.col("is_train") & F.col("is_test"))).first()
    assert tuple(cut) == (142, 61, 0)
    assert split.shuffled_split(df, overlap=True).where("is_train and is_test").count() == 1
    exact = split.stratified_exact(df, "label", 4, 9).where("is_test").groupBy("label").count().collect()
    assert {tuple(r) for r in exact} == {(1, 4), (0, 9)}
    with pytest.raises(ValueError):
        split.stratified_exact(df, "label", 400, 9)
    capped = split.stratified_capped(df, "label").where("is_test").groupBy("label").count().collect()
    assert {tuple(r) for r in capped} == {(1, 20), (0, 30)}
    with pytest.raises(ValueError):
        split.stratified_capped(df.where("subject_id = 3"), "label")


def test_joins(spark):
    dx = spark.createDataFrame([(i, c) for i, c in enumerate(["J20.0", "C50", "S99", "w19", "A5", "F32", "A00"])], "n long, icd10_cm string")
    got = {r["icd10_cm"]: r["block"] for r in joins.with_chapter(dx, dimensions.icd_chapters(spark)).collect()}
    assert got == {"J20.0": "J00-J99", "C50": "C00-D48", "S99": "S00-T98", "w19": "V01-Y98", "A5": None, "F32": "F00-F99", "A00": "A00-B99"}
    literal = {r["icd10_cm"]: r["chapter"] for r in joins.with_chapter(dx, dimensions.icd_chapters(spark), literal=True).collect()}
    assert literal["C50"] is None and literal["J20.0"] == "X" and literal["S99"] is None and literal["A00"] is None
    prefixes = spark.createDataFrame([("F",), ("A5",), ("J200",)], "prefix string")
    assert {r["icd10_cm"] for r in joins.without_excluded(dx, prefixes).collect()} == {"C50", "S99", "w19", "A00"}
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0), (3, 0.0, 0.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, 1.0), (4, 0.0, 0.0)], "k long, x double, y double")
    assert {(r["k"], r["feature"]) for r in joins.feature_mismatches(a, b, "k", ["x", "y"]).collect()} == {(2, "x"), (3, "x"), (3, "y"), (4, "x"), (4, "y")}
    s = spark.createDataFrame([(1, "a", 1, 1.0, 1)], EVENTS)
    with pytest.raises(ValueError):
        joins.disjoint_union(s, s)


def test_csv_with_bom_and_documents(spark, tmp_path):
    path = tmp_path / "labs.csv"
    path.write_bytes("﻿subject_id,chart_time,item_name,value\r\n 4 ,-5,hb, 1.5 \r\n5,,hb,\n6,7,na,NaN\n".encode())
    rows = readers.read_table(spark, str(path), "labs").collect()
    assert [tuple(r) for r in rows] == [(4, -5, "hb", 1.5), (5, None, "hb", None), (6, 7, "na", None)]
    assert readers.read_text_table(spark, str(path), spark.createDataFrame([(6,)], "subject_id long")).count() == 1
    labs = spark.createDataFrame([(1, 5, "hb", 2.0), (1, 4, "hb", 1.0)], "subject_id long, chart_time long, item_name string, value double")
    ops = spark.createDataFrame([(1, 9), (2, 8)], "subject_id long, op_id long")
    nested = documents.with_outcome(documents.nest(ops, {"labs": labs, "operations": ops}), spark.createDataFrame([(1, True), (2, False)], "subject_id long, died boolean"))
    sinks.write_documents(nested, f"{tmp_path}/d")
    back = {r["subject_id"]: r for r in readers.read_documents(spark, f"{tmp_path}/d").collect()}
    assert back[1]["label"] == 1 and [x["value"] for x in back[1]["labs"]] == [1.0, 2.0] and back[2]["label"] == 0 and back[2]["labs"] == []
    p = readers.with_order(spark.createDataFrame([("t", "a", "u", "d"), ("t", "a", "v", "d")], "`Table` string, Label string, Unit string, Description string").coalesce(1))
    assert readers.first_parameters(p).collect()[0]["unit"] == "u" and stats.parameter_conflicts(p).count() == 1


def test_histogram_and_box(spark):
    v = spark.createDataFrame([("a", float(x)) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 50]], "item_name string, value double")
    h = {r["bin"]: r["n"] for r in stats.histogram(v, 5).collect()}
    assert h == {0: 10, 1: 1, 2: 0, 3: 0, 4: 1}
    b = stats.box_stats(v, ["item_name"]).first()
    assert (b["q1"], b["median"], b["q3"], b["low"], b["high"]) == (2.75, 5.5, 8.25, 0, 10)


def test_encoder_takes_every_window(spark):
    from clinspan.plans import catalogue

    sf = "/root/testdata/sf0.001"
    points = {r["subject_id"]: r["count"] for r in catalogue._wide(spark, sf).groupBy("subject_id").count().collect()}
    got = {r["subject_id"]: r["n_windows"] for r in catalogue.QUERIES["m10_window_embeddings"](spark, sf).collect()}
    assert got and got == {s: n - 11 for s, n in points.items() if n >= 12}


def test_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = {"skewed": rng.lognormal(0, 4, 5000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: rng.normal(size=777)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("empty", None)]
    values = spark.createDataFrame(rows, "item_name string, value double")
    at = (0.0, 0.25, 0.5, 0.9, 1.0)
    # All groups sorted at once; none; some; and brackets that miss, so that groups are sorted after all.
    for accuracy, bracket, small in ((stats.ACCURACY, stats.BRACKET, stats.SMALL), (stats.ACCURACY, stats.BRACKET, 0), (stats.ACCURACY, stats.BRACKET, 1_000), (2, 0.0, 0)):
        monkeypatch.setattr(stats, "SMALL", small)
        monkeypatch.setattr(stats, "ACCURACY", accuracy)
        monkeypatch.setattr(stats, "BRACKET", bracket)
        got = {r["item_name"]: (r["n"], list(r["q"])) for r in stats.quantiles(values, ["item_name"], at).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            assert got[k][0] == len(vs) and np.allclose(got[k][1], np.quantile(vs, at), rtol=1e-12)


def test_brackets_of_large_groups_hold_their_quantiles(spark):
    """Just above SMALL, for sizes at which places fall beside and between values."""
    at = (0.25, 0.5, 0.75)
    rows = [F.expr(f"explode(sequence(1, {n}))").alias("i") for n in (10_001, 10_003, 12_502, 40_003)]
    for column in rows:
        values = spark.range(1).select(column).select(F.lit("x").alias("item_name"), (F.col("i") * F.lit(7_919) % 1_000_003).cast("double").alias("value"))
        (got,) = stats.quantiles(values, ["item_name"], at).collect()
        want = np.quantile([r["value"] for r in values.collect()], at)
        assert np.allclose(got["q"], want, rtol=1e-12)
        assert "percentile(" not in stats.quantiles(values, ["item_name"], at)._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [2_000, 10_000, 128 << 20])
def test_file_order_is_the_same_for_every_cut(spark, tmp_path, block):
    """Files whose names aren't in the order of their sizes; every block size gives file, then row, as they stand."""
    want = []
    for name, n in (("a", 100), ("b", 5_000), ("c", 800)):
        lines = [f"{i % 7},{i},{name},{len(want) + i}" for i in range(n)]
        want += [(name, i) for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["subject_id,chart_time,item_name,value", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = readers.with_order(readers.read_table(spark, str(tmp_path), "labs"))
        assert [(r[0], r[1]) for r in df.orderBy("_ord").select("item_name", "chart_time").collect()] == want
        assert [(r[0], r[1]) for r in readers.first_rows(readers.read_table(spark, str(tmp_path), "labs"), 102).orderBy("place").select("item_name", "chart_time").collect()] == want[:102]
        numbers = readers.numbered(df).select("item_name", "chart_time", "_row").collect()
        assert len(numbers) == len(want) and all(r["_row"] == r["chart_time"] for r in numbers)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_slices_of_time_change_nothing(spark):
    """As-of joins and alignment over many slices of a subject equal those over one, with nulls and far gaps."""
    rng = random.Random(7)
    events = [(rng.choice([1, 2, None]), rng.choice("ab"), None if rng.random() < 0.03 else rng.choice([rng.randrange(-3_000, 3_000), rng.randrange(90_000, 91_000)]) // 10 * 10, rng.choice([None, rng.random()]), k) for k in range(600)]
    events += [(3, "a", 50, 1.5, 9_000), (4, "a", 0, 1.0, 9_001), (4, "b", 500_000, 2.0, 9_002)]
    df = spark.createDataFrame(events, "subject_id long, item_name string, chart_time long, value double, _ord long")
    left = spark.createDataFrame([(i, rng.choice([1, 2, 3, 5, None]), rng.choice([None, rng.randrange(-3_100, 95_000)])) for i in range(300)], "op_id long, subject_id long, orin_time long")
    plain = lambda out: sorted(map(tuple, out.collect()), key=repr)
    for settings in ({}, {"tolerance": 500}, {"exact": False, "with_times": True}):
        want = plain(asof.asof_items(left, df, ["a", "b", "none"], slice_minutes=10**9, **settings))
        assert len(want) == 300
        for minutes in (777,):
            assert plain(asof.asof_items(left, df, ["a", "b", "none"], slice_minutes=minutes, **settings)) == want
    known = df.where("subject_id is not null")
    for settings in ({}, {"full_length": 300}, {"fade": 50.0}, {"full_length": 1}):
        rounded = lambda out: plain(out.withColumn("value", F.round("value", 9)))
        want = rounded(series.align(known, 10, slice_minutes=10**9, **settings))
        for minutes in (130, 7_777)[: 1 + (settings == {})]:
            assert rounded(series.align(known, 10, slice_minutes=minutes, **settings)) == want
    wide = lambda keep: plain(series.wide(series.align(known, 10, slice_minutes=1_000, keep_slice=keep), ["a", "b"]))
    assert wide(True) == wide(False)


def test_one_subject_meets_many_tasks(spark):
    """Two million rows of one subject: slices stand in many tasks, and no window of rows has the subject alone as its key."""
    rows = spark.range(2_000_000).selectExpr("1L as subject_id", "concat('i', id % 2) as item_name", "id div 2 as chart_time", "cast(id % 1000 as double) as value", "id as _ord")
    left = spark.range(1_000).selectExpr("id as op_id", "1L as subject_id", "id * 1000 + 7 as orin_time")
    out = asof.asof_items(left, rows, ["i0", "i1"])
    got = out.agg(F.count_if((F.col("preop_i0") == F.col("orin_time") * 2 % 1000) & (F.col("preop_i1") == (F.col("orin_time") * 2 + 1) % 1000))).first()[0]
    assert got == 1_000
    aligned = series.align(rows, 1, keep_slice=True)
    per_task = aligned.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 2_000_000 and len(per_task) > 4 and max(r["count"] for r in per_task) < 1_400_000


def test_kept_stats(spark, tmp_path):
    """Parts that are added, one of them twice, and a compacted store: mean, deviation, median and MAD of numpy."""
    rng = np.random.default_rng(9)
    items = {"distinct": rng.normal(0, 50, 3_001), "levels": rng.integers(-3, 4, 2_000).astype(float), "zero": np.zeros(11), "two": np.array([1.0, 5.0]), "wide": 10.0 ** rng.uniform(-60, 60, 500) * rng.choice([-1, 1], 500), "one": np.array([7.0]), "far": np.r_[np.full(50, 1.0), 1e6 + rng.random(49)]}
    rows = [(n, float(v)) for n, values in items.items() for v in values] + [("levels", None), ("levels", float("nan")), (None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(n, None if v is None else float(v), k) for k, (n, v) in enumerate(rows)], "item_name string, value double, k long")
    store = str(tmp_path / "store")
    for k in (0, 1, 2, 1):
        kept_stats.add(df.where(f"k % 3 = {k}"), store, f"day{k}")
    kept_stats.compact(spark, store, f"{store}-all")
    for at in (store, f"{store}-all"):
        got = {r["item_name"]: r for r in kept_stats.stats(spark, at).collect()}
        assert set(got) == set(items) - {"one"}
        for name, r in got.items():
            v = items[name]
            assert r["length"] == len(v) and r["median"] == np.median(v)
            assert np.allclose([r["mean"], r["stdev"]], [v.mean(), v.std(ddof=1)], rtol=1e-9)
            assert np.isclose(r["mad"], np.median(np.abs(v - np.median(v))), rtol=1e-12)


def test_many_overlapping_ranges(spark):
    rng = random.Random(2)
    code = lambda: "".join(rng.choice("ABCDEFG019") for _ in range(rng.randint(1, 4)))
    ranges = [(*sorted((code(), code())), f"r{i}") for i in range(10_000)] + [("Z", "A", "never"), ("é", "ü", "after all")]
    rng.shuffle(ranges)
    ranges = ranges[:9_990] + [(a, a + "9", w) for a, _, w in ranges[9_990:]]  # narrow ones last: mostly hidden
    keys = [code() for _ in range(400)] + [None, "", "é", "ö", "ZZ", "G999", "GG\0"]
    df = spark.createDataFrame([(k,) for k in keys], "code string")
    for some in (ranges, ranges[-300:], ranges[:1]):
        got = [r[0] for r in df.select(joins.in_ranges(F.col("code"), some)).collect()]
        assert got == [None if k is None else next((w for a, b, w in some if a <= k <= b), None) for k in keys]
    assert [r[0] for r in df.select(joins.in_ranges(F.col("code"), [])).distinct().collect()] == [None]


def test_bucketed_table_needs_no_exchange(spark, tmp_path):
    """An as-of join and groupings over a bucketed table: its events are scanned and not shuffled."""
    rows = spark.range(5_000).selectExpr("id % 50 as subject_id", "concat('i', id % 2) as item_name", "id as chart_time", "cast(id as double) as value", "id as _ord")
    left = spark.range(100).selectExpr("id as op_id", "id % 50 as subject_id", "id * 40 as orin_time")
    name = f"events_{random.randrange(10**9)}"
    table = sinks.write_bucketed(rows, name, str(tmp_path / "events"), buckets=8)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(asof.first_at_each_time(table))
        assert "Exchange" not in plan(stats.standardised_in_subject(table))
        got = asof.asof_items(left, table, ["i0", "i1"], buckets=8, slice_minutes=700)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, asof.asof_items(left, rows, ["i0", "i1"]).collect()))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        lines = plan(asof.asof_items(left, table, ["i0", "i1"], buckets=8)).splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        scans = [i for i, line in enumerate(lines) if "FileScan" in line]
        assert scans
        for i in scans:  # up from the scan: rows are reduced to a slice's ends, or joined to left rows by a window, before any exchange
            above, at = [], depth(lines[i])
            for line in reversed(lines[:i]):
                if depth(line) < at:
                    at = depth(line)
                    above.append(line)
            first = next(k for k, line in enumerate(above) if "Window" in line or "_slice" in line and "Aggregate(key" in line)
            assert not any("Exchange" in line for line in above[:first])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"drop table {name}")


def test_pretty_documents_are_a_file_each(spark, tmp_path):
    rows = [(i, [{"chart_time": i, "item_name": "x", "value": 1.5}] * (i % 3), "died" if i % 4 == 0 else "survived") for i in range(30)]
    df = spark.createDataFrame(rows, "subject_id long, labs array<struct<chart_time:long,item_name:string,value:double>>, outcome string")
    sinks.write_pretty_documents(df, str(tmp_path / "docs"))
    files = list((tmp_path / "docs").rglob("part-*.txt"))
    assert len(files) == 30 and all(f.read_text().startswith("{") and f.read_text().count("\n") > 2 for f in files)
    got = {r["subject_id"]: (len(r["labs"] or []), r["label"]) for r in readers.read_documents(spark, str(tmp_path / "docs"), pretty=True).collect()}
    assert got == {i: (i % 3, int(i % 4 == 0)) for i in range(30)}
    # A file may hold an array of documents; one without a folder of its outcome has no label.
    (tmp_path / "two.json").write_text('[\n{"subject_id": 1},\n{"subject_id": 2}\n]')
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "two.json"), pretty=True).select("subject_id", "label").orderBy("subject_id").collect()] == [(1, None), (2, None)]
