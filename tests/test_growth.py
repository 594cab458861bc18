"""What a plan does to rows that are many more than the input's, and that results stay the same."""

import numpy as np

from pyspark.sql import functions as F

from clinspan.operators import documents, select, series
from clinspan.plans import catalogue, lens, model, model_tables
from clinspan.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_computed_once(spark):
    """Training and test rows are read from a table: no as-of window is left in either plan."""
    for part in catalogue._trained(spark, SF):
        assert "Window" not in plan(part) and "event_type" not in plan(part)


def test_minutes_are_made_once(spark):
    """The grid's start comes with its points: they are neither made twice nor joined."""
    text = plan(catalogue.QUERIES["w1_align_minute"](spark, SF))
    grid = text.split("explode(sequence(_begin")
    assert len(grid) == 2 and "Join" not in grid[0]
    rows = spark.createDataFrame([(1, "a", 7, 1.0, 0), (1, "b", 4, 2.0, 1), (1, "a", 90, 3.0, 2), (2, "a", 5, 1.0, 3)], "subject_id long, item_name string, chart_time long, value double, _ord long")
    for minutes in (10, 10**6):
        out = series.align(rows, 1, slice_minutes=minutes, keep_start=True).groupBy("subject_id", "_start").agg(F.min("chart_time").alias("first"), F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, out.collect())) == [(1, 4, 4, 174), (2, 5, 5, 1)]


def test_grids_inside_tasks_equal_rows(spark, monkeypatch):
    """Slices filled in at once equal the grid of rows: overlaps over slices, absent items, lone observations, few points at a time."""
    rng = np.random.default_rng(3)
    rows = [(int(s), "abx"[rng.integers(3 if s % 2 else 1)], int(rng.integers(0, 4_000)) // 10 * 10, float(rng.random()), k) for k, s in enumerate(rng.integers(0, 9, 60))]
    df = spark.createDataFrame([*rows, (20, "a", 50, 1.5, 100), (21, "x", 0, 1.0, 101), (21, "a", 3_000, 2.0, 102)], "subject_id long, item_name string, chart_time long, value double, _ord long")
    plain = lambda out: sorted((tuple(np.round(np.array(x, dtype=float), 9).ravel().tolist() if isinstance(x, list) else round(x, 9) for x in r) for r in out.collect()), key=repr)
    frame = series.wide(series.align(df, 10, slice_minutes=10**9), ["a", "b"], {"a": 0.5, "b": 7.0})
    seen = series.wide(series.align(df, 10, slice_minutes=10**9), ["a", "b", "x"])
    for points, minutes in ((1, 777), (10**6, 777), (10**6, 10**9)):
        monkeypatch.setattr(series, "POINTS", points)
        got = series.aligned_wide(df, ["a", "b"], 10, empty={"a": 0.5, "b": 7.0}, slice_minutes=minutes)
        assert {r for r in plain(got)} >= {r for r in plain(frame)}
        assert plain(series.aligned_wide(df, ["a", "b", "x"], 10, slice_minutes=minutes)) == plain(seen)
        windows = series.windows(seen, ["b"], 31)
        ends = windows.select("subject_id", "start", F.col("steps")[0][0].alias("a"), F.col("steps")[30][0].alias("z"), F.col("steps")[0][1].alias("m"))
        cells = {"a": ("b", lambda w: w[:, 0]), "z": ("b", lambda w: w[:, -1]), "m": ("b_mask", lambda w: w[:, 0])}
        assert plain(series.aligned_windows(df, ["b"], 10, 31, cells, slice_minutes=minutes)) == plain(ends)
        assert plain(series.aligned_padded(df, ["a", "b", "x"], 10, 120, slice_minutes=minutes)) == plain(series.padded(seen, ["a", "b", "x"], 120))


def test_no_grid_point_is_shuffled_or_written(spark):
    for name in ("w1d_wide_frame", "w2_sliding_windows", "w3_scaled", "w6_padded_series", "w2_windows_180"):
        text = plan(catalogue.QUERIES[name](spark, SF))
        above = text.split("MapInArrow")[0]
        assert "MapInArrow" in text and not any(x in above for x in ("Window", "Generate", "Join", "Repartition", "Relation"))
        assert "Aggregate" not in above or name == "w2_windows_180"


def test_windows_of_embeddings_are_not_written(spark):
    """Covariance and mean codes of windows that tasks make equal those of the windows written out."""
    vectors = np.array([r[0] for r in catalogue._window_vectors(spark, SF).select(model.vector_to_array("features")).collect()])
    rows, items = catalogue._hourly(spark, SF), list(lens.ITEMS)
    scaler = series.fit_scaler(catalogue._wide(spark, SF), items)
    assert np.allclose(model_tables.window_covariance(rows, items, 60, 12, scaler=scaler), np.cov(vectors.T), atol=1e-9)
    codes = catalogue._window_codes(spark, SF)
    assert "features" not in codes.columns and codes.agg(F.sum("n_windows")).first()[0] == len(vectors)


def test_indented_documents_of_one_file(spark, tmp_path):
    """A task's documents are one file of paragraphs; blank lines inside texts don't cut them."""
    names = ["x", "a\n\nb", '{\n\n"subject_id": 9}', ""]
    rows = [(i, [{"chart_time": i, "item_name": names[i % 4], "value": 1.5}] * (i % 3), "died" if i % 4 == 0 else "survived") for i in range(300)]
    df = spark.createDataFrame(rows, "subject_id long, labs array<struct<chart_time:long,item_name:string,value:double>>, outcome string").coalesce(2)
    sinks.write_pretty_documents(df, str(tmp_path / "docs"), one_file_each=False)
    assert len(list((tmp_path / "docs").rglob("part-*"))) <= 4
    got = readers.read_documents(spark, str(tmp_path / "docs"), paragraphs=True).select("subject_id", "label", "labs.item_name").collect()
    assert sorted(map(tuple, got)) == [(i, int(i % 4 == 0), [names[i % 4]] * (i % 3)) for i in range(300)]


def test_documents_are_written_compressed(spark, tmp_path):
    df = spark.createDataFrame([(i, "died") for i in range(2_000)], "subject_id long, outcome string").coalesce(1)
    sizes = []
    for i, compression in enumerate(("none", "gzip")):
        path = tmp_path / str(i)
        sinks.write_documents(df, str(path), compression)
        sizes.append(sum(f.stat().st_size for f in path.rglob("part-*")))
        assert readers.read_documents(spark, str(path)).where("label = 1").agg(F.sum("subject_id")).first()[0] == 1_999_000
    assert sizes[1] * 3 < sizes[0]


def _random_series(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), "abk"[rng.integers(3)], int(rng.integers(0, 3_000)) // 10 * 10, float(rng.random()), k) for k, s in enumerate(rng.integers(0, 7, 90))]
    rows = [(*r[:3], 0.1, r[4]) if r[1] == "k" else r for r in rows]
    return spark.createDataFrame([*rows, (20, "a", 50, 1.5, 100)], "subject_id long, item_name string, chart_time long, value double, _ord long")


def test_segments_of_embeddings_are_made_once(spark, monkeypatch):
    """Scaler, covariance and codes read one table of slices, and no task makes windows."""
    made, plain_segments = [], series._segments
    monkeypatch.setattr(series, "_segments", lambda *a: made.append(1) or plain_segments(*a))
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", None)
    assert catalogue._window_codes(spark, SF).count() > 0
    assert len(made) == 1


def test_window_sums_equal_those_of_windows(spark, monkeypatch):
    """Sums of lagged products and of parts of codes, over slices shorter and longer than a window and few points at a time."""
    df, items, length = _random_series(spark), ["a", "b", "k"], 7
    frame = series.wide(series.align(df, 10, slice_minutes=10**9), items).localCheckpoint()
    scaler = series.fit_scaler(frame, items)
    windows = model.window_vectors(series.windows(series.scale(frame, scaler, items), items, length)).select("subject_id", model.vector_to_array("features").alias("v")).collect()
    v = np.array([r["v"] for r in windows])
    table = model_tables.components(np.cov(v.T), 2, spark)
    loads = np.zeros((v.shape[1], 2))
    for r in table.collect():
        loads[r["place"], r["component"] - 1] = r["loading"]
    for points, minutes in ((1, 37), (150, 400), (10**6, 10**9)):
        monkeypatch.setattr(series, "POINTS", points)
        cut = series.slices(df, items, 10, overlap=length - 1, slice_minutes=minutes)
        for name, x in series.slices_scaler(cut, items, 10).first().asDict().items():
            assert np.isclose(x, scaler.first()[name], atol=1e-12)
        assert np.allclose(model_tables.window_covariance(None, items, 10, length, scaler=scaler, cut=cut), np.cov(v.T), atol=1e-9)
        got = {r["subject_id"]: r for r in model_tables.window_codes(None, items, 10, length, table, 2, scaler=scaler, cut=cut).collect()}
        assert got.keys() == {r["subject_id"] for r in windows}
        for s, r in got.items():
            own = np.array([w["v"] for w in windows if w["subject_id"] == s])
            code = own @ loads
            assert r["n_windows"] == len(own) and np.allclose(r["embedding"], code.mean(axis=0), atol=1e-9)
            assert np.isclose(r["error"], ((own**2).sum() - (code**2).sum()) / own.size, atol=1e-9)


def test_timeline_is_sorted_once(spark):
    """Partitions stay as many as the session has, and the window's own sort leaves their rows in order."""
    out = catalogue.QUERIES["w8_timeline"](spark, SF)
    assert plan(out).count("Sort ") == 0 and "RepartitionByExpression" in plan(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    timeline = series.timeline(lens.operations(spark, SF), lens.sources(spark, SF))
    parts = timeline.select(F.spark_partition_id().alias("p"), "subject_id", "place").collect()
    last = {}
    for p, subject, place in parts:
        assert last.get(p, (-1, 0)) < (subject, place) and (place == 1) == (last.get(p, (-1, 0))[0] != subject)
        last[p] = (subject, place)


def test_scaled_rows_come_from_one_table_of_slices(spark, monkeypatch):
    made, plain_segments = [], series._segments
    monkeypatch.setattr(series, "_segments", lambda *a: made.append(1) or plain_segments(*a))
    monkeypatch.setattr(series, "fit_scaler", None)  # the grid's rows aren't made for it
    assert catalogue.QUERIES["w3_scaled"](spark, SF).count() > 0
    assert len(made) == 1


def test_documents_are_dealt_once(spark):
    """Where joins shuffle, as on large tables, each source is read and dealt by subject once, nothing is written between, and rows
    are nested where they are; documents hold what each table alone does."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        docs = catalogue._documents(spark, SF)
        text = docs._jdf.queryExecution().executedPlan().toString()
        assert text.count("events.parquet") == text.count("lineitem.parquet") == 1 and text.count("orders.parquet") == 3
        assert text.count("Exchange hashpartitioning") == 6 and "Exchange" not in text.split("Union")[0]
        got = {r["subject_id"]: r for r in docs.collect()}
    finally:
        spark.conf.set(threshold, before)
    died = dict(map(tuple, select.ever_died(lens.operations(spark, SF)).collect()))
    assert {s: r["outcome"] for s, r in got.items()} == {s: "died" if x else "survived" for s, x in died.items()}
    tables = {
        "labs": (lens.source(spark, SF, "labs"), "value"), "vitals": (lens.source(spark, SF, "vitals"), "value"), "ward_vitals": (lens.source(spark, SF, "ward_vitals"), "value"),
        "operations": (lens.operations(spark, SF), "op_id"), "diagnoses": (lens.diagnosis(spark, SF), "icd10_cm"), "medications": (lens.medications(spark, SF), "drug_name"),
    }
    for name, (table, column) in tables.items():
        want = {s: sorted(x) for s, x in table.groupBy("subject_id").agg(F.collect_list(column)).collect()}
        assert want and {s: sorted(x[column] for x in r[name]) for s, r in got.items()} == {s: want.get(s, []) for s in got}


def test_documents_of_subjects(spark):
    """A row may hold entries of several arrays; subjects without operations have no document, a null subject an empty one."""
    ops = spark.createDataFrame([(1, 9, None), (1, 8, 5), (2, 7, None), (None, 6, 4)], "subject_id long, op_id long, death long").select("subject_id", F.struct("op_id", "death").alias("operations"))
    both = spark.createDataFrame([(1, (3,), None), (1, (2,), ("b",)), (4, None, ("c",)), (None, (1,), ("d",))], "subject_id long, labs struct<v:long>, drugs struct<n:string>")
    docs = documents.of_subjects(documents.nest_rows([ops, both]), "operations", "death").collect()
    got = {r["subject_id"]: ([x["op_id"] for x in r["operations"]], [x["v"] for x in r["labs"]], [x["n"] for x in r["drugs"]], r["outcome"]) for r in docs}
    assert got == {1: ([8, 9], [2, 3], ["b"], "died"), 2: ([7], [], [], "survived"), None: ([], [], [], "survived")}
