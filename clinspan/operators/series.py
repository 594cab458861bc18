"""Irregular series on a regular grid: alignment, windows, scaling, padding, timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspan.functions import scalars
from clinspan.sources import scratch


#: Minutes of a slice: a subject's series are dealt to tasks by them.
SLICE = 30 * 24 * 60


def _neighbours(series: DataFrame, slice_minutes: int) -> DataFrame:
    """Distinct observations with those before and after them (_p, _q: structs of time and value), the subject's ends (_g0,
    _g1), and the number and mean of its item's observations.

    Neighbours are sought inside slices of time. A row for each item and slice of a subject hands over its first and last
    observation, and it is these rows that windows over a whole subject see."""
    one = series.where("value is not null and chart_time is not null").groupBy("subject_id", "item_name", "chart_time").agg(F.max_by("value", "_ord").alias("value"))
    rows = one.withColumns({"_slice": F.floor(F.col("chart_time") / slice_minutes), "_x": F.struct(F.col("chart_time").alias("t"), F.col("value").cast("double").alias("v"))})
    sums = rows.groupBy("subject_id", "item_name", "_slice").agg(F.min("_x").alias("_a"), F.max("_x").alias("_z"), F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sum"))
    subject, item = Window.partitionBy("subject_id"), Window.partitionBy("subject_id", "item_name")
    in_order = item.orderBy("_slice")
    # Both windows need one exchange, on the subject.
    borders = sums.repartition("subject_id").select(
        "subject_id", "item_name", "_slice", F.lag("_z").over(in_order).alias("_z0"), F.lead("_a").over(in_order).alias("_a1"), F.min("_a.t").over(subject).alias("_g0"), F.max("_z.t").over(subject).alias("_g1"),
        F.sum("_n").over(item).alias("_n"), (F.sum("_sum").over(item) / F.sum("_n").over(item)).alias("_mean"),
    )
    inside = Window.partitionBy("subject_id", "item_name", "_slice").orderBy("chart_time")
    near = rows.withColumns({"_p": F.lag("_x").over(inside), "_q": F.lead("_x").over(inside)})
    return near.join(borders, ["subject_id", "item_name", "_slice"]).withColumns({"_p": F.coalesce("_p", "_z0"), "_q": F.coalesce("_q", "_a1")}).drop("_z0", "_a1", "_x")


def _line(t: Column, a: Column, va: Column, b: Column, vb: Column) -> Column:
    return va + (vb - va) * (t - a) / (b - a)


def _segments(series: DataFrame, step: int, full_length: int | None, slice_minutes: int, overlap: int = 0) -> DataFrame:
    """What each observation covers of the grid (_begin to _stop), cut and dealt by slices of time; a slice goes on for overlap
    minutes into the next one.

    Segments are small and what is made of them isn't, so they are dealt to all shuffle partitions: by their own size, Spark
    would join partitions to a few."""
    end = F.col("_g1") if full_length is None else F.col("_g0") + (full_length - 1) * step
    t, lone = F.col("chart_time"), F.col("_n") == 1
    # What an observation covers: from itself to the next one; the first and the last one to the ends of the grid, too.
    last = F.when(lone & F.lit(full_length is None), F.greatest(F.col("_g1"), t)).otherwise(end)
    covered = _neighbours(series, slice_minutes).withColumns({"_from": F.when(F.col("_p").isNull(), F.col("_g0")).otherwise(t), "_to": F.when(F.col("_q").isNotNull(), F.least(F.col("_q.t") - step, end)).otherwise(last)}).where("_from <= _to")
    first_slice, last_slice = F.floor(F.greatest(F.col("_from") - overlap, F.col("_g0")) / slice_minutes), F.floor(F.col("_to") / slice_minutes)
    sliced = covered.drop("_slice").withColumn("_slice", F.explode(F.sequence(first_slice, last_slice)))
    begin = F.greatest(F.col("_from"), F.col("_slice") * slice_minutes)
    begin = F.col("_from") + F.ceil((begin - F.col("_from")) / step).cast("long") * step
    stop = F.least(F.col("_to"), (F.col("_slice") + 1) * slice_minutes - 1 + overlap)
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sliced.withColumns({"_begin": begin, "_stop": stop}).where("_begin <= _stop").repartition(parts, "subject_id", "_slice")


def align(series: DataFrame, step: int = 1, full_length: int | None = None, fade: float | None = None, slice_minutes: int = SLICE, keep_slice: bool = False, keep_start: bool = False) -> DataFrame:
    """subject_id, item_name, chart_time, value, mask (1.0 observed, 0.0 not): each item on its subject's grid.

    The grid goes from the subject's first to its last observation over all items by step, or has full_length points from
    the first. Between observations values lie on straight lines; outside an item's own range on the line through its two
    edge points, with fade drawn to the mean of its points: weight exp(-distance / fade). A lone observation is repeated a
    step later, observed too. series: subject_id, item_name, chart_time (multiples of step from the subject's first), value,
    _ord. Rows are made and dealt by (subject, slice of time), so series and gaps of any length meet many tasks; keep_slice
    keeps the column _slice, for ``wide``; keep_start has the grid's first time beside each point, as _start.
    """
    t, v, g = F.col("chart_time"), F.col("value"), F.col("_g")
    lone = F.col("_n") == 1
    dealt = _segments(series, step, full_length, slice_minutes)
    out = dealt.withColumn("_g", F.explode(F.sequence("_begin", "_stop", F.lit(step).cast("long"))))
    before, after = g < t, F.col("_q").isNull() & (g > t)
    value = F.when((g == t) | lone, v).when(after, _line(g, F.col("_p.t"), F.col("_p.v"), t, v)).otherwise(_line(g, t, v, F.col("_q.t"), F.col("_q.v")))
    if fade is not None:
        weight = F.exp(-F.abs(g - t) / fade)
        value = F.when(before | after, weight * value + (1 - weight) * F.col("_mean")).otherwise(value)
    seen = (g == t) | (lone & (g == t + step))
    kept = [*(["_slice"] if keep_slice else []), *([F.col("_g0").alias("_start")] if keep_start else [])]
    return out.select("subject_id", "item_name", g.alias("chart_time"), value.alias("value"), F.when(seen, 1.0).otherwise(0.0).alias("mask"), *kept)


def wide(aligned: DataFrame, items: list[str], empty: dict[str, float] | float = 0.0) -> DataFrame:
    """One row per subject and grid point: a column for each item and item_mask. Items without observations take empty (a
    constant, or one per item such as population medians) and mask 0.0."""
    cells = []
    for i in items:
        default = empty.get(i) if isinstance(empty, dict) else empty
        mine = F.col("item_name") == i
        cells += [F.coalesce(F.max(F.when(mine, F.col("value"))), F.lit(default).cast("double")).alias(i), F.coalesce(F.max(F.when(mine, F.col("mask"))), F.lit(0.0)).alias(f"{i}_mask")]
    # With its slices, the grid stands by (subject, slice) already: it isn't shuffled again.
    by = ["subject_id", *(c for c in ["_slice"] if c in aligned.columns), "chart_time"]
    return aligned.where(F.col("item_name").isin(items)).groupBy(*by).agg(*cells).drop("_slice")


class Slices(NamedTuple):
    """Grid points of some slices of time, side by side: per slice its subject, first time, own points and all points (own ones
    and the overlap), and at, the place of its first point in each array of columns (an array for each item and item_mask)."""

    subject: np.ndarray
    first: np.ndarray
    own: np.ndarray
    size: np.ndarray
    at: np.ndarray
    columns: dict[str, np.ndarray]

    def places(self) -> np.ndarray:
        """The place of each point in its slice."""
        return np.arange(self.size.sum()) - np.repeat(self.at, self.size)


#: Grid points that a task has in hand at once; a slice has at most its minutes and the overlap.
POINTS = 200_000


def slices(series: DataFrame, items: list[str], step: int, full_length: int | None = None, overlap: int = 0, first_only: bool = False, slice_minutes: int = SLICE) -> DataFrame:
    """subject_id, first, own, size, segments: the slices of time that ``on_grid`` fills in, its settings those of that. Kept as a
    table, they serve several passes over the grid."""
    t, v = F.col("chart_time"), F.col("value").cast("double")
    lone, after = F.col("_n") == 1, F.col("_q").isNull()
    # A line through two points serves a whole segment; a lone observation's is flat.
    a, b = F.when(after, F.col("_p.t")).otherwise(t), F.when(after, t).otherwise(F.col("_q.t"))
    va, vb = F.when(after, F.col("_p.v")).otherwise(v), F.when(after, v).otherwise(F.col("_q.v"))
    place = F.array_position(F.array(*map(F.lit, items)), F.col("item_name")) - 1
    segment = F.struct(
        F.col("_begin").alias("begin"), F.col("_stop").alias("stop"), t.alias("t"), v.alias("v"), lone.cast("long").alias("lone"), place.alias("item"),
        F.when(lone, t).otherwise(a).alias("a"), F.when(lone, v).otherwise(va).alias("va"), F.when(lone, 1).otherwise(b - a).alias("d"), F.when(lone, 0.0).otherwise(vb - va).alias("dv"),
    )
    cut = _segments(series, step, full_length, slice_minutes, overlap * step)
    last = F.col("_begin") + F.floor((F.col("_stop") - F.col("_begin")) / step) * step
    rows = cut.groupBy("subject_id", "_slice").agg(F.min("_begin").alias("first"), F.max(last).alias("last"), F.min("_g0").alias("start"), F.collect_list(F.when(place >= 0, segment)).alias("segments"))
    if first_only:
        rows = rows.where("first = start")
    until = (F.col("_slice") + 1) * slice_minutes - 1
    size = F.floor((F.col("last") - F.col("first")) / step) + 1
    own = F.least(size, F.floor((until - F.col("first")) / step) + 1)
    return rows.where(F.col("first") <= until).select("subject_id", "first", own.alias("own"), size.alias("size"), "segments")


def on_grid(series: DataFrame | None, items: list[str], step: int, make: Callable[[Slices], Iterator[pa.RecordBatch]], schema: T.StructType | str, empty: dict[str, float] | float = 0.0, scaler: DataFrame | None = None, cut: DataFrame | None = None, **settings) -> DataFrame:
    """What make gives of the grid of ``align``, slice by slice, with overlap more points that follow in the next slices.

    Segments between observations are what is shuffled, to slices of time; tasks fill them in as arrays of numpy, POINTS at a
    time. No grid point is shuffled, hashed or sorted. Items and empty as in ``wide``: all items make a subject's grid, those
    named have columns. settings: those of ``slices``, as first_only: a subject's first slice alone. cut: slices that are made
    already (series isn't read). scaler: items are z-scores by its one row, as of ``scale``."""
    dealt = slices(series, items, step, **settings) if cut is None else cut
    one = scaler.first() if scaler is not None else None
    mean, sd = ([float(one[f"{i}_{part}"]) if one else default for i in items] for part, default in (("mean", 0.0), ("sd", 1.0)))
    none = [float(empty[i] if isinstance(empty, dict) else empty) for i in items]

    def fill(batches):
        for batch in batches:
            subject, first, own, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            lists = batch.column(4)
            offsets, inside = lists.offsets.to_numpy(), lists.values
            fields = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(inside.type, inside.flatten(), strict=True)}
            ends, begin = np.cumsum(size), 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + POINTS, "right")))
                own_of = slice(begin, end)
                n = size[own_of]
                at = np.cumsum(n) - n
                s = {k: c[offsets[begin] : offsets[end]] for k, c in fields.items()}
                of = np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1]))
                values, masks = np.repeat(np.array(none)[:, None], n.sum(), axis=1), np.zeros((len(items), n.sum()))
                count = (s["stop"] - s["begin"]) // step + 1
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                put = np.repeat(at[of] + (s["begin"] - first[own_of][of]) // step, count) + k
                s = {name: np.repeat(c, count) for name, c in s.items()}
                g = s["begin"] + k * step
                here = g == s["t"]
                values[s["item"], put] = np.where(here, s["v"], s["va"] + s["dv"] * (g - s["a"]) / s["d"])
                masks[s["item"], put] = here | ((s["lone"] == 1) & (g == s["t"] + step))
                if one:
                    values = (values - np.array(mean)[:, None]) / np.array(sd)[:, None]
                columns = {c: x for i, item in enumerate(items) for c, x in ((item, values[i]), (f"{item}_mask", masks[i]))}
                yield from make(Slices(subject[own_of], first[own_of], own[own_of], n, at, columns))
                begin = end

    return dealt.mapInArrow(fill, schema)


def aligned_wide(series: DataFrame, items: list[str], step: int = 1, **settings) -> DataFrame:
    """The table of ``wide`` of the aligned series."""
    names = [c for i in items for c in (i, f"{i}_mask")]

    def rows(s: Slices):
        k = s.places()
        own = k < np.repeat(s.own, s.size)
        time = np.repeat(s.first, s.size) + k * step
        yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (np.repeat(s.subject, s.size), time, *(s.columns[c] for c in names))], names=["subject_id", "chart_time", *names])

    return on_grid(series, items, step, rows, _table("subject_id long, chart_time long", names), **settings)


def _table(text: str, doubles) -> str:
    return ", ".join([text, *(f"`{c}` double" for c in doubles)])


def aligned_windows(series: DataFrame, items: list[str], step: int, length: int, cells: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray]]], **settings) -> DataFrame:
    """subject_id, start and cells of each window of length grid points. cells: name -> (column, what is wanted of its windows),
    an array (windows, length) to one of (windows). Windows are views of a slice's arrays and aren't written out."""

    def found(s: Slices):
        if s.size.sum() < length:
            return
        k, n = s.places(), np.repeat(s.size, s.size)
        (at,) = np.nonzero((k < np.repeat(s.own, s.size)) & (k + length <= n))
        start = (np.repeat(s.first, s.size) + k * step)[at]
        of = [f(np.lib.stride_tricks.sliding_window_view(s.columns[c], length))[at] for c, f in cells.values()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(s.subject, s.size)[at], start, *of)], names=["subject_id", "start", *cells])

    return on_grid(series, items, step, found, _table("subject_id long, start long", cells), overlap=length - 1, **settings)


def aligned_padded(series: DataFrame, items: list[str], step: int, length: int, **settings) -> DataFrame:
    """``padded`` of the aligned series: a subject's first slice, with what follows up to length, holds its first rows."""

    def first(s: Slices):
        table = np.stack([s.columns[c] for c in (*items, *(f"{i}_mask" for i in items))], axis=1)
        own = np.minimum(s.size, length)
        steps, attention = np.zeros((len(own), length, table.shape[1])), (np.arange(length) < own[:, None]).astype("int32")
        k = s.places()
        steps[np.repeat(np.arange(len(own)), s.size)[k < length], k[k < length]] = table[k < length]
        lists = lambda x, n: pa.ListArray.from_arrays(np.arange(0, len(x) + 1, n, dtype="int32"), x)
        inner = lists(pa.array(steps.reshape(-1)), table.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(s.subject), lists(inner, length), lists(pa.array(attention.reshape(-1)), length)], names=["subject_id", "steps", "attention"])

    return on_grid(series, items, step, first, "subject_id long, steps array<array<double>>, attention array<int>", overlap=length - 1, first_only=True, **settings)


def window_length(minutes: int) -> int:
    return max(5, int(0.025 * minutes))


def windows(frame: DataFrame, items: list[str], length: int, stride: int = 1, chunk: int = 1024) -> DataFrame:
    """subject_id, start, steps: an array of length rows, each the items' values and then their masks. n - length + 1
    windows for a subject of n grid points, none if it has fewer; every stride-th of them.

    A subject's rows are gathered in chunks of bounded length, each with the first rows of the next one, and windows are
    slices of a chunk: however long a series is, a task holds one chunk of it at a time."""
    chunk = max(chunk, length)
    order = Window.partitionBy("subject_id").orderBy("chart_time")
    row = F.array(*(F.col(i) for i in items), *(F.col(f"{i}_mask") for i in items))
    numbered = frame.select("subject_id", "chart_time", row.alias("_row"), (F.row_number().over(order) - 1).cast("long").alias("_i"))
    home = F.expr(f"_i div {chunk}")
    both = F.when((F.col("_i") % chunk < length - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    chunks = numbered.withColumn("_c", F.explode(both)).groupBy("subject_id", "_c").agg(F.sort_array(F.collect_list(F.struct("_i", "chart_time", "_row"))).alias("_s"))
    parts = chunks.where(F.size("_s") >= length).select("subject_id", F.col("_c") * chunk, F.transform("_s", lambda x: x["chart_time"]).alias("_t"), F.transform("_s", lambda x: x["_row"]).alias("_r")).toDF("subject_id", "_first", "_t", "_r")
    starts = F.sequence(F.lit(0), F.least(F.lit(chunk), F.size("_r") - length + 1) - 1)
    if stride > 1:
        starts = F.filter(starts, lambda k: (F.col("_first") + k) % stride == 0)
    cut = F.transform(starts, lambda k: F.struct(F.element_at("_t", k + 1).alias("start"), F.slice("_r", k + 1, length).alias("steps")))
    return parts.select("subject_id", F.explode(cut).alias("_w")).select("subject_id", "_w.start", "_w.steps")


def fit_scaler(train: DataFrame, items: list[str]) -> DataFrame:
    """One row: mean and population deviation of each item (1 where it is 0)."""
    cells = []
    for i in items:
        sd = F.stddev_pop(i)
        cells += [F.avg(i).alias(f"{i}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{i}_sd")]
    return train.agg(*cells)


def slices_scaler(cut: DataFrame, items: list[str], step: int, empty: dict[str, float] | float = 0.0) -> DataFrame:
    """``fit_scaler`` of the grid of ``slices``: tasks give a mean and a sum of squares about it for the points in hand, so that
    the grid's rows aren't made."""

    def sums(s: Slices):
        own = s.places() < np.repeat(s.own, s.size)
        cells = []
        for i in items:
            x = s.columns[i][own]
            off = x - x[0]  # a constant's mean is itself, its squares are nil
            cells += [x[0] + off.mean(), ((off - off.mean()) ** 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(own.sum())]), *(pa.array([float(c)]) for c in cells)], names=["n", *names])

    names = [c for i in items for c in (f"{i}_mean", f"{i}_m2")]
    parts = scratch.kept(on_grid(None, items, step, sums, _table("n long", names), empty, cut=cut), "sums")
    same = lambda i: F.min(f"{i}_mean") == F.max(f"{i}_mean")
    means = parts.agg(*(F.when(same(i), F.min(f"{i}_mean")).otherwise(F.sum(F.col("n") * F.col(f"{i}_mean")) / F.sum("n")).alias(f"{i}_mean") for i in items))
    found = scalars.literals(means)
    sd = {i: F.sqrt(F.sum(F.col(f"{i}_m2") + F.col("n") * (F.col(f"{i}_mean") - found[f"{i}_mean"]) ** 2) / F.sum("n")) for i in items}
    return parts.agg(*(c for i in items for c in (F.max(found[f"{i}_mean"]).alias(f"{i}_mean"), F.when(sd[i] == 0, 1.0).otherwise(sd[i]).alias(f"{i}_sd"))))


def scale(frame: DataFrame, scaler: DataFrame, items: list[str]) -> DataFrame:
    """Items as z-scores of the scaler's one row; masks stay."""
    found = scalars.literals(scaler)
    return frame.withColumns({i: (F.col(i) - found[f"{i}_mean"]) / found[f"{i}_sd"] for i in items})


def padded(frame: DataFrame, items: list[str], length: int) -> DataFrame:
    """subject_id, steps, attention: each subject's first length rows, filled up with zeros; attention is 1 for its own."""
    row = F.array(*(F.col(i) for i in items), *(F.col(f"{i}_mask") for i in items))
    first = frame.withColumn("_i", F.row_number().over(Window.partitionBy("subject_id").orderBy("chart_time"))).where(F.col("_i") <= length)
    rows = first.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("_i", row.alias("r")))).alias("s")).select("subject_id", F.transform("s", lambda x: x["r"]).alias("s"))
    missing = F.lit(length) - F.size("s")
    zero = F.array_repeat(F.lit(0.0), 2 * len(items))
    ones, zeros = F.array_repeat(F.lit(1), F.size("s")), F.array_repeat(F.lit(0), missing)
    return rows.select("subject_id", F.concat("s", F.array_repeat(zero, missing)).alias("steps"), F.concat(ones, zeros).alias("attention"))


def positional_encoding(spark, length: int, dim: int) -> DataFrame:
    """position, encoding: even places sine, odd ones cosine of position / 10000^(2 floor(i / 2) / dim)."""
    angle = lambda i: F.col("position") / F.pow(F.lit(10000.0), 2 * F.floor(i / 2) / dim)
    cells = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
    return spark.range(length).select(F.col("id").alias("position")).withColumn("encoding", cells)


def declutter(events: DataFrame, step: float, ord_col: str = "_ord") -> DataFrame:
    """With offset: the k-th event of a subject's minute gets k * step, from 0."""
    same = Window.partitionBy("subject_id", "chart_time").orderBy("item_name", ord_col)
    return events.withColumn("offset", (F.row_number().over(same) - 1) * F.lit(step))


def timeline(operations: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """subject_id, place, chart_time, kind, item_name, value: events of all tables, the marks of operations and deaths, in
    order: place counts a subject's rows by time, then kind, item and value, and partitions are sorted so."""
    parts = [df.select("subject_id", "chart_time", F.lit(kind).alias("kind"), "item_name", F.col("value").cast("double").alias("value")) for kind, df in tables.items()]
    none = F.lit(None).cast("double").alias("value")
    for mark in ("orin_time", "orout_time", "opstart_time", "opend_time"):
        if mark in operations.columns:
            parts.append(operations.where(F.col(mark).isNotNull()).select("subject_id", F.col(mark).alias("chart_time"), F.lit("operation").alias("kind"), F.lit(mark.removesuffix("_time")).alias("item_name"), none))
    deaths = operations.where("inhosp_death_time is not null").select("subject_id", F.col("inhosp_death_time").alias("chart_time")).distinct()
    parts.append(deaths.select("subject_id", "chart_time", F.lit("death").alias("kind"), F.lit("inhosp_death").alias("item_name"), none))
    order = Window.partitionBy("subject_id").orderBy("chart_time", "kind", "item_name", F.col("value").asc_nulls_first())
    # As many partitions as the session has: by their compressed size, Spark would join them to a few. The window's sort leaves
    # rows in the order of subject and place: they aren't sorted again.
    every = reduce(DataFrame.unionByName, parts)
    dealt = every.repartition(int(operations.sparkSession.conf.get("spark.sql.shuffle.partitions")), "subject_id")
    return dealt.withColumn("place", F.row_number().over(order).cast("long")).select("subject_id", "place", "chart_time", "kind", "item_name", "value")
