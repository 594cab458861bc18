"""As-of joins: for each left row the most recent earlier value of several items, in one pass.

Left and right rows are united and one window per subject and time slice, ordered by time, carries the last value of every
item forward. What came before a slice is one row for each slice of a subject: the last value of each item in it, carried on
by a window over those rows. So a subject of any length is dealt to as many tasks as it has slices; right rows of one time
are reduced first, so a slice holds at most one for each of its minutes and items. The tolerance is tested afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.sources import scratch


#: Minutes of a slice: a task of a join holds those of one subject at a time.
SLICE = 30 * 24 * 60


def first_at_each_time(events: DataFrame, ord_col: str = "_ord") -> DataFrame:
    """subject_id, item_name, chart_time, value: of equal times the first in file order."""
    return events.where("chart_time is not null").groupBy("subject_id", "item_name", "chart_time").agg(F.min_by("value", ord_col).alias("value"))


def asof_items(left: DataFrame, events: DataFrame, items: list[str], time_col: str = "orin_time", tolerance: int | None = None, exact: bool = True, prefix: str = "preop_", ord_col: str = "_ord", with_times: bool = False, slice_minutes: int = SLICE, buckets: int | None = None) -> DataFrame:
    """left with one column prefix + item for each item: its value at the latest chart_time not after time_col.

    tolerance: values older than that are null. exact=False: only earlier times count. A right row with a null value is a
    match with null. with_times adds prefix + item + _at, the time of the match. Left rows without a subject or time are kept with nulls; items no row has are null.
    buckets: events are a table of so many buckets by subject_id; left rows are dealt in the same way, and events stay
    where they are (all slices of a subject in the task of its bucket, one after the other).
    """
    right = first_at_each_time(events.where(F.col("item_name").isin(items)), ord_col).where("subject_id is not null")
    columns = left.columns
    timed = F.col("subject_id").isNotNull() & F.col(time_col).isNotNull()
    place = F.floor(F.col("_t") / slice_minutes).alias("_slice")
    # Right rows stand before left ones of their time, unless only earlier ones count.
    dealt = left.repartition(buckets, "subject_id") if buckets else left
    rows = dealt.where(timed).select(F.col("subject_id").alias("_s"), F.col(time_col).alias("_t"), F.lit(1 if exact else 0).alias("_side"), F.struct(*columns).alias("_left"), F.lit(None).cast("string").alias("_item"), F.lit(None).cast("double").alias("_value"))
    side = F.lit(0 if exact else 1)
    more = right.select(F.col("subject_id").alias("_s"), F.col("chart_time").alias("_t"), side.alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.col("item_name").alias("_item"), F.col("value").cast("double").alias("_value"))
    window = Window.partitionBy("_s", "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {f"_c{i}": F.last(F.when(F.col("_item") == item, F.struct("_t", "_value")), ignorenulls=True).over(window) for i, item in enumerate(items)}
    found = rows.unionByName(more).select("*", place).withColumns(carried).where("_left is not null")
    # One row for each slice of a subject: its last value of each item, and then those of the slices before.
    last = [F.max(F.when(F.col("_item") == item, F.struct("_t", "_value"))).alias(f"_m{i}") for i, item in enumerate(items)]
    ends = more.select("_s", place, "_t", "_item", "_value").groupBy("_s", "_slice").agg(*last)
    asked = rows.select("_s", place).distinct()
    before = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = asked.join(ends, ["_s", "_slice"], "full").select("_s", "_slice", *(F.last(f"_m{i}", ignorenulls=True).over(before).alias(f"_b{i}") for i in range(len(items))))
    found = found.join(handed, ["_s", "_slice"], "left").withColumns({f"_c{i}": F.coalesce(f"_c{i}", f"_b{i}") for i in range(len(items))})

    def value(i: int) -> Column:
        age = F.col("_t") - F.col(f"_c{i}._t")
        return F.col(f"_c{i}._value") if tolerance is None else F.when(age <= tolerance, F.col(f"_c{i}._value"))

    times = [F.col(f"_c{i}._t").alias(f"{prefix}{item}_at") for i, item in enumerate(items)] if with_times else []
    out = found.select("_left.*", *(value(i).alias(f"{prefix}{item}") for i, item in enumerate(items)), *times)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields[len(columns) :]]
    return out.unionByName(left.where(~timed).select(*columns, *none))


def nearest_preceding(left: DataFrame, events: DataFrame, item: str, time_col: str = "orin_time", ord_col: str = "_ord") -> DataFrame:
    """left with value_at (time) and value: strictly before time_col."""
    found = asof_items(left, events.where(F.col("item_name") == item), [item], time_col, exact=False, prefix="_", ord_col=ord_col, with_times=True)
    return found.withColumnsRenamed({f"_{item}": "value", f"_{item}_at": "value_at"})


def displaced(events: DataFrame, ord_col: str = "_ord") -> DataFrame:
    """Events with chart_time moved to the first free earlier minute where an earlier row (by file order) of the same
    subject and item holds it. Rows without a time stay as they are; ord_col's values are distinct.

    Which minutes are taken doesn't depend on the order: of rows sorted from late to early, the i-th has the minute after
    the last one's or its own. That cuts a series into runs that don't touch each other. Rows of a run of one minute are
    numbered in file order. Longer runs are halved by file order, all at once, until each has one row: the first half takes
    its minutes as if alone, the second has the minutes that are left, and a row's wish is numbered anew among the minutes
    of its half. Rounds are the logarithm of the longest run; a run stays in the task of its first shuffle, where it is
    sorted, never held.
    """
    by = ["subject_id", "item_name"]
    kind = events.schema["chart_time"].dataType
    # Places count backwards in time: a row takes the first free place from its own on.
    rows = events.select(*by, F.struct(*events.columns).alias("_e"), (-F.col("chart_time").cast("long")).alias("_w"), F.col(ord_col).alias("_o"))
    upto = Window.partitionBy(*by).orderBy("_w", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.where("_w is not null").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_w", "_o"))).withColumn("_at", F.col("_i") + F.max(F.col("_w") - F.col("_i")).over(upto))
    own = Window.partitionBy(*by, "_first")
    runs = placed.withColumn("_first", F.last(F.when(F.col("_at") == F.col("_w"), F.col("_w")), ignorenulls=True).over(upto))
    runs = runs.withColumns({"_r": F.row_number().over(own.orderBy("_o")) - 1, "_far": F.max("_w").over(own) - F.col("_first"), "_n": F.count(F.lit(1)).over(own)})
    runs = scratch.kept(runs.select(*by, "_e", "_first", (F.col("_w") - F.col("_first")).alias("_w"), F.col("_r").cast("long").alias("_r"), "_far", "_n"), "runs")

    def moved(df: DataFrame, time: Column) -> DataFrame:
        return df.select(*((-time).cast(kind).alias(c) if c == "chart_time" else F.col(f"_e.`{c}`").alias(c) for c in events.columns))

    out = moved(runs.where("_far = 0"), F.col("_first") + F.col("_r")).unionByName(events.where("chart_time is null"))
    mixed = runs.where("_far > 0")
    longest = mixed.agg(F.max("_n")).first()[0]
    return out if longest is None else out.unionByName(moved(*_halved(mixed, by, longest)))


def _halved(runs: DataFrame, by: list[str], longest: int) -> tuple[DataFrame, Column]:
    """Rows of runs with the place that each takes: runs of by and _first, with wishes _w (from 0) and ranks _r."""
    by = [*by, "_first"]
    rounds = (longest - 1).bit_length()
    # Each row twice: as itself (_p: its wish) and as the run's place of its rank (_p: that place among its half's, _at: as it was).
    row = F.struct(F.lit(False).alias("cell"), F.col("_w").alias("p"), F.col("_r").alias("r"), F.lit(None).cast("long").alias("at"), F.col("_e").alias("e"))
    cell = F.struct(F.lit(True).alias("cell"), F.col("_r").alias("p"), F.lit(None).cast("long").alias("r"), (F.col("_first") + F.col("_r")).alias("at"), F.when(F.lit(False), F.col("_e")).alias("e"))
    parts = runs.repartition(*by).select(*by, F.explode(F.array(row, cell)).alias("x"))
    parts = parts.select(*by, F.lit(0).cast("long").alias("_s"), F.col("x.cell").alias("_cell"), F.col("x.p").alias("_p"), F.col("x.r").alias("_r"), F.col("x.at").alias("_at"), F.col("x.e").alias("_e"))
    for left in reversed(range(rounds)):
        half = F.expr(f"CASE WHEN NOT _cell THEN shiftright(_r, {left}) & 1 END")
        parts = parts.withColumn("_h", half)
        order = Window.partitionBy(*by, "_s", "_h").orderBy("_p", "_r")
        parts = parts.withColumn("_i", F.row_number().over(order))
        parts = parts.withColumn("_takes", F.when(F.col("_h") == 0, F.col("_i") + F.max(F.col("_p") - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
        # Places that the first half takes, as marks beside the places themselves.
        spots = F.when(F.col("_h") == 0, F.array(F.lit(None).cast("long"), F.col("_takes"))).otherwise(F.array(F.lit(None).cast("long")))
        parts = parts.withColumn("_mark", F.explode(spots)).withColumn("_p", F.coalesce("_mark", "_p"))
        taken = F.max(F.col("_mark").isNotNull()).over(Window.partitionBy(*by, "_s", "_p"))
        parts = parts.withColumn("_h", F.when(F.col("_cell"), F.when(taken, 0).otherwise(1)).otherwise(F.col("_h"))).where("_mark is null")
        before = Window.partitionBy(*by, "_s", "_h").orderBy("_p", "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = F.sum(F.col("_cell").cast("long")).over(before) - F.col("_cell").cast("long")
        parts = parts.withColumn("_p", cells).select(*by, (F.col("_s") * 2 + F.col("_h")).alias("_s"), "_cell", "_p", "_r", "_at", "_e")
    there = parts.withColumn("_at", F.max("_at").over(Window.partitionBy(*by, "_s")))
    return there.where("NOT _cell"), F.col("_at")
