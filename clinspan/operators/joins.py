"""Joins with dimensions and between event tables, and set operations."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinspan.functions import scalars


def on_operation(vitals: DataFrame, operations: DataFrame) -> DataFrame:
    """Inner join on op_id; columns that both have get the suffix _op on the right."""
    same = {c: f"{c}_op" for c in operations.columns if c in vitals.columns and c != "op_id"}
    return vitals.join(operations.withColumnsRenamed(same), "op_id")


def with_hfrs_points(diagnoses: DataFrame, hfrs: DataFrame) -> DataFrame:
    """With points of each row's three-character cluster, 0 where it has none."""
    keyed = diagnoses.withColumn("_code", F.substring(scalars.normal_icd(F.col("icd10_cm")), 1, 3))
    points = hfrs.select(F.col("code").alias("_code"), "points")
    return keyed.join(points, "_code", "left").na.fill(0.0, ["points"]).drop("_code")


def atc_hierarchy(medications: DataFrame, atc: DataFrame, code_col: str = "atc_code") -> DataFrame:
    """With level_1..level_5 (keys), name_1..name_5 and missing: the first of levels 1 to 3 that the dimension lacks, as
    text, else null. Levels 4 and 5 may be missing. atc: one row per code, a dimension of some thousand codes."""
    out = medications.withColumns(scalars.atc_levels(F.col(code_col)))
    for i in range(1, 6):
        names = atc.select(F.col("atc_code").alias(f"level_{i}"), F.col("atc_name").alias(f"name_{i}"))
        out = out.join(names, f"level_{i}", "left")
    missing = [F.when(F.col(f"name_{i}").isNull(), F.concat(F.lit(f"level {i}: "), F.coalesce(F.col(f"level_{i}"), F.lit("none")))) for i in (1, 2, 3)]
    return out.withColumn("missing", F.coalesce(*missing))


def atc_path(hierarchy: DataFrame) -> DataFrame:
    """With path: the five names joined by |, null unless all are known."""
    names = [F.col(f"name_{i}") for i in range(1, 6)]
    known = reduce(lambda a, b: a & b, (n.isNotNull() for n in names))
    return hierarchy.withColumn("path", F.when(known, F.concat_ws("|", *names)))


def with_icd_description(diagnoses: DataFrame, icd: DataFrame) -> DataFrame:
    """With billable and description; null where the code is unknown. icd: a dimension of some ten thousand codes."""
    keyed = diagnoses.withColumn("_code", scalars.normal_icd(F.col("icd10_cm")))
    names = icd.select(scalars.normal_icd(F.col("code")).alias("_code"), "billable", "description")
    return keyed.join(names, "_code", "left").drop("_code")


#: Between codes in a text that holds them all; no code has it.
BETWEEN = "\x01"


def first_match_bounds(ranges: list[tuple[str, str, object]]) -> tuple[list[str], list]:
    """Ranges of text (first, last, what), the earlier in the list before the later, as (starts, what): from each start up to
    the next one, what is the first range's that holds the text, or None. Starts rise; ranges may overlap in any way."""
    after = lambda code: code + "\0"  # noqa: E731  the next text in order
    begin, end = {}, {}
    for i, (first, last, _) in enumerate(ranges):
        if first <= last:
            begin.setdefault(first, []).append(i)
            end.setdefault(after(last), []).append(i)
    starts, found, open_, closed = [], [], [], set()
    for at in sorted({*begin, *end}):
        closed.update(end.get(at, ()))
        for i in begin.get(at, ()):
            heapq.heappush(open_, i)
        while open_ and open_[0] in closed:
            heapq.heappop(open_)
        what = ranges[open_[0]][2] if open_ else None
        if not found or found[-1] != what:
            starts.append(at)
            found.append(what)
    return starts, found


def search(key: Column, starts: list[str]) -> Column:
    """How many of the starts (rising) aren't above key: a binary search in the JVM, one comparison for each halving. The
    starts are one constant of the plan, however many they are."""
    texts = F.split(F.lit(BETWEEN.join(starts)), BETWEEN)
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(starts).bit_length())))))
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(texts, at + half - 1) <= key, at + half).otherwise(at))


def in_ranges(key: Column, ranges: list[tuple[str, str, str]]) -> Column:
    """What the first range in the list (first, last, what) that holds key says, null without one."""
    starts, found = first_match_bounds(ranges)
    if not starts:
        return F.lit(None).cast("string")
    what = F.split(F.lit(BETWEEN.join("" if w is None else f"={w}" for w in found)), BETWEEN)
    said = F.get(what, search(key, starts) - 1)
    return F.when(key.isNotNull() & F.startswith(said, F.lit("=")), F.substr(said, F.lit(2)))


def with_chapter(diagnoses: DataFrame, chapters: DataFrame, literal: bool = False) -> DataFrame:
    """With chapter and block of the first range, in list order, that holds the code's first three characters.

    By default ranges are ordered as text. literal: letter and number are compared separately and a number of 00 or with
    a letter has no chapter. chapters: a dimension, of which the driver sorts the bounds; thousands of ranges cost a code a
    dozen comparisons, and no join is planned.
    """
    key = F.substring(scalars.normal_icd(F.col("icd10_cm")), 1, 3)
    rows = sorted(chapters.select("place", "chapter", "block", "first_code", "last_code").toLocalIterator(), key=lambda r: r["place"])
    label = lambda r: f"{r['chapter']}\t{r['block']}"
    fit = F.length(key) == 3
    if literal:  # one range of numbers for each letter
        fit = fit & key.rlike("^[A-Z][0-9]{2}$") & (F.substring(key, 2, 2) != "00")
        ranges = [(chr(c) + r["first_code"][1:], chr(c) + r["last_code"][1:], label(r)) for r in rows for c in range(ord(r["first_code"][0]), ord(r["last_code"][0]) + 1)]
    else:
        ranges = [(r["first_code"], r["last_code"], label(r)) for r in rows]
    found = F.split(in_ranges(F.when(fit, key), ranges), "\t")
    return diagnoses.withColumn("_c", found).withColumn("chapter", F.get("_c", F.lit(0))).withColumn("block", F.get("_c", F.lit(1))).drop("_c")


def with_labels(events: DataFrame, parameters: DataFrame) -> DataFrame:
    """With label text and unit of each item; the item's own name where the dimension lacks it. Of several rows of a label
    one counts (the smallest), so events aren't multiplied; the dimension may grow, the join is chosen by its size."""
    names = parameters.groupBy(F.col("label").alias("item_name")).agg(F.min(F.struct("description", "unit")).alias("_p")).select("item_name", F.col("_p.description").alias("_d"), F.col("_p.unit").alias("unit"))
    return events.join(names, "item_name", "left").withColumn("label", F.coalesce("_d", "item_name")).drop("_d")


def with_population_median(grid: DataFrame, stats: DataFrame, value_col: str = "value") -> DataFrame:
    """Null values take their item's population median. stats: one row per item."""
    medians = stats.select("item_name", F.col("median").alias("_m"))
    return grid.join(medians, "item_name", "left").withColumn(value_col, F.coalesce(value_col, "_m")).drop("_m")


def without_excluded(diagnoses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows whose code begins with none of the prefixes: an anti join on the code's own prefixes of 1 to 4 characters."""
    code = scalars.normal_icd(F.col("icd10_cm"))
    by_length = prefixes.select(F.col("prefix").alias("_p")).distinct()
    out = diagnoses
    for n in range(1, 5):
        out = out.withColumn("_p", F.when(F.length(code) >= n, F.substring(code, 1, n))).join(by_length, "_p", "left_anti").drop("_p")
    return out


def feature_mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """key, feature, left_value, right_value of cells that differ; two nulls are equal, rows of one side differ in all."""
    a = left.select(key, *(F.round(F.col(c).cast("double"), digits).alias(c) for c in columns), F.lit(True).alias("_l"))
    b = right.select(key, *(F.round(F.col(c).cast("double"), digits).alias(f"{c}_r") for c in columns), F.lit(True).alias("_r"))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("left_value"), F.col(f"{c}_r").alias("right_value")) for c in columns))
    rows = a.join(b, key, "full").withColumn("_one", F.col("_l").isNull() | F.col("_r").isNull())
    long = rows.select(key, "_one", F.explode(cells).alias("x")).select(key, "_one", "x.*")
    return long.where(F.col("_one") | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_one")


def later_source_wins(sources: list[DataFrame], ord_col: str = "_ord") -> DataFrame:
    """subject_id, item_name, chart_time, value: of equal keys the last source's, then the last in file order."""
    every = reduce(DataFrame.unionByName, [s.select("subject_id", "item_name", "chart_time", "value", F.col(ord_col).alias("_o"), F.lit(i).alias("_src")) for i, s in enumerate(sources)])
    return every.groupBy("subject_id", "item_name", "chart_time").agg(F.max_by("value", F.struct("_src", "_o")).alias("value"))


def conflicting_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """subject_id, item_name that both sources have."""
    return a.select("subject_id", "item_name").intersect(b.select("subject_id", "item_name"))


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sources; raises where an item of a subject is in both."""
    found = conflicting_items(a, b).limit(5).collect()
    if found:
        raise ValueError(f"items in both sources: {[tuple(r) for r in found]}")
    return a.unionByName(b)


def all_sources(sources: dict[str, DataFrame], ord_col: str = "_ord") -> DataFrame:
    """source, subject_id, item_name, chart_time, value: last-wins inside each source, all kept across sources."""
    parts = []
    for name, df in sources.items():
        parts.append(df.groupBy("subject_id", "item_name", "chart_time").agg(F.max_by("value", ord_col).alias("value")).withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def distinct_items(sources: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [s.select("item_name").distinct() for s in sources.values()]).distinct()


def training_rest(every: DataFrame, test: DataFrame, key: str = "subject_id") -> DataFrame:
    return every.join(test.select(key), key, "left_anti")
