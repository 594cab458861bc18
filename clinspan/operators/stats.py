"""Counts, population statistics and distributions. Quantiles are exact, and no task holds all values of an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspan.functions import scalars, scores
from clinspan.sources import readers, scratch

#: Accuracy of the approximate quantiles that bracket the exact ones, and how far the brackets reach, as a share of the rows.
ACCURACY, BRACKET = 10_000, 0.0005
#: Groups of up to so many values are sorted in one task at once. Above, a bracket reaches five ranks or more and the
#: approximate quantile is off by a fifth of that at most, so that the bracket holds its quantile.
SMALL = 10_000


def operations_per_subject(operations: DataFrame) -> DataFrame:
    return operations.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_operations"))


def operation_totals(operations: DataFrame) -> DataFrame:
    per = operations_per_subject(operations)
    return per.agg(F.count(F.lit(1)).alias("subjects"), F.sum("n_operations").alias("operations"), F.count_if(F.col("n_operations") > 1).alias("several"))


def item_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """source, item_name, n."""
    counts = [df.groupBy("item_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "item_name", "n") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, counts)


def chart_range(operations: DataFrame, events: list[DataFrame]) -> DataFrame:
    """subject_id, first_time, last_time over orin_time and the chart_time of each table."""
    times = [operations.select("subject_id", F.col("orin_time").alias("t")), *(e.select("subject_id", F.col("chart_time").alias("t")) for e in events)]
    return reduce(DataFrame.unionByName, times).groupBy("subject_id").agg(F.min("t").alias("first_time"), F.max("t").alias("last_time"))


def series_length(subjects: DataFrame, series: DataFrame) -> DataFrame:
    """subject_id, minutes from the first to the last observation; null without any."""
    spans = series.groupBy("subject_id").agg((F.max("chart_time") - F.min("chart_time")).alias("minutes"))
    return subjects.select("subject_id").distinct().join(spans, "subject_id", "left")


def longest_series(series: DataFrame, cap: int | None = 1440) -> DataFrame:
    """One row: the largest number of minutes (last - first + 1) of a subject, at most cap."""
    spans = series.groupBy("subject_id").agg((F.max("chart_time") - F.min("chart_time") + 1).alias("n"))
    longest = F.max("n")
    return spans.agg((F.least(longest, F.lit(cap)) if cap else longest).alias("length"))


def quantiles(values: DataFrame, by: list[str], at: tuple[float, ...] = (0.5,), value_col: str = "value") -> DataFrame:
    """by, n, q: the exact quantiles (an array, linear between neighbours) of each group's values that aren't null.

    Approximate quantiles a little below and above each wanted one bracket it; a second pass counts the values below a
    bracket and sorts only those inside, about a thousandth of the rows, so that a group may hold any number of rows and of
    distinct values. Groups of up to SMALL values skip this and are sorted at once, as would be a group whose bracket
    missed its quantile (which other accuracies than those above may cause).
    """
    known = values.select(*by, F.col(value_col).cast("double").alias("_v")).where("_v is not null")
    ends = [max(0.0, min(1.0, q + side * BRACKET)) for q in at for side in (-1, 1)]
    facts = known.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_ends"))
    facts = scratch.kept(facts, "brackets")
    at_place = F.array(*(F.lit(float(q)) for q in at))

    def sorted_whole(groups: DataFrame) -> DataFrame:
        keys = groups.select(*(F.col(c).alias(f"_k_{c}") for c in by))
        rows = known.join(keys, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], "left_semi") if by else known
        return rows.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile("_v", at_place).alias("q"))

    small, facts = facts.where(F.col("n") <= SMALL), facts.where(F.col("n") > SMALL)
    if facts.isEmpty():
        return sorted_whole(small)
    # Per row and quantile: null if below its bracket, else the value; rows above it are left out.
    right = facts.withColumnsRenamed({c: f"_k_{c}" for c in by})
    rows = known.join(right, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]) if by else known.join(right)
    spots = F.transform(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda i: F.when(F.col("_v") <= F.element_at("_ends", i * 2 + 2), F.struct(i.alias("i"), F.when(F.col("_v") >= F.element_at("_ends", i * 2 + 1), F.col("_v")).alias("v"))))
    counts = rows.select(*by, "n", F.explode(F.filter(spots, lambda x: x.isNotNull())).alias("_x")).groupBy(*by, "n", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by, "n", "_i").orderBy(F.col("_v").asc_nulls_first()))
    place = F.element_at(at_place, F.col("_i") + 1) * (F.col("n") - 1)
    ranked = counts.withColumns({"_upto": upto, "_p": place})
    # The values of the ranks on both sides of the place; null where a bracket lies beside it.
    first = ranked.groupBy(*by, "n", "_i", "_p").agg(*(F.min(F.when(F.col("_upto") > f(F.col("_p")), F.struct("_upto", "_v"))).alias(n) for n, f in (("_a", F.floor), ("_b", F.ceil))))
    value = F.col("_a._v") + (F.col("_p") - F.floor("_p")) * (F.col("_b._v") - F.col("_a._v"))
    out = first.groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.struct("_i", value.alias("v")))).alias("_q"))
    out = scratch.kept(out.select(*by, "n", F.transform("_q", lambda x: x["v"]).alias("q")), "quantiles")
    fit = ~F.exists("q", lambda x: x.isNull())
    if not small.isEmpty():
        whole = sorted_whole(small).unionByName(out.where(fit))
    else:
        whole = out.where(fit)
    return whole if out.where(~fit).isEmpty() else whole.unionByName(sorted_whole(out.where(~fit)))


def population_stats(values: DataFrame, least: int = 2) -> DataFrame:
    """item_name, mean, stdev (sample), median, mad, length of items with at least so many values."""
    # Written once, narrow: five passes read it, and what comes before (last value of each minute) isn't done again.
    known = scratch.kept(values.where("value is not null").select("item_name", F.col("value").cast("double").alias("value")), "values")
    moments = known.groupBy("item_name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), F.count("value").alias("length"))
    medians = quantiles(known, ["item_name"]).select("item_name", F.col("q")[0].alias("median"))
    around = known.join(medians, "item_name").select("item_name", F.abs(F.col("value") - F.col("median")).alias("value"))
    mads = quantiles(around, ["item_name"]).select("item_name", F.col("q")[0].alias("mad"))
    out = moments.where(F.col("length") >= least).join(medians, "item_name").join(mads, "item_name")
    return scratch.kept(out.select("item_name", "mean", "stdev", "median", "mad", "length"), "population")


def z_scores(values: DataFrame, stats: DataFrame) -> DataFrame:
    """values with z = (value - mean) / stdev; null where stdev is 0. The statistics come from one aggregate, joined back
    by item, not from a window that would put an item in one task."""
    facts = stats.select("item_name", "mean", "stdev")
    return values.join(facts, "item_name").withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("stdev"))).drop("mean", "stdev")


def modified_z_scores(values: DataFrame, stats: DataFrame, fallback: bool = False, outlier: float = 3.5) -> DataFrame:
    """values with modified_z and outlier. fallback: the classical z where MAD is 0."""
    facts = stats.select("item_name", "mean", "stdev", "median", "mad")
    out = values.join(facts, "item_name")
    score = scores.modified_z(F.col("value"), F.col("median"), F.col("mad"))
    if fallback:
        score = F.coalesce(score, F.try_divide(F.col("value") - F.col("mean"), F.col("stdev")))
    return out.withColumn("modified_z", score).withColumn("outlier", F.coalesce(F.abs("modified_z") > outlier, F.lit(False))).drop("mean", "stdev", "median", "mad")


def standardised_in_subject(series: DataFrame) -> DataFrame:
    """z within one subject's item."""
    own = Window.partitionBy("subject_id", "item_name")
    return series.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(own), F.stddev_samp("value").over(own)))


def frailty_scores(subjects: DataFrame, diagnoses_with_points: DataFrame, distinct_codes: bool = False) -> DataFrame:
    """subject_id, hfrs, category: points of every diagnosis row, repeats counted again, or with distinct_codes each of a
    subject's codes (of three characters) once."""
    if distinct_codes:
        code = F.substring(scalars.normal_icd(F.col("icd10_cm")), 1, 3).alias("code")
        diagnoses_with_points = diagnoses_with_points.select("subject_id", code, "points").distinct()
    sums = diagnoses_with_points.groupBy("subject_id").agg(F.sum("points").alias("hfrs"))
    out = subjects.select("subject_id").distinct().join(sums, "subject_id", "left")
    score = F.coalesce(F.round("hfrs", 6), F.lit(0.0))
    return out.select("subject_id", score.alias("hfrs"), scores.frailty_category(score, F.col("hfrs").isNotNull()).alias("category"))


def box_stats(values: DataFrame, by: list[str]) -> DataFrame:
    """q1, median, q3, low and high whisker (furthest values within 1.5 IQR of the box), n per group."""
    known = scratch.kept(values.where("value is not null").select(*by, "value"), "values")  # three passes read it
    q = quantiles(known, by, (0.25, 0.5, 0.75))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = known.join(q, by).where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach))
    whiskers = inside.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return q.join(whiskers, by)


def histogram(values: DataFrame, bins: int, value_col: str = "value") -> DataFrame:
    """bin (0 to bins - 1), low, high, n; the last bin holds its upper edge; empty bins are listed."""
    v = F.col(value_col).cast("double")
    ends = scalars.literals(values.agg(F.min(v).alias("a"), F.max(v).alias("b")))
    rows = values.where(v.isNotNull()).withColumns(ends)
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((v - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumns(ends)
    out = every.join(counts, "bin", "left")
    return out.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """r, n; r is null for fewer than two rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.when(F.count(F.lit(1)) > 1, F.corr(a, b)).alias("r"), F.count(F.lit(1)).alias("n"))


CATEGORIES = ("low", "intermediate", "high", "unknown (no diagnoses)")


def frailty_by_outcome(labelled: DataFrame) -> DataFrame:
    """category, survived, died, total, died_pct of (category, outcome); every category has a row."""
    spark = labelled.sparkSession
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = labelled.groupBy("category").agg(F.count_if(F.col("outcome") == "survived").alias("survived"), F.count_if(F.col("outcome") == "died").alias("died"))
    out = every.join(counts, "category", "left").na.fill(0, ["survived", "died"])
    total = F.col("survived") + F.col("died")
    return out.withColumn("total", total).withColumn("died_pct", F.round(F.try_divide(F.col("died") * 100.0, F.col("total")), 6))


def unexpected_labels(labelled: DataFrame) -> DataFrame:
    """One row: rows of (category, outcome) with another category, and of the rest with another outcome, after
    normalisation."""
    fit = scalars.normal_frailty(F.col("category")).isin(*CATEGORIES)
    known = scalars.normal_outcome(F.col("outcome")).isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return labelled.agg(count(~F.coalesce(fit, F.lit(False))).alias("unexpected_category"), count(fit & ~known).alias("unexpected_outcome"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def class_balance(labels: DataFrame, label: Column) -> DataFrame:
    """survived, died, died_of_all, died_to_survived, positive_weight (survived to died, 1 if none died)."""
    died, survived = F.count_if(label), F.count_if(~label)
    return labels.agg(survived.alias("survived"), died.alias("died"), F.try_divide(died, died + survived).alias("died_of_all"), F.try_divide(died, survived).alias("died_to_survived"), F.coalesce(F.try_divide(survived, died), F.lit(1.0)).alias("positive_weight"))


def loader_counts(subjects: DataFrame, operations: DataFrame, series: DataFrame, least: int = 2) -> DataFrame:
    """loaded, no_operation, too_sparse."""
    has = operations.select("subject_id").distinct().withColumn("has", F.lit(True))
    n = series.groupBy("subject_id").agg(F.count("value").alias("n"))
    flags = subjects.select("subject_id").distinct().join(has, "subject_id", "left").join(n, "subject_id", "left")
    op, few = F.col("has").isNotNull(), F.coalesce("n", F.lit(0)) < least
    return flags.agg(F.count_if(op & ~few).alias("loaded"), F.count_if(~op).alias("no_operation"), F.count_if(op & few).alias("too_sparse"))


def parameter_conflicts(parameters: DataFrame) -> DataFrame:
    """label, unit, description, first_unit, first_description of later rows that differ from their label's first."""
    first = parameters.groupBy("Label").agg(F.min_by(F.struct("Unit", "Description"), "_ord").alias("f"))
    rows = parameters.join(first, "Label")
    differ = ~(F.col("Unit").eqNullSafe(F.col("f.Unit")) & F.col("Description").eqNullSafe(F.col("f.Description")))
    return rows.where(differ).select(F.col("Label").alias("label"), F.col("Unit").alias("unit"), F.col("Description").alias("description"), F.col("f.Unit").alias("first_unit"), F.col("f.Description").alias("first_description"))


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, n_columns."""
    rows = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def table_heads(tables: dict[str, DataFrame], k: int = 2) -> DataFrame:
    """table, place, head: the first k rows of each table in the order of its files, as JSON objects; tables are as read."""
    rows = []
    for name, df in tables.items():
        first = readers.first_rows(df, k)
        rows.append(first.select(F.lit(name).alias("table"), "place", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("head")))
    return reduce(DataFrame.unionByName, rows)


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_missing, share: all columns in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in columns))
    return one.select("_n", F.explode(cells).alias("x")).select("x.feature", "x.n_missing", F.try_divide(F.col("x.n_missing"), F.col("_n")).alias("share"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of each pair a < b over rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))
    return one.select(F.explode(cells).alias("x")).select("x.*")


def bucket_medians(series: DataFrame, minutes: int = 5) -> DataFrame:
    """subject_id, item_name, bucket, value: the median of each bucket of so many minutes."""
    bucket = (F.floor(F.col("chart_time") / minutes) * minutes).alias("bucket")
    return series.groupBy("subject_id", "item_name", bucket).agg(F.median("value").alias("value"))
