"""Population statistics that are kept and added to.

A store holds counts: how often each item has each value, and for each of many narrow ranges of an item's values how many
there are, their sum, squares, least and largest. Counts of several days add up, so a new day is one more part beside the
others, and nothing that was counted is read again as rows. Medians and median deviations are refined from the ranges: the
ranges' counts tell which few of them hold the middle, and only the counts of values in those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinspan.sources import scratch

#: Ranges of values for each factor e between them; zero, and each sign, have their own.
RANGES_PER_E = 100
#: Above the logarithm of any double, in ranges: numbers of ranges of positive values are positive.
OFFSET = 75_000
VALUES = "item_name string, range long, value double, n long"
RANGES = "item_name string, range long, n long, total double, squares double, low double, high double"


def range_of(value: Column) -> Column:
    """The number of the range that holds the value: rises with it, and is the same in every run."""
    size = F.when(F.abs(value) == float("inf"), F.lit(2 * OFFSET)).otherwise(OFFSET + F.floor(F.ln(F.abs(value)) * RANGES_PER_E))
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def add(values: DataFrame, store: str, part: str) -> None:
    """Counts the values (item_name, value; null and NaN ones are left out) as one part of the store, a folder; a part of that
    name is replaced, so adding a day again changes nothing. Values of one minute have to be reduced before."""
    known = values.select(F.col("item_name").cast("string"), F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    counts = known.groupBy("item_name", "value").agg(F.count(F.lit(1)).alias("n")).select("item_name", range_of(F.col("value")).alias("range"), "value", "n")
    folder = f"{store}/values/part={part}"
    counts.write.mode("overwrite").parquet(folder)
    counts = values.sparkSession.read.schema(VALUES).parquet(folder)
    total, n = F.sum(F.col("value") * F.col("n")), F.sum("n")
    sums = counts.groupBy("item_name", "range").agg(n.alias("n"), total.alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    # Squares about the range's own mean, so that adding them up loses nothing.
    sums = scratch.kept(sums, "sums")
    means = sums.select(F.col("item_name").alias("_i"), F.col("range").alias("_r"), (F.col("total") / F.col("n")).alias("mean"))
    about = counts.join(means, F.col("item_name").eqNullSafe(F.col("_i")) & (F.col("range") == F.col("_r")))
    squares = about.groupBy("_i", "_r").agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)).alias("squares"))
    both = sums.join(squares, F.col("item_name").eqNullSafe(F.col("_i")) & (F.col("range") == F.col("_r")))
    both.select("item_name", "range", "n", "total", "squares", "low", "high").write.mode("overwrite").parquet(f"{store}/ranges/part={part}")


def _read(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part string").parquet(f"{store}/{table}").drop("part")


def ranges(spark: SparkSession, store: str) -> DataFrame:
    """One row for each item and range over all parts of the store."""
    parts = _read(spark, store, "ranges", RANGES)
    n, total = F.sum("n"), F.sum("total")
    squares = F.sum("squares") + F.sum(F.col("total") * F.col("total") / F.col("n")) - total * total / n
    return parts.groupBy("item_name", "range").agg(n.alias("n"), total.alias("total"), F.greatest(squares, F.lit(0.0)).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def _middle(counts: DataFrame, by: str, out: str) -> DataFrame:
    """item_name and the mean of the middle two of counted values: column by with counts m, of which before come ahead; of n."""
    upto = F.sum("m").over(Window.partitionBy("item_name").orderBy(by)) + F.col("before")
    ranked = counts.withColumn("_upto", upto)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(by)))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return ranked.groupBy("item_name").agg(((low + high) / 2).alias(out))


def _refined(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """Counts of the values in the wanted ranges of items: the columns of wanted, value and how often it is there."""
    values = _read(spark, store, "values", VALUES).withColumnsRenamed({"item_name": "_i", "range": "_r", "n": "_n"})
    rows = values.join(wanted, (F.col("_i") == F.col("item_name")) & (F.col("_r") == F.col("range")))
    return rows.groupBy(*(c for c in wanted.columns if c != "range"), "value").agg(F.sum("_n").alias("m"))


def stats(spark: SparkSession, store: str, least: int = 2) -> DataFrame:
    """item_name, mean, stdev (sample), median, mad, length of items with at least so many values, exact, from the store."""
    found = scratch.kept(ranges(spark, store).where("item_name is not null"), "ranges")
    item = Window.partitionBy("item_name")
    # Items have some hundreds of ranges; windows see these, not values.
    placed = found.withColumns({"size": F.sum("n").over(item), "upto": F.sum("n").over(item.orderBy("range"))})
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    ahead = F.col("upto") - F.col("n")
    holds = ((ahead <= low) & (low < F.col("upto"))) | ((ahead <= high) & (high < F.col("upto")))
    middle = placed.where(holds).withColumn("before", F.min(ahead).over(item)).select("item_name", "range", "before", F.col("size").alias("n"))
    medians = scratch.kept(_middle(_refined(spark, store, middle), "value", "median"), "medians")
    # Distances from the median: each range's lie between near and far.
    m, zero = F.col("median"), F.lit(0.0)
    spread = found.join(medians, "item_name").withColumns({"near": F.greatest(zero, F.col("low") - m, m - F.col("high")), "far": F.greatest(F.abs(F.col("low") - m), F.abs(F.col("high") - m)), "size": F.sum("n").over(item)})
    counted = spread.withColumns({"by_near": F.sum("n").over(item.orderBy("near")), "by_far": F.sum("n").over(item.orderBy("far"))})
    # Not below the first, not above the second are the middle distances.
    bounds = counted.withColumns({"least": F.min(F.when(F.col("by_near") > low, F.col("near"))).over(item), "most": F.min(F.when(F.col("by_far") > high, F.col("far"))).over(item)})
    below = F.coalesce(F.sum(F.when(F.col("far") < F.col("least"), F.col("n"))).over(item), F.lit(0))
    around = bounds.withColumn("before", below).where("near <= most and far >= least").select("item_name", "range", "before", F.col("size").alias("n"), "median")
    distances = _refined(spark, store, around).withColumn("distance", F.abs(F.col("value") - m)).groupBy("item_name", "before", "n", "distance").agg(F.sum("m").alias("m"))
    mads = _middle(distances, "distance", "mad")
    n, total = F.sum("n"), F.sum("total")
    squares = F.sum("squares") + F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("mean"), 2))
    means = found.groupBy("item_name").agg((total / n).alias("mean"), n.alias("length"))
    deviations = found.join(means.drop("length"), "item_name").groupBy("item_name").agg(F.sqrt(squares / F.nullif(n - 1, F.lit(0))).alias("stdev"))
    out = means.where(F.col("length") >= least).join(deviations, "item_name").join(medians, "item_name").join(mads, "item_name")
    return scratch.kept(out.select("item_name", "mean", "stdev", "median", "mad", "length"), "kept-stats")


def compact(spark: SparkSession, store: str, to: str, part: str = "all") -> None:
    """A new store at ``to`` that holds the counts of all parts of store as one; readers of the old one aren't disturbed."""
    values = _read(spark, store, "values", VALUES).groupBy("item_name", "range", "value").agg(F.sum("n").alias("n"))
    values.write.parquet(f"{to}/values/part={part}")
    ranges(spark, store).write.parquet(f"{to}/ranges/part={part}")
