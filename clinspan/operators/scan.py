"""Running aggregates over groups of any size: inside slices of a group's order, and from slice to slice.

A window over a whole group puts it in one task. Here a group's rows stand in slices (a column that rises with the order),
each slice has its own window, and one row for each slice hands on what came before it. So a task holds one slice of a
group's rows at a time, and of the group itself only one row for each slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], slice_col: str, order: list, sums: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column], object]]) -> DataFrame:
    """rows with a column for each of sums: name -> (value, aggregate, how two aggregates combine, the one of no rows), over
    the group's rows up to and with the own one. Columns of by and slice_col aren't null."""
    inside = Window.partitionBy(*by, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, slice_col).agg(*(aggregate(value).alias(f"_t_{name}") for name, (value, aggregate, _, _) in sums.items()))
    bases = totals.select(*by, slice_col, *(F.coalesce(aggregate(F.col(f"_t_{name}")).over(before), F.lit(none)).alias(f"_b_{name}") for name, (_, aggregate, _, none) in sums.items()))
    own = rows.withColumns({f"_i_{name}": aggregate(value).over(inside) for name, (value, aggregate, _, _) in sums.items()})
    both = own.join(bases, [*by, slice_col])
    out = both.withColumns({name: combine(F.col(f"_b_{name}"), F.col(f"_i_{name}")) for name, (_, _, combine, _) in sums.items()})
    return out.drop(*(f"{p}{name}" for name in sums for p in ("_i_", "_b_")))
