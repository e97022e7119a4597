"""Running counts and sums in two levels, so that no window spans a key or a partition.

Rows are cut into ranges of an ordered number. Counts or sums of a range are partial aggregates,
those of the ranges before it come from a window over these few rows, and only then does a window
run inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range, in the unit of the number that orders rows.
WIDTH = 100_000


def running(rows: DataFrame, by: list[str], order: list[str], what: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: the sum of ``what`` over the rows of ``by`` up to and with this one, in the order of
    ``order``, whose first column is a number that is never null."""
    cut = F.floor(F.col(order[0]) / width)
    sums = rows.groupBy(*by, cut.alias("__range")).agg(F.sum(what).alias("__part"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*by, "__range", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__before"))
    start = start.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), "__before")
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut_rows = rows.withColumn("__range", cut)
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = cut_rows.join(start, same).withColumn(name, F.sum(what).over(inside) + F.col("__before"))
    return out.select(*rows.columns, name)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: the row's number among those of ``by``, from 1, in the order of ``order``."""
    return running(rows, by, order, F.lit(1).cast("long"), name, width)
