"""Ranges of values by explicit cut points, so that a table made twice is cut alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiring.functions.binning import below


def cut_points(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """At most ``ranges - 1`` values that part the column into ranges of about the same number of rows."""
    n = ranges or max(2, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    numbers = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return sorted({*numbers.approxQuantile("v", [k / n for k in range(1, n)], 0.25 / n)})


def range_of(cuts: list[float], value: Column) -> Column:
    """The number of the range in which a value lies; missing values have none."""
    return F.when(F.isnan(value.cast("double")), len(cuts)).otherwise(below(cuts, value.cast("double"))) if cuts else F.when(value.isNotNull(), 0)


def running(df: DataFrame, column: str, weight: str, keys: tuple[str, ...] = (), name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over all smaller values of ``column`` within ``keys``; values must be distinct there.

    Each range is summed by itself and begins with the sums of the ranges before it, one row for each
    range and key, so no task orders all values.
    """
    dealt = df.withColumn("__range", range_of(cut_points(df, column), F.col(column)))
    inside = Window.partitionBy(*keys, "__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "__range").agg(F.sum(weight).alias("__w"))
    begins = sizes.select(*keys, "__range", F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__begin"))
    found = dealt.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(begins, [*keys, "__range"])
    return found.withColumn(name, F.col("__begin") + F.col("__inside")).drop("__range", "__inside", "__begin")
