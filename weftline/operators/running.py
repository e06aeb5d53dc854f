"""Running sums over all rows of a table without one task that meets them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running_sums(rows: DataFrame, order: list[str], value: str | None = None, name: str = "before") -> DataFrame:
    """Adds `name`: the sum of `value` (or the number) of the rows before each, in order.

    Ranges of rows are summed up by themselves, and a range begins with the sum of those before it; only a number for each
    range reaches the driver.
    """
    spark, v = rows.sparkSession, F.col(value).cast("double") if value else F.lit(1).cast("long")
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    parts = own.withColumn("_part", F.shiftright("_place", 33).cast("int"))
    totals = {r._part: r.total for r in parts.groupBy("_part").agg(F.sum(v).alias("total")).collect()}
    starts, seen = [], 0.0 if value else 0
    for part in sorted(totals):
        starts.append((part, seen))
        seen += totals[part] or 0
    kind = "double" if value else "long"
    at = spark.createDataFrame(starts, f"_part int, _start {kind}")
    if value is None:
        inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    else:
        inside = F.coalesce(F.sum(v).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("_inside", inside).join(F.broadcast(at), "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_place", "_inside", "_start")
