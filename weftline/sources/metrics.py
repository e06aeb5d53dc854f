"""Metric texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, labels, value of each sample line of a metrics page; comments and lines without a number are passed over."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})?\s+(\S+)"
    rows = lines.filter(~F.col(column).startswith("#")).select(F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("labels"), F.regexp_extract(column, pattern, 3).try_cast("double").alias("value"))
    return rows.filter("name <> '' AND value IS NOT NULL")
