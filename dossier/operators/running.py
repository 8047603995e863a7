"""Running counts and sums by key without a task for a whole key.

Rows are dealt into ranges of their order, about ``RANGE_ROWS`` each, and written with the number of their range. A running sum is then the
sum of the key's earlier ranges (one row for each range that it has) and the sum inside its range, so a key that holds a third of all
rows is spread over as many tasks as ranges. Rows that are equal in the order lie in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.sources.shared import materialize

RANGE_ROWS = 65_536


def ranged(df: DataFrame, order: list[Column], rows: int = RANGE_ROWS) -> DataFrame:
    """df with __range, the number of the range of the order that a row lies in."""
    n = max(1, df.count() // rows)
    return materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, key: list[Column], order: list[Column], name: str, value: Column | None = None) -> DataFrame:
    """A table of ranged() with a running count of the rows of a key, or sum of a value, this row included. A null is a key too."""
    value = F.lit(1).cast("long") if value is None else value
    keyed = df.withColumns({"__key": F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]), {"ignoreNullFields": "false"}), "__value": value})
    parts = keyed.groupBy("__key", "__range").agg(F.sum("__value").alias("__sum"))
    ahead = F.sum("__sum").over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__key", "__range", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    inside = F.sum("__value").over(Window.partitionBy("__key", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = keyed.withColumn("__inside", inside).join(parts, ["__key", "__range"])
    return found.withColumn(name, F.col("__ahead") + F.coalesce("__inside", F.lit(0))).drop("__key", "__value", "__inside", "__ahead")
