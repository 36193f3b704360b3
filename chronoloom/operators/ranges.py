"""Running totals and neighbours over an order of all rows, without a window that brings them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows with part_, the number of the range of this order that a row is in. Spark samples the bounds, so ranges are
    about equal whatever the values; the table is cut from its lineage, as another plan would sample other bounds."""
    return cut(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))


def running(rows: DataFrame, order: list[str], by: tuple[str, ...] = (), following: str | None = None, **sums: Column | str) -> DataFrame:
    """rows with, for each name, the running total up to and with the row in this order (within by), and the whole total as
    <name>_all; with following, the next row's value of that column as next_.

    Windows run within ranges, and over one row a range. The order must be one without ties.
    """
    x = ranged(rows, *by, *order)
    totals = [F.sum(c if isinstance(c, Column) else F.col(c)).alias(f"{n}_part") for n, c in sums.items()]
    first = [F.min(following).alias("first_")] if following else []
    parts = x.groupBy(*by, "part_").agg(*totals, *first)
    upto, whole = Window.partitionBy(*by).orderBy("part_"), Window.partitionBy(*by)
    cols = [F.col(c).alias(f"{c}_by") for c in by] + [F.col("part_").alias("part_of")]
    for n in sums:
        cols += [(F.sum(f"{n}_part").over(upto) - F.col(f"{n}_part")).alias(f"{n}_before"), F.sum(f"{n}_part").over(whole).alias(f"{n}_all")]
    parts = parts.select(*cols, *([F.lead("first_").over(upto).alias("first_after")] if following else []))
    inner = Window.partitionBy(*by, "part_").orderBy(*order)
    x = x.withColumns({n: F.sum(c if isinstance(c, Column) else F.col(c)).over(inner.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()} | ({"next_": F.lead(following).over(inner)} if following else {}))
    on = F.col("part_") == F.col("part_of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_by"))
    out = x.join(parts, on).withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums} | ({"next_": F.coalesce("next_", "first_after")} if following else {}))
    return out.drop("part_", "part_of", *[f"{c}_by" for c in by], *[f"{n}_before" for n in sums], *(["first_after"] if following else []))
