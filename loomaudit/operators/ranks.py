"""Places in sorted groups, found without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomaudit.operators.graph import stored


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with `place`, from 0 in the order of `order` (ties in any), and `size` of their group.

    The rows are sorted over all groups into ranges, so that a large group lies in many of them. A place is the rows of the group in earlier ranges, summed over a table of one row for each range and group, and those before it in its own range."""
    ranged = rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id())
    kept = stored(ranged, "ranges")
    sizes = kept.groupBy("part", *group).agg(F.count("*").alias("here"))
    whole = Window.partitionBy(*group)
    before = sizes.select("part", *group, (F.sum("here").over(whole.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("size"))
    # Group keys may be null, which an equality does not match.
    on = ["part", *(f"{g}_key" for g in group)]
    keyed = before.select("part", *(F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"{g}_key") for g in group), "before", "size")
    n = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order)) - 1
    own = kept.withColumn("n", n).withColumns({f"{g}_key": F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group})
    return own.join(keyed, on).withColumn("place", (F.col("before") + F.col("n")).cast("bigint")).drop(*on, "before", "n")
