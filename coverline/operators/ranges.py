"""Running sums and numbers over groups of any size, by ranges of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverline.session import cut


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of a value within keys, by ranges of (keys, order) and the sums of the ranges before, so that no key is put into one task.

    Null keys are groups of their own; an empty frame stays empty; rows equal in keys and order get sums in either order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(width, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = ranged.groupBy(*keys, "_p").agg(F.sum(value).alias("_s"))  # at most one row for each key and one for each range
    before = before.withColumn("_b", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    here = F.sum(value).over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_p"]]
    joined = ranged.withColumn(name, here).alias("r").join(before.alias("b"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{name}") + F.col("b._b")).alias(name))
