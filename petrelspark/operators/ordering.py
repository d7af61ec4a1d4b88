"""Dense numbers in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.staging import stage


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in the order of the columns; equal rows are numbered in any order.

    Rows are dealt by ranges, numbered in each part, and shifted by the sizes of the parts before: one row for each part is all that meets."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").count()
    before = sizes.selectExpr("_part as _p", "sum(count) over (order by _part) - count as _before")
    within = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_p", "_k", "_before")
