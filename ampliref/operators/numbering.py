"""Row numbers over whole tables, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.session import shared_path


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... in order; rows that tie are numbered in any order.

    Rows are sorted over range partitions and written so, with their place in their partition; the rows of the partitions
    before, one number each, are added. A table with no rows has no numbers.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "numbered")
    placed = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at"))
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    before, offsets = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, before))
        before += n
    known = spark.createDataFrame(offsets, "_part int, _before long")  # a row a partition
    out = rows.join(F.broadcast(known), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
