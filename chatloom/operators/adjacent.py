"""The row before, without one task per key.

A window over a whole chat would hold a hot chat in one task. Here rows are cut into blocks of their order number; lags
inside a block come from a bounded window, and the first row of each block gets the last row of the block before by a join on
block numbers, of which there are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def with_previous(df: DataFrame, key: str, order: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """`df` with `prev`, the struct of `values` of the row before in `key` by the whole number `order`; null for the first.

    `order` must be unique per key and not null. An empty table stays empty.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    one = cut.withColumns({"prev": F.lag(F.struct(*values)).over(inside), "_first": F.row_number().over(inside) == 1})
    last = cut.groupBy(key, "_block").agg(F.max_by(F.struct(*values), F.col(order)).alias("_last"))
    carried = last.select(key, "_block", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carried"))
    joined = one.join(carried, [key, "_block"])
    return joined.withColumn("prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("prev"))).drop("_block", "_first", "_carried")


def running_count(df: DataFrame, key: str, order: str, flag: str, out: str, block: int = BLOCK) -> DataFrame:
    """`df` with `out`, how often `flag` was true in `key` up to and with this row, by the same cutting."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    hit = F.coalesce(F.col(flag), F.lit(False)).cast("bigint")
    sums = cut.groupBy(key, "_block").agg(F.sum(hit).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(key, "_block", before.alias("_before"))
    one = cut.withColumn("_in", F.sum(hit).over(inside))
    return one.join(carried, [key, "_block"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_block", "_in", "_before")
