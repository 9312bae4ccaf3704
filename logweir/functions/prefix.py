"""Running sums and predecessors that no key's rows have to be in one task for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 4096  # numbers of one row's array


def exclusive_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the earlier rows of the same keys, in ``order``.

    block must not fall as ``order`` rises. Sums run within a block, and over the blocks' totals,
    which are few; a hot key is spread over as many tasks as it has blocks.
    """
    d = df.withColumn("_block", block).withColumn("_value", value.cast("long"))
    totals = d.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    own = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    out = d.join(totals, [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_own"))
    return out.select(*[c for c in df.columns if c != name], name)


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """df with ``name``: value of the row before, of the same keys in ``order``; null for a key's first row.

    Blocks as in ``exclusive_sum``: within one a plain lag, and for its first row the last of the block before.
    """
    d = df.withColumn("_block", block).withColumn("_value", value)
    last = d.groupBy(*keys, "_block").agg(F.max(F.struct(*order, "_value")).alias("_last"))
    last = last.withColumn("_before", F.lag("_last._value").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    own = F.lag("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) == 1
    d = d.withColumn("_own", own).withColumn("_first", first).join(last, [*keys, "_block"])
    return d.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))).select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each number from 0 to below n, as ``name``; no row's array is longer than STEP, and a large n is spread over tasks."""
    d = df.where(F.col(n) > 0).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / STEP))))
    d = d.withColumn("_to", F.least(F.col(n) - 1, F.col("_step") * STEP + STEP - 1))
    return d.withColumn(name, F.explode(F.sequence(F.col("_step") * STEP, F.col("_to")))).drop("_step", "_to")
