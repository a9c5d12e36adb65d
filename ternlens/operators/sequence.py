"""Order-dependent helpers that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternlens.session import stage


def next_in_order(df: DataFrame, key: str, order: str, cols: list[str], block: int = 4096,
                  prefix: str = "next_") -> DataFrame:
    """``lead`` of ``cols`` over (``key`` ordered by the integer column ``order``), exact,
    without sorting a whole key in one task.

    Rows are cut into blocks of ``block`` consecutive order values. Inside a block the
    ordinary ``lead`` applies (window per (key, block)); the last row of a block takes
    the first row of the next non-empty block, found with ``lead`` over one summary row
    per (key, block) — a table ``block`` times smaller than the key.
    """
    b = F.floor(F.col(order) / F.lit(block)).cast("long")
    tagged = df.withColumn("_blk", b)
    w = Window.partitionBy(key, "_blk").orderBy(order)
    nxt = {f"{prefix}{c}": F.lead(c).over(w) for c in cols}
    inner = tagged.withColumns(nxt).withColumn("_is_last", F.lead(order).over(w).isNull())
    firsts = (tagged.groupBy(key, "_blk")
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_first")))
    ws = Window.partitionBy(key).orderBy("_blk")
    following = firsts.select(key, "_blk", F.lead("_first").over(ws).alias("_following"))
    joined = inner.join(following, [key, "_blk"], "left")
    fix = {f"{prefix}{c}": F.when(F.col("_is_last"), F.col("_following")[c]).otherwise(F.col(f"{prefix}{c}"))
           for c in cols}
    return joined.withColumns(fix).drop("_blk", "_is_last", "_following")


def first_per_key(df: DataFrame, key: str, order: str, value: str, where=None, name: str = "first_value") -> DataFrame:
    """(key, value of the smallest ``order`` [among rows matching ``where``]) — a partial/final
    aggregate, so a hot key is combined map-side before the shuffle."""
    src = df if where is None else df.where(where)
    return src.groupBy(key).agg(F.min_by(F.col(value), F.col(order)).alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: every row's place (from 1) in the given order, for any number of rows; ties are numbered in any order.

    A range partitioning deals the rows in order; each task numbers its own (the lower 33 bits of Spark's
    increasing id), and the rows before a partition are summed over a table of one row per partition.
    The dealt rows are staged once (an eager job), since both the places and the sums read them.
    """
    dealt = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("*", F.monotonically_increasing_id().alias("_at")))
    rows = stage(dealt.select(*df.columns, F.shiftright("_at", 33).alias("_part"),
                              F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = (rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")))
    return (rows.join(before, "_part")
            .select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name)))
