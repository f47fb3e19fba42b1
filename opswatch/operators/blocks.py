"""Ordered data in blocks of a bounded number of rows.

A key may hold a large share of all rows, and all of them within any span of time, so work along an order is cut by rows, not by
keys or times: range partitioning deals the ordered rows into blocks of about ``BLOCK_ROWS`` rows. Inside a block plain
windows work; from block to block one row for each (key, block) is carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opswatch.session import checkpoint_dir

BLOCK = "_block"
KEY = "_key"
BLOCK_ROWS = 100_000


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with the number of its block in ``_block``: blocks are consecutive ranges of ``order``.

    ``order`` should tell all rows apart, or rows that are equal in it share a block. ``rows`` is the number of rows or a bound of it,
    counted where it is not given. The result is stored, because another evaluation could draw other borders.
    """
    blocks = -(-(df.count() if rows is None else rows) // block_rows) or 1
    return stored(df.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id()))


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Add ``out``: the last value that is not NULL among the rows before this one within its key (NULL keys are equal)."""
    columns = df.columns
    blocked = in_blocks(df.withColumn(KEY, F.struct(*keys)), [KEY, *order], block_rows, rows)
    inside = Window.partitionBy(BLOCK, KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocked.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    tails = blocked.groupBy(BLOCK, KEY).agg(F.max_by(F.col(value), known).alias("_tail"))
    earlier = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(BLOCK, KEY, F.last("_tail", ignorenulls=True).over(earlier).alias("_before"))
    joined = ranked.join(carried.filter("_before IS NOT NULL"), [BLOCK, KEY], "left")
    return joined.select(*[F.col(c) for c in columns], F.coalesce("_inside", "_before").alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Add ``out``: the number of each row within its key, from 0 (NULL keys are equal)."""
    columns = df.columns
    blocked = in_blocks(df.withColumn(KEY, F.struct(*keys)), [KEY, *order], block_rows, rows)
    inside = F.row_number().over(Window.partitionBy(BLOCK, KEY).orderBy(*order)) - 1
    sizes = blocked.groupBy(BLOCK, KEY).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(BLOCK, KEY, F.sum("_size").over(earlier).alias("_before"))
    joined = blocked.withColumn("_inside", inside).join(carried.filter("_before IS NOT NULL"), [BLOCK, KEY], "left")
    return joined.select(*[F.col(c) for c in columns], (F.coalesce("_before", F.lit(0)) + F.col("_inside")).alias(out))
