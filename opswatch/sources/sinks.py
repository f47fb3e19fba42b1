"""Writers: append, conditional append, keyed upsert and removal.

Plain parquet has no row update, so a keyed table is a log of changes: every upsert writes its rows to its own
version folder and a reader takes the newest row per key. A write costs the size of the change, not of the table;
a retried write replaces its own folder, so losing an executor or repeating a stream batch is harmless. A version can be dealt into
buckets by a hash of some key columns, and a reader that asks for some values reads their buckets only. A removed key
is a row marked as gone. ``compact`` folds the log into a new table when reads should get cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION, BUCKET, GONE = "version", "bucket", "_gone"
BUCKETS = 64


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add immutable rows."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_batch(df: DataFrame, path: str, writer: str, batch: int) -> None:
    """Add the rows of a writer's batch, each with an ``append_key``; the same batch written again replaces itself.

    The key is made of the writer, the batch, the row's content and its number among rows of equal content, so it does not depend on how
    the rows are dealt to tasks.
    """
    content = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    numbered = df.withColumn("_content", content)
    nth = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
    key = F.sha2(F.concat_ws("|", F.lit(writer), F.lit(batch), "_content", nth), 256)
    numbered.select(key.alias("append_key"), *df.columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/writer={writer}/batch={batch}")


def new_rows(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among the existing ones."""
    return df.join(existing.select(*key), key, "left_anti")


def append_new(df: DataFrame, existing: DataFrame, key: list[str], path: str) -> None:
    append(new_rows(df, existing, key), path)


def bucket_of(columns: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def upsert(changes: DataFrame, path: str, version: int, bucket_by: list[str] | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write the new state of some keys, at most one row per key, and the keys (with at least the key columns) that are ``gone``.

    Versions order the changes. All versions of a table use the same ``bucket_by`` and ``buckets``.
    """
    rows = changes.withColumn(GONE, F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    target = f"{path.rstrip('/')}/{VERSION}={version}"
    if bucket_by is None:
        rows.write.mode("overwrite").parquet(target)
    else:
        dealt = rows.withColumn(BUCKET, bucket_of(bucket_by, buckets)).repartition(BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(target)


def create_keyed(spark: SparkSession, path: str, schema: str) -> None:
    """An empty keyed table without buckets, unless there is one already."""
    empty = spark.createDataFrame([], schema).withColumn(GONE, F.lit(False))
    empty.write.mode("ignore").parquet(f"{path.rstrip('/')}/{VERSION}=-1")


def version_log(spark: SparkSession, path: str, before: int | None = None, only: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of all versions, or those below ``before``; of all buckets, or those that values in ``only`` (the bucketing columns) fall into."""
    log = spark.read.parquet(path)
    if before is not None:
        log = log.filter(F.col(VERSION) < before)
    if only is not None:
        touched = only.select(bucket_of(only.columns, buckets).alias(BUCKET)).distinct().collect()  # at most one row per bucket
        log = log.filter(F.col(BUCKET).isin([r[0] for r in touched]))
    return log


def read_keyed(spark: SparkSession, path: str, key: list[str], before: int | None = None, only: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Newest row per key that is not gone.

    With ``before`` only versions below it count, so that a repeated batch never reads its own changes; with ``only`` the buckets
    of those values are read, and keys of other values in them come along.
    """
    log = version_log(spark, path, before, only, buckets)
    rest = [c for c in log.columns if c not in (*key, VERSION, BUCKET)]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("row"))
    held = newest.filter(~F.coalesce(F.col("row")[GONE], F.lit(False)))
    return held.select(*key, *[F.col("row")[c].alias(c) for c in rest if c != GONE])


def rebuild(wanted: DataFrame, path: str, key: list[str], version: int, bucket_by: list[str] | None = None) -> None:
    """Bring a keyed table into line with ``wanted`` (all its columns, one row per key) as one version.

    Missing and differing rows are written, rows that should not be there are marked as gone, equal rows are left alone.
    The table is read below ``version``, so a repeated rebuild writes the same changes, and a further one writes none.
    """
    held = read_keyed(wanted.sparkSession, path, key, before=version)
    names = [c for c in held.columns if c not in key]
    same = held.select(*[F.col(k).alias(f"h_{k}") for k in key], F.struct(*names).alias("_held"))
    on = [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in key]
    changed = wanted.join(same, on, "left").filter(~F.struct(*[F.col(n) for n in names]).eqNullSafe(F.col("_held"))).select(*held.columns)
    there = wanted.select(*[F.col(k).alias(f"h_{k}") for k in key])
    junk = held.select(*key).join(there, on, "left_anti")
    upsert(changed, path, version, bucket_by, gone=junk)


def overlaid(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of its own and added to it; columns as in ``changes``."""
    kept = base.join(changes.select(*key), key, "left_anti")
    return kept.select(*changes.columns).unionByName(changes)


def compact(spark: SparkSession, path: str, key: list[str], target: str) -> None:
    """Write the current state of ``path`` as version 0 of a new keyed table."""
    upsert(read_keyed(spark, path, key), target, 0)
