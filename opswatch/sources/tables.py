"""The set of operational tables a query works on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opswatch.session import configure
from opswatch.sources.driver_tables import SCHEMAS, read_raw
from opswatch.sources.views import VIEWS, raw_inputs, render
from opswatch.streaming.sources import file_stream

# state tables that carry a soft-delete marker
SOFT_DELETE = "deleted_at"


class Tables:
    """Named DataFrames, resolved on first use.

    ``tables.tasks`` or ``tables["tasks"]`` gives the table. A loader maps a name to a DataFrame, so the same
    queries run on plain parquet folders, on views over other tables or on literal test data.
    """

    def __init__(self, loader: Callable[[str], DataFrame], **overrides: DataFrame):
        self._loader = loader
        self._cache: dict[str, DataFrame] = dict(overrides)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._loader(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def derived(self, name: str, make: Callable[["Tables"], DataFrame]) -> DataFrame:
        """A derived table that a caller has given under this name, to be shared by several queries; otherwise made from the others."""
        return self._cache[name] if name in self._cache else make(self)

    def with_tables(self, **overrides: DataFrame) -> "Tables":
        """A copy in which some tables are replaced."""
        return Tables(self._loader, **{**self._cache, **overrides})


def parquet_tables(spark: SparkSession, directory: str) -> Tables:
    """Tables stored as ``<directory>/<name>`` or ``<directory>/<name>.parquet``."""
    configure(spark)
    root = directory.rstrip("/")

    def load(name: str) -> DataFrame:
        try:
            return spark.read.parquet(f"{root}/{name}")
        except Exception as missing:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return spark.read.parquet(f"{root}/{name}.parquet")

    return Tables(load)


def literal_tables(**frames: DataFrame) -> Tables:
    """Tables given directly, for tests and notebooks."""

    def missing(name: str) -> DataFrame:
        raise KeyError(f"no table {name}")

    return Tables(missing, **frames)


def raw_tables(spark: SparkSession, directory: str, live: bool = False) -> Tables:
    """Operational views over the raw driver tables in ``directory``, plus the raw tables themselves.

    With ``live`` every table is a stream of the same files.
    """
    configure(spark)
    tag = ("ow_live_" if live else "ow_") + hashlib.sha256(directory.encode()).hexdigest()[:8]

    def read(name: str) -> DataFrame:
        return file_stream(spark, directory, SCHEMAS[name], f"{name}.parquet") if live else read_raw(spark, directory, name)

    def load(name: str) -> DataFrame:
        if name in SCHEMAS:
            return read(name)
        sql = render(VIEWS[name], "spark")
        for raw in raw_inputs(name):
            read(raw).createOrReplaceTempView(f"{tag}_{raw}")
            sql = re.sub(rf"\bFROM {raw}\b", f"FROM {tag}_{raw}", sql)
        return spark.sql(sql)

    return Tables(load)


def visible(df: DataFrame) -> DataFrame:
    """Rows of a state table that are not soft-deleted."""
    return df.filter(F.col(SOFT_DELETE).isNull()) if SOFT_DELETE in df.columns else df


def events_for(events: DataFrame, subject: str | None = None, event_types: list[str] | None = None) -> DataFrame:
    """Event log rows of one subject and/or some event types, oldest first within the stored order."""
    condition: Column = F.lit(True)
    if subject is not None:
        condition = condition & (F.col("job_id") == subject)
    if event_types:
        condition = condition & F.col("event_type").isin(event_types)
    return events.filter(condition)


#: when a row of a growing table was recorded
RECORDED_AT = {
    "event_log": "occurred_at",
    "heartbeats": "occurred_at",
    "queue_samples": "sampled_at",
    "monitoring_healths": "sampled_at",
    "findings": "created_at",
    "annotations": "derived_at",
}


def as_of(tables: Tables, now) -> Tables:
    """The tables as they were at ``now``: later rows are not there yet, later resolutions have not happened."""
    at = F.lit(now).cast("timestamp")

    def load(name: str) -> DataFrame:
        df = tables[name]
        if name in RECORDED_AT:
            df = df.filter(F.col(RECORDED_AT[name]) <= at)
        if name == "annotations":
            df = df.withColumn("resolved_at", F.when(F.col("resolved_at") <= at, F.col("resolved_at")))
        return df

    return Tables(load)
