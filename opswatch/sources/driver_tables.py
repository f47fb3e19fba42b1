"""Readers for the raw parquet tables, with declared schemas.

Declaring the schema skips footer inference and reads every timestamp as a UTC instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opswatch.session import configure

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


# tables that grow with the data; the others stay small
GROWING = ("orders", "lineitem", "events", "documents", "pages", "conversations")


FEW_SPLITS = 16


def spread_small_input(df: DataFrame) -> DataFrame:
    """Give an input of only a few splits (at most some two gigabytes) to more cores.

    Anything larger is left alone, so nothing is shuffled at scale.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 4 * FEW_SPLITS)
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def read_raw(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One raw table of ``directory``."""
    configure(spark)
    table = spark.read.schema(SCHEMAS[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return spread_small_input(table) if name in GROWING else table
