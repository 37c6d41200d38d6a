"""Where queries over the driver's tables and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS_SQL = """obs AS (SELECT event_id, user_id AS ref_name, floor(value)::BIGINT AS major, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS minor,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE '*' END AS symbol,
    event_id % 2 = 1 AS is_rev, regexp_extract(props, '([0-9]+)', 1)::INT AS mapq, regexp_extract(props, '([0-9]+)', 1)::INT % 6 AS quality, ts FROM events)"""
ORDERS_SQL = """spans AS (SELECT o_orderkey AS id, o_custkey AS ref_name, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS "start",
    date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT + 30 + o_orderkey % 90 AS "end" FROM orders)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name``, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as base observations: user is reference, value position, type symbol."""
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    symbols = {"click": "A", "view": "C", "purchase": "G", "signup": "T"}
    symbol = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in symbols.items()], F.lit("*"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("ref_name"),
        F.floor("value").alias("major"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("minor"),
        symbol.alias("symbol"),
        (F.col("event_id") % 2 == 1).alias("is_rev"),
        number.alias("mapq"),
        (number % 6).alias("quality"),
        "ts",
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of days on their customer."""
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref_name"), start.alias("start"), (start + 30 + F.col("o_orderkey") % 90).alias("end")
    )
