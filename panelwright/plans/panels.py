"""Research panels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c: str):
    return F.to_date(F.date_trunc("month", F.col(c)))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (month, supplier): open, close, adv and signal, by a single partial-aggregated shuffle."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month("l_shipdate").alias("time"), F.col("l_suppkey").alias("instrument"))
        .agg(
            F.min("l_extendedprice").alias("open"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            F.sum("l_quantity").alias("adv"),
            F.round(F.avg("l_discount"), 9).alias("signal"),
        )
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to region; nation and region have 25 and 5 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("sector"))
    )
