"""Price panels (t, asset, price) over the driver's tables, and readers and writers for panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV (plain or gzip; first column the date, one column per asset) as a long panel; NaN becomes NULL."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    first, *assets = wide.columns
    long = wide.unpivot(first, assets, "asset", "price").withColumnRenamed(first, "t")
    return long.withColumn("price", F.nanvl(F.col("price").cast("double"), F.lit(None)))


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").partitionBy("asset").parquet(path)


def _prices(lines: DataFrame, t, asset) -> DataFrame:
    return lines.groupBy(t.cast("date").alias("t"), asset.cast("string").alias("asset")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: average unit price by month and supplier nation."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _prices(lines, F.date_trunc("month", "l_shipdate"), F.col("s_nationkey"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: the same by day."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _prices(lines, F.col("l_shipdate"), F.col("s_nationkey"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors: average unit price by month and part brand."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _prices(lines, F.date_trunc("month", "l_shipdate"), F.col("p_brand"))


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, asset, x: return, w: volume, grp: region key) of the dense panel."""
    from ..operators.panel import linear_returns

    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("asset"), F.col("n_regionkey").cast("int").alias("grp"))
    panel = monthly(spark, sf_dir)
    return linear_returns(panel).join(panel.select("t", "asset", "volume"), ["t", "asset"]).join(nation, "asset").select("t", "asset", F.col("r").alias("x"), F.col("volume").alias("w"), "grp")
