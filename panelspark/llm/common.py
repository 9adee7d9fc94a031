"""Shared helpers: the folder all executors see, written tables that cut lineage, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local run gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; its driver deletes it when it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"
    p, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    files = p.getFileSystem(conf)
    if not files.exists(p):
        files.mkdirs(p)
        files.deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later result reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """The number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the filter below, as a power of two: a table of at most 2**18 rows.
FILTER_BITS = 24


def flagged(df: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: false only where ``ids`` does not hold the row's ``column``.

    A bitmap of hashed ids is broadcast for it. It has 2**FILTER_BITS bits whatever the input's size; where
    it fills up more rows are flagged, and the join that decides reads more of them.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    bits = ids.select(place.alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(_bit)").alias("_bits"))
    placed = df.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(bits), "_word", "left")
    return placed.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word", "_bits")


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df.join(ids, column, "left_semi")`` whose shuffle carries few other rows of ``df``."""
    return flagged(df, ids, column, "_maybe").where("_maybe").drop("_maybe").join(ids, column, "left_semi")
