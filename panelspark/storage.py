"""Tables that cut lineage: written to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table under ``spark.checkpoint.dir``; only a local run without that setting gets a temporary folder."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
