"""Tables that are made once and read many times: facts of sources, in the folder that executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode, where none is set, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or f"{tempfile.gettempdir()}/gristmill-checkpoints"


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written, by the values of a column if one is named, so that a reader of one value reads no other; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gristmill/{by or 'rows'}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already; then the folder's own clean-up applies
            pass

    atexit.register(drop)
    df.write.partitionBy(*[by] if by else []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
