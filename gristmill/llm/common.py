"""What the corpus operators share: table access, word rules, scratch space."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 both read this as "runs of anything but ASCII white space".
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, every other ASCII byte that is no letter or digit to a blank.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_long(key: Column) -> Column:
    """The first 60 bits of a string's MD5 as a long; DuckDB can compute the same number."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker; functions sent by value bring no module state along."""
    return sys.__dict__.setdefault("_gristmill", {}).setdefault(name, {})


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or, in local mode only, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"{tempfile.gettempdir()}/gristmill-checkpoints"
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/gristmill/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already; then the folder's own clean-up applies
            pass

    atexit.register(drop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is settled: its cleaner follows the driver's garbage collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed to the system: Python workers go on to other tasks, and a task's peak would stay with them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that lost executors cannot undo."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``settle`` wrote, once all that was made of them is settled itself."""
    for t in tables:
        remove(t.sparkSession, t._settled_at)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """A name like the one wanted that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, so that they meet no others of their names on the way."""
    return F.struct(*[quoted(c) for c in df.columns])


def unpacked(row: str, names: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in names]


def with_column(df: DataFrame, name: str, kind: T.DataType, make: Callable[[pa.RecordBatch], pa.Array], rows: int = 1000) -> DataFrame:
    """df with one more column, made of so many rows at a time; columns stand in their places, for their names may be of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, make(batch)], names=[*batch.schema.names, "out"])

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("out", kind)])
    return plain.mapInArrow(run, schema).toDF(*df.columns, name)
