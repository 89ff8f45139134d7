"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine, a temporary
    folder stands in for it.
    """
    base = spark.conf.get(_DIR_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_DIR_CONF} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scriptloom-")
        spark.conf.set(_DIR_CONF, base)
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise` once nothing needs it."""
    path = getattr(df, "_scriptloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a run of very long texts can't fill a Python worker's memory."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Positions of a bitmap of keys: 2**26 bits are 8 MB.
BITMAP_BITS = 1 << 26


def maybe_in(df: DataFrame, keys: list[Column], table: DataFrame, table_keys: list[Column], name: str) -> DataFrame:
    """``df`` and a boolean ``name``: false only where no row of ``table`` has the row's keys.

    ``table``'s keys are hashed into a bitmap of fixed size, at most ``BITMAP_BITS / 32768`` rows of 4096 bytes, which is
    broadcast: so rows that can't find a partner are told apart before anything moves. A bit set for another key's sake is
    a false alarm; with far more than ``BITMAP_BITS`` keys nearly all rows get one.
    """
    at, bucket, bits = fresh(df, "_bitmap_at"), fresh(df, "_bitmap_bucket"), fresh(df, "_bitmap")
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS)) + 1
    there = place(table_keys)
    bitmaps = table.groupBy(F.bitmap_bucket_number(there).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(there)).alias(bits))
    marked = df.withColumn(at, place(keys)).withColumn(bucket, F.bitmap_bucket_number(F.col(at)))
    bit = F.bitmap_bit_position(F.col(at))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    return marked.join(F.broadcast(bitmaps), bucket, "left").withColumn(name, F.coalesce(found, F.lit(False))).drop(at, bucket, bits)
