"""What all operators here share: the tables of a data folder and the folder all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few numbers each that may be broadcast; above it, joins shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if its counted rows are few; else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text in one Arrow batch between the JVM and Python, unless the session sets its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def batched(df: DataFrame) -> DataFrame:
    """df as it is, in a session whose Arrow batches are bounded by bytes of text.

    Spark's own bound, 64 MB, is taken several times over by a task: in the JVM's direct memory,
    in the worker's copy and in what is made of it. A value that the session has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local (tests), a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="strandfold-")
        atexit.register(shutil.rmtree, place, True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted(df: DataFrame, key: str, most: int) -> DataFrame:
    """df plus __salt: 0, or a number of the row's own if some key (or null) has more than most rows.

    A row's number is stored before anything is derived from it, so it stays the same when
    a task runs again.
    """
    if df.groupBy(key).count().where(F.col("count") > most).isEmpty():
        return df.withColumn("__salt", F.lit(0).cast("long"))
    return stored(df.withColumn("__salt", F.monotonically_increasing_id()), "salted")


#: The optimiser's sizes above this (a petabyte) mean that it doesn't know.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size of df, from file lengths, without a job; where it has none, the bytes of all strings are added up."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN_BYTES:
        wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
        each = F.lit(8 * len(df.columns)).cast("long")
        for w in wide:
            each = each + w
        size = df.agg(F.sum(each)).first()[0] or 0
    return max(1, size)


def parts(df: DataFrame, part_bytes: int = 8 << 20, least: int = 1) -> int:
    """A number of partitions that follows the input's size, whatever that is."""
    return max(least, -(-input_bytes(df) // part_bytes))


def utf8(text: F.Column) -> F.Column:
    return F.coalesce(text, F.lit("")).cast("binary")
