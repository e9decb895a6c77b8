"""Two-pass external shuffle into shards whose row counts differ by at most one.

Pass 1 scatters the records into memory-sized buckets by a seeded hash of their key.
Pass 2 takes each bucket in one task: it puts the bucket in key order (a sort that can spill)
and applies a Fisher-Yates permutation of its row numbers, drawn from (seed, bucket, step)
alone. The buckets one after the other are then one random order of all records; record g of
that order goes to shard g mod n, slot g div n, and each task writes its part of every shard.

The permutation depends on nothing but the seed, the bucket and its row count, so a task
that runs again after a lost executor gives the same rows. Only (bucket, count) pairs go
anywhere but with their records, and they are joined by a shuffle when they are many; the
running sum over them is taken group by group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandfold.llm.shared import parts, salted, shared_dir, table, utf8

BUCKET_BYTES = 2 << 20
BUCKET_ROWS = 1000
SHARDS = 16
SEED = 20_240_601
#: Buckets whose counts are summed up in one task.
SUMMED = 4096


def fisher_yates(n: F.Column, *key: F.Column) -> F.Column:
    """A random order of 0 .. n-1: the inside-out Fisher-Yates shuffle, drawn from hashes of (key, step)."""

    def step(a: F.Column, i: F.Column) -> F.Column:
        j = F.pmod(F.xxhash64(*key, i), i + 1).cast("int")
        put = F.concat(F.slice(a, 1, j), F.array(i), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)))
        return F.when(j == i, F.concat(a, F.array(i))).otherwise(put)

    return F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), F.array().cast("array<int>"), step)


def _before(counts: DataFrame) -> DataFrame:
    """(bucket, before): rows in the buckets before each of (bucket, n), by sums within groups of buckets and over the groups."""
    counts = counts.withColumn("g", F.floor(F.col("__bucket") / SUMMED))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("g").agg(F.sum("n").alias("gn")).withColumn("gb", F.coalesce(F.sum("gn").over(earlier(Window.orderBy("g"))), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("g").orderBy("__bucket"))), F.lit(0))
    return counts.withColumn("inside", inside).join(groups, "g").select("__bucket", (F.col("gb") + F.col("inside")).alias("__before"))


def shuffled(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of docs, plus shard (int) and slot (long, gapless from 0 in each shard).

    Rows without a key are ordinary rows with one shared key. A key with more rows than a
    bucket holds is salted with a row number, which is stored before it is used twice, so it
    spreads over all buckets. Rows equal in every column are interchangeable. Null and empty
    texts are rows like others; a very long one makes its bucket that much larger. An empty
    table gives an empty result. Columns of docs named like ours (shard, slot) are replaced.
    """
    docs = docs.drop("shard", "slot")
    n_buckets = max(1, -(-docs.count() // bucket_rows), parts(docs, bucket_bytes))
    scattered = salted(docs, key, bucket_rows)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("__salt")), F.lit(n_buckets)).cast("int")
    counts = scattered.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("n"))
    rest = [F.col(c) for c, t in docs.dtypes if c != key and "map<" not in t and t not in ("variant", "void")]
    whole = Window.partitionBy("__bucket")
    in_order = whole.orderBy(F.col(key), F.col("__salt"), *rest)
    rows = scattered.withColumn("__bucket", bucket).withColumn("__row", F.row_number().over(in_order) - 1).withColumn("__n", F.count("*").over(whole))
    # the bucket's first row draws the order; all rows of the bucket, in the same task, read their place from it
    rows = rows.withColumn("__drawn", F.when(F.col("__row") == 0, fisher_yates(F.col("__n"), F.lit(seed + 1), F.col("__bucket"))))
    rows = rows.withColumn("__place", F.get(F.first("__drawn").over(in_order), F.col("__row")))
    at = F.col("__before") + F.col("__place")
    return (
        rows.drop("__drawn").join(_before(counts), "__bucket")
        .withColumn("__at", at)
        .select(*[F.col(c) for c in docs.columns], F.pmod("__at", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__at") / n_shards).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, **options) -> None:
    """The shards as Parquet, one folder each (shard=0, ...), rows in slot order within each file.

    Every task of the second pass writes its buckets' part of each shard, so a shard is written
    by all tasks, and nothing is shuffled again. What holds for shuffled() holds for the rows.
    """
    out = shuffled(docs, n_shards, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of written shards, with the columns of like (the table that was written), shard and slot; empty if none were."""
    kept = [f for f in like.schema.fields if f.name not in ("shard", "slot")]
    schema = StructType([*kept, StructField("slot", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(schema).parquet(path)


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path)
    raw = utf8(F.col("text"))
    return read_shards(spark, path, docs).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_external_shuffle": op8_external_shuffle}
SQL: dict[str, str] = {}
