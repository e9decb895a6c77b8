"""Reads made of the driver's tables by arithmetic alone, so that any SQL engine makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.schema import with_bundle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(x, i: int):
    """Base i of a number as a letter."""
    return F.substring(F.lit("ACGT"), (F.shiftright(x, 2 * i) % 4 + 1).cast("int"), F.lit(1))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read an order: about fifteen molecules a bundle, one read in seven with one wrong base."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = (c * 37 + 11) % 4096
    p4 = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 6 * 2).cast("int"))
    old = F.expr("((o_custkey * 37 + 11) % 4096) div shiftleft(1L, cast(o_orderkey % 6 * 2 as int)) % 4")
    new = (old + 1 + F.expr("(o_orderkey div 7) % 3")) % 4
    x = F.when(k % 7 == 0, t + (new - old) * p4).otherwise(t)
    base = table(spark, sf_dir, "orders").select(
        k.alias("read_ord"), F.expr("o_custkey div 30").alias("grp_pos"), (c % 2 == 1).alias("reverse"), x.cast("long").alias("x"),
        F.concat(F.lit("ACGT"), F.substring(F.lit("ACGT"), (F.expr("(o_orderkey div 7) % 3") + 1).cast("int"), F.lit(1))).alias("seq"), (20 + k % 21).alias("qual_sum"),
    )
    return with_bundle(base.withColumn("umi", F.concat(*[digit(F.col("x"), i) for i in range(6)])).drop("x"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aligned read an order: clips, an insertion, a deletion and a skip by arithmetic; two orders are mates of one name."""
    q = """select o_orderkey as read_ord, '' as sample,
        concat('r', cast(h as string), '_', substr('ACGT', cast(h % 4 + 1 as int), 1), 'CA', substr('ACGT', cast(h div 4 % 4 + 1 as int), 1)) as qname,
        cast((case when o_custkey % 2 = 0 then 16 else 0 end) + (case when o_orderkey % 2 = 1 then 128 else 64 end) + (case when h % 11 = 0 then 8 else 0 end) as int) as flag,
        cast(h % 5 as int) as chr, concat('chr', cast(h % 5 as string)) as chr_name, h * 7 % 900 as pos, cast(20 + o_custkey % 41 as int) as mapq,
        concat(case when h % 3 = 0 then concat(cast(1 + o_custkey % 4 as string), 'S') else '' end, cast(10 + o_custkey % 20 as string), 'M',
               case o_custkey div 2 % 4 when 0 then '2I5M' when 1 then '3D5M' when 2 then '20N7M' else '' end, case when o_orderkey % 5 = 0 then '3S' else '' end) as cigar
        from (select *, o_orderkey div 2 as h from {orders})"""
    return spark.sql(q, orders=table(spark, sf_dir, "orders"))
