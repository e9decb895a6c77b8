"""Alignment expressions over CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE, QUERY, ALIGNED = "MDN=X", "MIS=X", "M=X"


def operations(cigar: Column) -> Column:
    """array<struct<len: int, op: string>>; text that isn't wholly operations is an error; "*" and null have none."""
    lengths = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(1)), lambda x: x.cast("int"))
    codes = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(2))
    wrong = F.raise_error(F.concat(F.lit("not a CIGAR: "), cigar)).cast("array<struct<len:int,op:string>>")
    good = F.zip_with(lengths, codes, lambda n, c: F.struct(n.alias("len"), c.alias("op")))
    none = F.array().cast("array<struct<len:int,op:string>>")
    return F.when(cigar.isNull() | (cigar == "*"), none).when(cigar.rlike(r"^(\d+[MIDNSHPX=])+$"), good).otherwise(wrong)


def _sum(ops: Column, codes: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: F.contains(F.lit(codes), o["op"])), F.lit(0).cast("long"), lambda s, o: s + o["len"])


def reference_length(ops: Column) -> Column:
    return _sum(ops, REFERENCE)


def query_length(ops: Column) -> Column:
    """Bases of the read, soft clips included, hard clips not."""
    return _sum(ops, QUERY)


def leading_softclip(ops: Column) -> Column:
    return _edge_clip(ops)


def trailing_softclip(ops: Column) -> Column:
    return _edge_clip(F.reverse(ops))


def _edge_clip(ops: Column) -> Column:
    """Soft-clipped bases at the start, perhaps behind a hard clip."""
    soft = F.when(F.get(ops, 0)["op"] == "H", F.get(ops, 1)).otherwise(F.get(ops, 0))
    return F.when(soft["op"] == "S", soft["len"].cast("long")).otherwise(F.lit(0).cast("long"))


def reference_end(pos: Column, ops: Column) -> Column:
    """The first reference position behind the alignment."""
    return pos + reference_length(ops)


def group_position(pos: Column, ops: Column, reverse: Column) -> Column:
    """Where the read's 5' end would lie without clipping: before the start, or behind the end on the reverse strand."""
    return F.when(reverse, reference_end(pos, ops) + trailing_softclip(ops)).otherwise(pos - leading_softclip(ops))


def aligned_blocks(pos: Column, ops: Column) -> Column:
    """array<struct<ref, query, len>> of the aligned runs, both counted from 0."""
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.array().cast("array<struct<ref:bigint,query:bigint,len:int>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        on = lambda codes: F.when(F.contains(F.lit(codes), o["op"]), o["len"]).otherwise(0).cast("long")
        block = F.struct(acc["ref"].alias("ref"), acc["query"].alias("query"), o["len"].alias("len"))
        out = F.when(F.contains(F.lit(ALIGNED), o["op"]), F.concat(acc["out"], F.array(block))).otherwise(acc["out"])
        return F.struct((acc["ref"] + on(REFERENCE)).alias("ref"), (acc["query"] + on(QUERY)).alias("query"), out.alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def check_window(width: int | None) -> None:
    if width is not None and (isinstance(width, bool) or not isinstance(width, int) or width < 1):
        raise ValueError("split_window must be a whole number of at least 1")


def window_chunk(pos: Column, width: int | None) -> Column:
    """Number of the batch of three windows that a start position falls in; without a width all are in one."""
    check_window(width)
    return F.lit(0).cast("long") if width is None else F.floor(pos / F.lit(3 * width)).cast("long")
