"""Mates: joined again after dedup, or merged where they overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.operators.align import ReferenceIndex
from strandfold.operators.bundles import SECOND


def with_mates(output: DataFrame, reads: DataFrame) -> DataFrame:
    """output plus the second mates, on the same reference, of the reads in it (columns that reads lacks are null).

    The names are told apart before the join, so it is a semi join on (chr, qname).
    """
    seconds = reads.where(F.col("flag").bitwiseAND(F.lit(SECOND)) != 0)
    names = output.select("chr", "qname").distinct()
    return output.unionByName(seconds.join(names, ["chr", "qname"], "left_semi"), allowMissingColumns=True)


def by_coordinate(reads: DataFrame) -> DataFrame:
    """In order of reference, position and first appearance."""
    return reads.orderBy("chr", "pos", "read_ord")


def _aligned(pos: int, cigar: str) -> tuple[list[tuple[int, int]], int]:
    """(query, reference) pairs of aligned bases, and the reference end."""
    out, q, r, n = [], 0, pos, 0
    for c in cigar:
        if c.isdigit():
            n = n * 10 + int(c)
            continue
        if c in "M=X":
            out += [(q + i, r + i) for i in range(n)]
        if c in "MIS=X":
            q += n
        if c in "MDN=X":
            r += n
        n = 0
    return out, r


class _Read:
    def __init__(self, row: dict) -> None:
        self.row, self.start, self.reverse = row, row["pos"], bool(row["flag"] & 16)
        pairs, self.end = _aligned(row["pos"], row["cigar"] or "")
        self.bases: dict[int, str] = {}
        for q, r in pairs:
            self.bases.setdefault(r, row["seq"][q])


def overlaps(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Equal intervals, or a starts before b and reaches b's start; touching counts."""
    return a == b or (a[0] < b[0] and a[1] >= b[0])


def compare(a: dict[int, str], b: dict[int, str], least: int) -> tuple[str, dict[int, str] | None]:
    """merged (with the bases of both), unmerged (too few common positions) or discordant."""
    common = a.keys() & b.keys()
    if any(a[p] != b[p] for p in common):
        return "discordant", None
    return ("merged", a | b) if len(common) >= least else ("unmerged", None)


def merge_bundle(rows: list[dict], least: int, index: ReferenceIndex | None) -> list[dict]:
    """What becomes of the reads of one barcode: the first overlapping partner of opposite strand decides each read.

    A discordant pair is dropped with both reads; a read that doesn't merge is given out and
    its partner stays for others; a merged pair is one read. status is null for a lone read.
    """
    if len(rows) == 1:
        return [{**rows[0], "status": None}]
    todo = [_Read(r) for r in sorted(rows, key=lambda r: (r["chr"], r["qname"], bool(r["flag"] & 16), r["pos"], r["read_ord"]))]
    out, gone = [], [False] * len(todo)
    for k, a in enumerate(todo):
        if gone[k]:
            continue
        status, bases = "unmerged", None
        for i in range(k + 1, len(todo)):
            b = todo[i]
            if not gone[i] and (a.reverse or b.reverse) and overlaps((a.start, a.end), (b.start, b.end)):
                status, bases = compare(a.bases, b.bases, least)
                gone[i] = status != "unmerged"
                break
        if status == "discordant":
            out.append({**a.row, "status": status})
        elif status == "merged":
            seq = "".join(bases[p] for p in sorted(bases))
            pos, cigar = index.align(seq) if index else (min(bases), f"{len(seq)}M")
            out.append({**a.row, "qname": a.row["qname"] + ":MERGED", "seq": seq, "pos": pos, "cigar": cigar, "qual": bytes([255]) * len(seq), "status": status})
        else:
            out.append({**a.row, "status": status})
    return out


def merge_pairs(reads: DataFrame, reference: str | None, min_overlap: int = 3, split_window: int | None = None) -> DataFrame:
    """Deduplicated reads with bx, merged per (chr, window batch, bx); plus status, null for barcodes of one read.

    Rows with status discordant stand for pairs that were dropped: reads to keep are the rest.
    The greedy choice is sequential within a barcode, which is what dedup leaves of one
    molecule: a few reads. Reads without a barcode belong to no molecule and pass as they
    are; they are never gathered. reference (the first record of a FASTA file) is sent once
    to each task.
    """
    from strandfold.functions.cigar import window_chunk

    kept = [f for f in reads.schema.fields]
    schema = reads.withColumn("status", F.lit(None).cast("string")).schema
    index = ReferenceIndex(reference) if reference else None
    keyed = reads.where("bx is not null").withColumn("__chunk", window_chunk(F.col("pos"), split_window)).withColumn("__bx", F.col("bx"))

    arrow = _arrow(schema)
    names, by = [f.name for f in kept], ["chr", "__chunk", "__bx"]

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by barcode; a barcode may go on in the next batch."""
        key, open_rows, done = None, [], []
        for b in bs:
            for k, row in zip(zip(*(b.column(c).to_pylist() for c in by)), b.select(names).to_pylist()):
                if k != key and open_rows:
                    done += merge_bundle(open_rows, min_overlap, index)
                    open_rows = []
                key = k
                open_rows.append(row)
            if len(done) >= 2000:
                yield from pa.Table.from_pylist(done, schema=arrow).to_batches()
                done = []
        if open_rows:
            done += merge_bundle(open_rows, min_overlap, index)
        if done:
            yield from pa.Table.from_pylist(done, schema=arrow).to_batches()

    merged = keyed.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
    return merged.unionByName(reads.where("bx is null").withColumn("status", F.lit(None).cast("string")))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def merge_report(merged: DataFrame, reads_in: DataFrame) -> DataFrame:
    """One row: discordant, unmerged and merged results, and reads in and out."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = merged.agg(n("discordant").alias("num_discordant"), n("unmerged").alias("num_unmerged"), n("merged").alias("num_merged"), F.count_if(F.col("status").isNull() | (F.col("status") != "discordant")).alias("num_reads_out"))
    return reads_in.agg(F.count("*").alias("num_reads_in")).join(counts, F.lit(True))
