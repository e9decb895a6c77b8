"""The columns of reads and the key of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READS = """read_ord long, sample string, qname string, descr string, flag int, chr int, chr_name string, pos long, mapq int,
cigar string, mate_chr int, mate_pos long, tlen long, seq string, qual binary, tags map<string,string>"""

#: Reads of one bundle compete: one file, reference, strand, 5' position and, if asked, length; optionally one window batch.
BUNDLE = ["sample", "chr", "reverse", "grp_len", "grp_pos", "window_chunk"]

_DEFAULTS = {"sample": ("string", ""), "chr": ("int", 1), "reverse": ("boolean", False), "grp_len": ("long", 0), "grp_pos": ("long", 1), "window_chunk": ("long", 0)}


def with_bundle(reads: DataFrame) -> DataFrame:
    """reads with every bundle column; those that are missing get the value that all reads share."""
    for c, (kind, value) in _DEFAULTS.items():
        if c not in reads.columns:
            reads = reads.withColumn(c, F.lit(value).cast(kind))
    return reads
