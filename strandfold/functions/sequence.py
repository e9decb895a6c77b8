"""Sequence and name expressions, all inside whole-stage code where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = {"phred33": 33, "phred64": 64, "solexa": 59}


def umi_from_name(name: Column, separator: str = "_") -> Column:
    """The text after the last separator, without its last "/..." part; a name without the separator is an error."""
    tail = F.substring_index(name, separator, -1)
    tail = F.when(F.instr(tail, "/") > 0, F.regexp_replace(tail, "/[^/]*$", "")).otherwise(tail)
    missing = F.raise_error(F.concat(F.lit(f"read name without separator '{separator}': "), name)).cast("string")
    return F.when(F.contains(name, F.lit(separator)) | name.isNull(), tail).otherwise(missing)


def reverse_complement(seq: Column) -> Column:
    """Upper case, reversed, A-T and C-G swapped, N kept; any other letter is an error."""
    wrong = F.raise_error(F.concat(F.lit("no base of DNA in: "), seq)).cast("string")
    up = F.upper(seq)
    return F.when(seq.isNull() | up.rlike("^[ACGTN]*$"), F.reverse(F.translate(up, "ACGT", "TGCA"))).otherwise(wrong)


def pack2(seq: Column) -> Column:
    """A sequence of at most 31 letters A, C, G, T as 2 bits each in a long; null for any other."""
    digits = F.translate(seq, "ACGT", "0123")
    return F.when((F.char_length(seq) <= 31) & seq.rlike("^[ACGT]*$"), F.conv(F.when(F.char_length(seq) == 0, F.lit("0")).otherwise(digits), 4, 10).cast("long"))


def packed_mismatches(x: Column, y: Column) -> Column:
    """Mismatches of two packed sequences of one length: two operations and a population count."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555))).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Mismatching places of two strings of one length; null where the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    count = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.char_length(a) == F.char_length(b), F.when(F.char_length(a) == 0, F.lit(0)).otherwise(count))


def chunk_size(length: Column | int, chunks: int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.ceil(length / F.lit(chunks)).cast("int")


def chunks(seq: Column, count: int, length: Column | None = None) -> Column:
    """array<string>: count pieces of ceil(length / count) letters, what is left over going to the last.

    length is the length that sets the piece size; by default the sequence's own.
    """
    size = chunk_size(F.char_length(seq) if length is None else length, count)
    pieces = [F.substring(seq, size * i + 1, size) for i in range(count - 1)]
    return F.array(*pieces, F.substring(seq, size * (count - 1) + 1, F.char_length(seq)))


def count_threshold(percentage: float, n: Column) -> Column:
    """The most reads an absorbed neighbour may have, cut from a product of single-precision numbers."""
    return (F.lit(float(percentage)).cast("float") * (n + 1).cast("float")).cast("int")


def ascii_sum(text: Column) -> Column:
    """Sum of the character codes of a quality string, offset included."""
    return F.when(F.char_length(text) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c)), F.lit(0).cast("long"), lambda s, x: s + x))


def quality_sum(qual: Column) -> Column:
    """Sum of raw quality bytes (BINARY), read as the characters of the same codes."""
    return ascii_sum(F.decode(qual, "ISO-8859-1"))


def group_tag(parts: list[Column], length: int = 8) -> Column:
    """A tag that depends on nothing but the bundle and the leader."""
    shown = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *shown), 256), 1, length)
