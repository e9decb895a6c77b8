"""Barcode extraction from read starts, for single and paired reads, batch or streaming.

A pattern is parsed once into a list of base kinds; each kind then becomes a concatenation
of literal substrings, so the row work stays in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions.sequence import SPACE


def parse_pattern(text: str) -> str:
    """A pattern as one letter a base: N (UMI), C (cell), X (kept). "4N7C" is short for NNNNCCCCCCC."""
    up = text.strip().upper()
    if not up:
        raise ValueError("empty pattern")
    if any(c.isdigit() for c in up):
        if not re.fullmatch(r"(\d+[NCX])+", up):
            raise ValueError(f"each letter needs a count before it and each count a letter after it: {text}")
        out = "".join(c * int(n) for n, c in re.findall(r"(\d+)([NCX])", up))
    else:
        out = up
    if not out or set(out) - set("NCX"):
        raise ValueError(f"a pattern has the letters N, C and X only: {text}")
    return out


@dataclass
class Layout:
    """Places of each kind of base of a pattern, and the columns cut by them."""

    pattern: str

    def _runs(self, kind: str) -> list[tuple[int, int]]:
        return [(m.start(), len(m[0])) for m in re.finditer(f"{kind}+", self.pattern)]

    def places(self, kind: str) -> list[int]:
        return [i for i, c in enumerate(self.pattern) if c == kind]

    def take(self, seq: Column, kind: str) -> Column:
        parts = [F.substring(seq, a + 1, n) for a, n in self._runs(kind)]
        return F.concat(*parts) if parts else F.substring(seq, 1, 0)

    def tail(self, seq: Column) -> Column:
        return F.substring(seq, len(self.pattern) + 1, 2**31 - 1 - len(self.pattern))

    def umi(self, seq: Column, qual: Column, mask: int, space: int) -> Column:
        """UMI bases, those of a quality below mask as N."""
        if not mask:
            return self.take(seq, "N")
        each = [F.when(_phred(qual, i, space) < mask, F.lit("N")).otherwise(F.substring(seq, i + 1, 1)) for i in self.places("N")]
        return F.concat(*each) if each else F.substring(seq, 1, 0)

    def low(self, qual: Column, least: int, space: int) -> Column:
        out = F.lit(False)
        for i in self.places("N"):
            out = out | (_phred(qual, i, space) < least)
        return out

    def whole(self, name: Column, seq: Column) -> Column:
        """seq, or an error for a read shorter than the pattern."""
        wrong = F.raise_error(F.concat(F.lit(f"read shorter than the pattern {self.pattern}: "), name)).cast("string")
        return F.when(seq.isNull() | (F.char_length(seq) >= len(self.pattern)), seq).otherwise(wrong)


def _phred(qual: Column, i: int, space: int) -> Column:
    """Quality of base i; one below the encoding's first character is the lowest there is."""
    return F.ascii(F.substring(qual, i + 1, 1)) - space


def _header(name: Column, cell: Column, umi: Column) -> Column:
    """The id up to its last space, then _cell and _umi where they aren't empty."""
    base = F.when(F.instr(name, " ") > 0, F.regexp_extract(name, "^(.*) ", 1)).otherwise(name)
    part = lambda x: F.when(F.char_length(x) > 0, F.concat(F.lit("_"), x)).otherwise(F.lit(""))
    return F.concat(base, part(cell), part(umi))


def extract(r1: DataFrame, pattern1: str, retain_seq: bool = False, mask_qual: int = 0, quality_filter: int = 0, encoding: str = "phred33", compat: bool = False) -> DataFrame:
    """Single reads (read_ord, qname, descr, seq, qual as text) with barcodes cut off and put in the name, plus cell and umi.

    quality_filter drops reads with a UMI base below it. retain_seq leaves the sequence whole
    (compat: with its kept bases once more in front). Works on a streaming DataFrame, too.
    """
    layout, space = Layout(parse_pattern(pattern1)), SPACE[encoding]
    seq, qual = layout.whole(F.col("qname"), F.col("seq")), F.col("qual")
    out = r1.withColumn("seq", seq)
    if quality_filter:
        out = out.where(~layout.low(qual, quality_filter, space))
    cell, umi = layout.take(F.col("seq"), "C"), layout.umi(F.col("seq"), qual, mask_qual, space)
    out = out.withColumns({"cell": cell, "umi": umi})
    return out.withColumns({"qname": _header(F.col("qname"), F.col("cell"), F.col("umi")), "seq": _rest(layout, F.col("seq"), retain_seq, compat), "qual": _rest(layout, qual, retain_seq, compat)})


def _rest(layout: Layout, x: Column, retain: bool, compat: bool) -> Column:
    if retain:
        return F.concat(layout.take(x, "X"), x) if compat else x
    return F.concat(layout.take(x, "X"), layout.tail(x))


def zip_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """(read_ord, r1, r2): mates of one place in their files; where one file is shorter its side is null."""
    whole = lambda df, name: df.select("read_ord", F.struct(*[c for c in df.columns]).alias(name))
    return whole(r1, "r1").join(whole(r2, "r2"), "read_ord", "full")


def extract_pairs(r1: DataFrame, r2: DataFrame, pattern1: str | None = None, pattern2: str | None = None, retain_seq: bool = False, mask_qual: int = 0, quality_filter: int = 0, encoding: str = "phred33", compat: bool = False) -> DataFrame:
    """(read_ord, qname1, descr1, seq1, qual1, qname2, descr2, seq2, qual2, cell, umi).

    The cell and UMI parts of both mates are joined and put in both names; a mate without a
    pattern keeps its sequence; a pair goes if either mate's UMI is below quality_filter.
    """
    if not (pattern1 or pattern2):
        raise ValueError("at least one pattern is needed")
    space, out = SPACE[encoding], zip_mates(r1, r2)
    cells, umis, cut = [], [], {}
    for i, pattern in ((1, pattern1), (2, pattern2)):
        seq, qual = F.col(f"r{i}.seq"), F.col(f"r{i}.qual")
        if not pattern:
            cut[i] = (seq, qual)
            continue
        layout = Layout(parse_pattern(pattern))
        seq = layout.whole(F.col(f"r{i}.qname"), seq)
        if quality_filter:
            out = out.where(~F.coalesce(layout.low(qual, quality_filter, space), F.lit(False)))
        empty = F.lit("")
        cells.append(F.coalesce(layout.take(seq, "C"), empty))
        umis.append(F.coalesce(layout.umi(seq, qual, mask_qual, space), empty))
        cut[i] = (_rest(layout, seq, retain_seq, compat), _rest(layout, qual, retain_seq, compat))
    out = out.withColumns({"cell": F.concat(*cells), "umi": F.concat(*umis)})
    columns = [F.col("read_ord")]
    for i in (1, 2):
        columns += [_header(F.col(f"r{i}.qname"), F.col("cell"), F.col("umi")).alias(f"qname{i}"), F.col(f"r{i}.descr").alias(f"descr{i}"), cut[i][0].alias(f"seq{i}"), cut[i][1].alias(f"qual{i}")]
    return out.select(*columns, "cell", "umi")
