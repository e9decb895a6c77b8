"""Reports as tab-separated text with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandfold.sources import storage

#: A report is a row, or a row a reference sequence; more rows than this aren't one.
MOST_ROWS = 1_000_000


def write_tsv(report: DataFrame, path: str) -> None:
    """One file of that very name. Nulls are written as nothing; tabs and line ends in values as spaces."""
    rows = report.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report; write the table itself")
    clean = lambda v: "" if v is None else str(v).translate({9: " ", 10: " ", 13: " "})
    with storage.writer(path) as f:
        for row in [report.columns, *rows]:
            f.write(("\t".join(map(clean, row)) + "\n").encode())


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def as_text(report: DataFrame) -> str:
    """A report of one row for the console: a line a column, numbers in groups of three digits."""
    row = report.first()
    wide = max(map(len, report.columns))
    shown = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) else str(v)
    return "\n".join(f"{c.replace('_', ' '):<{wide}}  {shown(row[c])}" for c in report.columns)
