"""FASTQ as a Spark data source, plain or gzip, and back.

    spark.dataSource.register(FastqSource); spark.read.format("fastq").load(path)

A gzip file is one partition, since it can't be entered in the middle. A plain file is read
in ranges of bytes; each range starts at the first whole record in it. read_ord, and where
records begin, follow from the lines before the range: read_fastq() counts the line ends of
all ranges in one job of its own, each byte once, and hands the sums to the source. Paths may be URIs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandfold.sources import storage

SCHEMA = "read_ord long, sample string, qname string, descr string, seq string, qual string"
BATCH = 10_000
RANGE_BYTES = 64 << 20


class FastqSource(DataSource):
    """Options: path (file, folder or pattern), rangebytes, and lines: JSON of the lines before each range of each file.

    Without lines, a range that doesn't begin its file counts those before it by itself.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, before: int) -> None:
        self.path, self.start, self.end, self.before = path, start, end, before


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.lines = json.loads(options.get("lines", "{}"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in _paths(self.path):
            many = ranges(p, self.size)
            before = self.lines.get(p, [-1] * len(many))
            out += [_Range(p, a, b, n) for (a, b), n in zip(many, before)] if many else [_Range(p, 0, -1, 0)]
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no files
            return
        sample = part.path.rpartition("/")[2]
        if part.end < 0:
            with storage.text_reader(part.path) as f:
                yield from _batches(_records(f), sample, 0)
            return
        with storage.reader(part.path) as f:
            before = part.before if part.before >= 0 else _ends_in(f, 0, part.start)
            if part.start:  # a line that began before the range counts with those before it
                f.seek(part.start - 1)
                before += f.read(1) != b"\n"
                f.seek(part.start - 1)
                f.readline()  # the rest of that line; nothing where the range begins a line
            skip = -before % 4
            for _ in range(skip):
                f.readline()
            yield from _batches(_records(f, part.end), sample, (before + skip) // 4)


def _paths(path: str) -> list[str]:
    return storage.find(path, lambda f: f.rpartition(".")[2] in ("fastq", "fq", "gz", "txt"))  # txt: what Spark calls the parts that write_fastq leaves


def ranges(path: str, size: int) -> list[tuple[int, int]]:
    """The ranges of bytes that a file is read in; none if it is read as a whole."""
    n = storage.size(path)
    return [] if path.endswith(".gz") or n <= size else [(a, min(a + size, n)) for a in range(0, n, size)]


def _ends_in(f, start: int, end: int) -> int:
    """Line ends in a range of bytes."""
    f.seek(start)
    n, left = 0, end - start
    while left > 0 and (b := f.read(min(left, 1 << 22))):
        n, left = n + b.count(b"\n"), left - len(b)
    return n


def _records(f, end: int | None = None) -> Iterator[tuple[bytes, bytes, bytes]]:
    while end is None or f.tell() < end:
        head = f.readline()
        if not head:
            return
        if not head.strip():
            continue
        seq, plus, qual = f.readline().rstrip(b"\r\n"), f.readline(), f.readline().rstrip(b"\r\n")
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
            raise ValueError(f"not a whole FASTQ record: {head[:80]!r}")
        yield head[1:].rstrip(b"\r\n"), seq, qual


def _batches(records: Iterator[tuple[bytes, bytes, bytes]], sample: str, n: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("read_ord", pa.int64()), *[(c, pa.string()) for c in ("sample", "qname", "descr", "seq", "qual")]])
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    for head, seq, qual in records:
        name, _, descr = head.decode("latin-1").partition(" ")
        rows.append((n, sample, name, descr or None, seq.decode("latin-1"), qual.decode("latin-1")))
        n += 1
        if len(rows) == BATCH:
            yield batch()
            rows = []
    if rows:
        yield batch()


def lines_before(spark: SparkSession, paths: list[str], size: int) -> dict[str, list[int]]:
    """For each file that is read in ranges, the line ends before each range: one number a range comes to the driver."""
    todo = [(p, i, a, b) for p in paths for i, (a, b) in enumerate(ranges(p, size))]
    if not todo:
        return {}

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bs:
            counts = []
            for path, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                with storage.reader(path) as f:
                    counts.append(_ends_in(f, start, end))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["path", "i", "n"])

    df = spark.createDataFrame(todo, "path string, i int, a long, b long").repartition(len(todo), "path", "i")
    counts: dict[str, list[int]] = {}
    for r in sorted(df.mapInArrow(run, "path string, i int, n long").collect(), key=lambda r: (r["path"], r["i"])):
        counts.setdefault(r["path"], []).append(r["n"])
    return {p: list(accumulate([0, *n[:-1]])) for p, n in counts.items()}


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FastqSource)
    lines = lines_before(spark, _paths(path), int(options.get("rangebytes", RANGE_BYTES)))
    return spark.read.format("fastq").options(**options, **({"lines": json.dumps(lines)} if lines else {})).load(path)


def frames(reads: DataFrame) -> DataFrame:
    """One text of four lines a read."""
    name = F.concat(F.lit("@"), F.concat_ws(" ", "qname", "descr"))
    return reads.select(F.concat_ws("\n", name, F.col("seq"), F.lit("+"), F.col("qual")).alias("value"))


def write_fastq(reads: DataFrame, path: str, gzipped: bool = True, ordered: bool = True, files: int | None = None) -> None:
    """A folder of FASTQ files that, one after the other, hold the reads in read_ord (unless not ordered).

    Range partitions keep the order over many files; files=1 makes one.
    """
    if ordered:
        reads = (reads.repartitionByRange(files, "read_ord") if files and files > 1 else reads.coalesce(1) if files else reads.repartitionByRange("read_ord")).sortWithinPartitions("read_ord")
    frames(reads).write.text(path, compression="gzip" if gzipped else "none")
