import glob
import gzip
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.sources import bam, fasta, fastq, files


def test_files(tmp_path):
    for n in ("b.bam", "a.fastq.gz", "c.bam.bai", "d.txt", "e.fastq"):
        (tmp_path / n).touch()
    (tmp_path / "sub.bam").mkdir()
    assert [(os.path.basename(p), k) for p, k in files.gather(str(tmp_path))] == [("a.fastq.gz", "fastq"), ("b.bam", "bam"), ("e.fastq", "fastq")]
    with pytest.raises(ValueError):
        files.gather(str(tmp_path / "d.txt"))
    with pytest.raises(FileNotFoundError):
        files.gather(str(tmp_path / "none.bam"))
    assert files.output_name("/x/a.b.bam", "dedup", "/o") == "/o/a.b_dedup.bam"
    assert files.report_name("/x/a.b.bam", "dedup", "/o") == "/o/a_dedup_report.tsv"


def fastq_text(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randint(0, 60)
        qual = "".join(chr(rng.randint(33, 73)) for _ in range(k))
        out.append((i, f"r{i}", rng.choice([None, "a b"]), "".join(rng.choice("ACGTN") for _ in range(k)), rng.choice(["@", "+", ""])[: k and 1] + qual[1:] if k and rng.random() < 0.3 and len(qual) > 1 else qual))
    return [(i, n, d, s, (q + "I" * len(s))[: len(s)]) for i, n, d, s, q in out]


def write(path, rows, opener=open):
    with opener(path, "wt") as f:
        for _, n, d, s, q in rows:
            f.write(f"@{n}{' ' + d if d else ''}\n{s}\n+\n{q}\n")


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
def test_fastq_ranges(spark, tmp_path, size):
    rows = fastq_text(200)
    write(tmp_path / "x.fastq", rows)
    df = fastq.read_fastq(spark, str(tmp_path / "x.fastq"), rangebytes=size)
    assert sorted(map(tuple, df.select("read_ord", "qname", "descr", "seq", "qual").collect())) == rows


def test_fastq_gzip_and_back(spark, tmp_path):
    rows = fastq_text(100)
    write(tmp_path / "x.fastq.gz", rows, gzip.open)
    df = fastq.read_fastq(spark, str(tmp_path / "x.fastq.gz"))
    for n, gz in ((1, True), (3, False)):
        out = str(tmp_path / f"out{n}")
        fastq.write_fastq(df, out, gzipped=gz, files=n)
        parts = sorted(f for f in os.listdir(out) if f.startswith("part"))
        text = "".join((gzip.open if gz else open)(f"{out}/{f}", "rt").read() for f in parts)
        assert [x[1:].split(" ")[0] for x in text.split("\n")[::4] if x] == [f"r{i}" for i in range(100)]


def test_broken_fastq(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "x.fastq")).collect()


def test_fasta(tmp_path):
    (tmp_path / "r.fa").write_text(">one x\nACG\nT\n>two\nGG\n")
    assert fasta.first_record(str(tmp_path / "r.fa")) == ("one", "ACGT")
    (tmp_path / "e.fa").write_text("")
    with pytest.raises(ValueError):
        fasta.first_record(str(tmp_path / "e.fa"))


HEADER = "@HD\tVN:1.6\n@SQ\tSN:one\tLN:100000\n@SQ\tSN:two\tLN:5000\n"


def alignments(spark, n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        k = rng.randint(1, 150)
        ref = rng.choice([0, 1, -1])
        rows.append((i, f"q{i}_ACG", rng.choice([0, 16, 4, 99]), ref, {0: "one", 1: "two", -1: None}[ref], rng.randrange(5000) if ref >= 0 else -1, rng.randrange(61), f"{k}M" if ref >= 0 else None, -1, -1, rng.randrange(-500, 500), "".join(rng.choice("ACGTN") for _ in range(k)), bytes(rng.randrange(60) for _ in range(k)), {"NM": str(rng.randrange(9)), "RG": "x y"}))
    return spark.createDataFrame(rows, "read_ord long, qname string, flag int, chr int, chr_name string, pos long, mapq int, cigar string, mate_chr int, mate_pos long, tlen long, seq string, qual binary, tags map<string,string>")


@pytest.mark.parametrize("size", [300, 20_000, 32 << 20])
def test_bam_and_back_in_ranges(spark, tmp_path, size):
    df = alignments(spark, 3000)
    bam.write_bam(df, str(tmp_path / "out"), HEADER, files=1)
    (name,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".bam")]
    back = bam.read_bam(spark, str(tmp_path / "out" / name), rangebytes=size)
    cols = ["qname", "flag", "chr", "chr_name", "pos", "mapq", "cigar", "mate_chr", "mate_pos", "tlen", "seq", "qual"]
    key = lambda d: sorted([*map(str, r[:-1]), sorted(r[-1].items())] for r in d.select(*cols, "tags").collect())
    assert key(back) == key(df)
    rows = back.select("read_ord", "chr", "pos").orderBy("read_ord").collect()
    assert len({r.read_ord for r in rows}) == 3000
    where = [(r.chr if r.chr >= 0 else 99, r.pos) for r in rows]
    assert where == sorted(where)
    some = back.where("chr = 1 and pos >= 1000 and pos < 2000")
    assert some.count() == df.where("chr = 1 and pos >= 1000 and pos < 2000").count() > 0


def test_bam_header(spark, tmp_path):
    bam.write_bam(alignments(spark, 10), str(tmp_path / "o"), HEADER, files=1)
    refs = bam.references(spark, str(tmp_path / "o"))
    assert [(r.chr_name, r.length) for r in refs.orderBy("chr").collect()] == [("one", 100000), ("two", 5000)]


def test_tags():
    raw = b"NMC\x05" + b"XAAq" + b"BXZACGT\0" + b"ZFf\x00\x00\x80\x3f" + b"ARBs\x02\x00\x00\x00\x01\x00\xff\xff"
    assert bam.decode_tags(raw) == {"NM": "5", "XA": "q", "BX": "ACGT", "ZF": "1.0", "AR": "s,1,-1"}


def test_dedup_tags_are_written(spark, tmp_path):
    df = alignments(spark, 20).where("chr >= 0").withColumn("bx", F.lit("ACG")).withColumn("ug", F.lit("t1"))
    bam.write_bam(df, str(tmp_path / "o"), HEADER)
    tags = [r.tags for r in bam.read_bam(spark, str(tmp_path / "o")).collect()]
    assert tags and all(t["BX"] == "ACG" and t["UG"] == "t1" for t in tags)


def test_bam_index(spark, tmp_path):
    """Each record lies in a chunk of its bin and not before the offset of its window; a filter on one reference reads its ranges only."""
    rng = random.Random(5)
    rows = sorted((rng.randrange(3), rng.randrange(400_000), i) for i in range(5000))
    df = spark.createDataFrame([(i, f"q{i}", 0, c, p, "40M", "A" * 40, b"I" * 40) for c, p, i in rows if c != 1] + [(9999, "u", 4, -1, -1, None, "A", b"I")], "read_ord long, qname string, flag int, chr int, pos long, cigar string, seq string, qual binary")
    header = "".join(f"@SQ\tSN:c{i}\tLN:500000\n" for i in range(3))
    bam.write_bam(df, str(tmp_path / "w"), header, files=1)
    (file,), (index,) = glob.glob(str(tmp_path / "w" / "*.bam")), glob.glob(str(tmp_path / "w" / "*.bai"))
    data, at, seen = open(index, "rb").read(), 8, {}
    back = {r.qname: (r.read_ord, r.chr, r.pos) for r in bam.read_bam(spark, file).collect()}
    assert len(back) == df.count() and data[:4] == b"BAI\1" and struct.unpack_from("<i", data, 4)[0] == 3
    for ref in range(3):
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        chunks = {}
        for _ in range(n):
            b, k = struct.unpack_from("<Ii", data, at)
            chunks[b] = [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(k)]
            at += 8 + 16 * k
        wide = struct.unpack_from("<i", data, at)[0]
        linear = struct.unpack_from(f"<{wide}Q", data, at + 4)
        at += 4 + 8 * wide
        for v, c, p in back.values():
            if c == ref:
                b = int(bam._bins(np.array([p]), np.array([p + 40]))[0])
                assert any(a <= v < e for a, e in chunks[b]) and linear[p >> 14] <= v
                seen[ref] = seen.get(ref, 0) + 1
    assert at + 8 == len(data) and struct.unpack_from("<Q", data, at)[0] == 1 and set(seen) == {0, 2}
    for ref in range(3):
        got = bam.read_bam(spark, file, rangebytes=3000).where(f"chr = {ref}").collect()
        assert len(got) == seen.get(ref, 0)
    assert bam.indexed_span(data, 1) is None and bam.indexed_span(data, 0)[1] <= bam.indexed_span(data, 2)[0]


def test_uris_and_line_counts(spark, tmp_path):
    """Paths as URIs, for all sources and sinks; line ends are counted in one job, and ranges read only their own bytes."""
    text = "".join(f"@r{i} x\n{'ACGT' * (1 + i % 5)}\n+\n{'IIII' * (1 + i % 5)}\n" for i in range(500))
    (tmp_path / "a.fq").write_text(text)
    uri = f"file://{tmp_path}/a.fq"
    lines = fastq.lines_before(spark, [uri], 777)
    assert lines[uri] == [text.encode()[:a].count(b"\n") for a in range(0, len(text), 777)]
    for size in (777, 100, 10**6):
        got = fastq.read_fastq(spark, uri, rangebytes=size).orderBy("read_ord").collect()
        assert [(r.read_ord, r.qname, len(r.seq)) for r in got] == [(i, f"r{i}", 4 * (1 + i % 5)) for i in range(500)]
    df = spark.createDataFrame([(1, "q", 0, 0, 5, "4M", "ACGT", b"IIII")], "read_ord long, qname string, flag int, chr int, pos long, cigar string, seq string, qual binary")
    bam.write_bam(df, f"file://{tmp_path}/w", "@SQ\tSN:c\tLN:50\n")
    assert bam.read_bam(spark, f"file://{tmp_path}/w").count() == 1
    assert files.gather(f"file://{tmp_path}") == [(f"file://{tmp_path}/a.fq", "fastq")]
    with pytest.raises(FileNotFoundError):
        fastq.read_fastq(spark, f"file://{tmp_path}/none*.fq")


def test_one_bam_file_is_written_by_many_tasks(spark, tmp_path):
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = alignments(spark, 3000)
        bam.write_bam(df, str(tmp_path / "one"), HEADER, files=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert sorted(f.name for f in (tmp_path / "one").iterdir() if not f.name.startswith(".")) == ["part-00000.bam", "part-00000.bam.bai"]
    path = str(tmp_path / "one" / "part-00000.bam")
    with open(path, "rb") as f:
        sizes = [len(c) for _, c in bam.blocks(f, 0, bam.storage.size(path))]
    assert sum(0 < n < bam.BLOCK_BYTES for n in sizes) > 2  # blocks that end with a task's records
    read = bam.read_bam(spark, path)
    assert read.count() == df.count()
    assert [r.pos for r in read.where("chr = 1").orderBy("read_ord").collect()] == sorted(r.pos for r in df.where("chr = 1").collect())
    index = bam.Index(1)
    n = 200_000
    for lo in range(0, n, 5000):
        at = np.arange(lo, lo + 5000)
        index.add(np.zeros(5000, np.int64), at // 10, at // 10 + 50, 100 * at, 100 * at + 100)
    assert index.ordered and sum(map(len, index.some)) < n / 100 and len(index.linear) < 10
