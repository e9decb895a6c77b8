import glob
import gzip
import os
import random

import pytest

from strandfold import __main__ as command
from strandfold import api
from strandfold.sources import bam


def test_fastq_from_extraction_to_dedup(spark, tmp_path, caplog):
    caplog.set_level("INFO", "strandfold")
    rng = random.Random(1)
    umis = ["ACGTA", "TTTTT", "GGCCA"]
    with gzip.open(tmp_path / "x.fastq.gz", "wt") as f:
        for i in range(60):
            u = rng.choice(umis)
            f.write(f"@r{i} d\n{u[:3]}GATT{u[3:]}CCC\n+\n{'I' * 12}\n")
    api.extract_files(spark, str(tmp_path / "x.fastq.gz"), str(tmp_path / "e.fastq.gz"), "NNNXXXXNN")
    text = "".join(gzip.open(p, "rt").read() for p in sorted(glob.glob(str(tmp_path / "e.fastq.gz" / "part*"))))
    assert text.startswith("@r0_") and text.split("\n")[1] == "GATTCCC" and len(text.split("\n")) == 241
    with gzip.open(tmp_path / "in.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "bad.bam").write_bytes(b"no bam")
    (tmp_path / "all").mkdir()
    for n in ("in.fastq.gz", "bad.bam"):
        os.rename(tmp_path / n, tmp_path / "all" / n)
    done = api.dedup_files(spark, str(tmp_path / "all"), str(tmp_path / "out"))
    assert [v is None for _, v in sorted(done.items())] == [False, True]
    (report,) = glob.glob(str(tmp_path / "out" / "in_dedup_report.tsv"))
    head, row = open(report).read().strip().split("\n")
    got = dict(zip(head.split("\t"), row.split("\t")))
    assert (got["num_reads_input_file"], got["num_passing_groups"], got["num_total_barcodes"]) == ("60", "3", "3")
    assert any("num reads input file" in r.getMessage() for r in caplog.records) and any(r.levelname == "ERROR" and "bad.bam" in r.getMessage() for r in caplog.records)
    with pytest.raises(ValueError):
        api.extract_files(spark, "a", "b", "N", r2="c")


@pytest.mark.parametrize("mode", ["plain", "paired", "merge"])
def test_bam(spark, tmp_path, mode):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    (tmp_path / "r.fa").write_text(f">c\n{ref}\n")
    rows = []
    for i in range(40):
        p = 20 + 50 * (i % 4)
        for side, at in ((64, p), (128 | 16, p + 10)):
            rows.append((len(rows), f"q{i}_ACGT", side, 0, "c", at, 60, "20M", 0, p, 0, ref[at : at + 20], b"I" * 20, {}))
    df = spark.createDataFrame(rows, "read_ord long, qname string, flag int, chr int, chr_name string, pos long, mapq int, cigar string, mate_chr int, mate_pos long, tlen long, seq string, qual binary, tags map<string,string>")
    bam.write_bam(df, str(tmp_path / "w"), "@SQ\tSN:c\tLN:300\n", files=1)
    (part,) = glob.glob(str(tmp_path / "w" / "*.bam"))
    os.rename(part, tmp_path / "in.bam")
    done = api.dedup_files(spark, str(tmp_path / "in.bam"), str(tmp_path / "out"), paired=mode == "paired", merge_fasta=str(tmp_path / "r.fa") if mode == "merge" else None)
    assert list(done.values()) == [None]
    out = bam.read_bam(spark, str(tmp_path / "out" / "in_directional.bam"))
    n = {"plain": 4, "paired": 8, "merge": 4}[mode]
    assert out.count() == n
    if mode == "merge":
        r = out.orderBy("pos").first()
        assert r.qname.endswith(":MERGED") and (r.pos, r.cigar, r.seq) == (20, "30=", ref[20:50])


def test_one_file_windows_and_coverage(spark, tmp_path):
    rows = [(i, f"q{i}_ACGT", 0, 0, "c", 10 + 300 * (i % 2), 60, "8M", "ACGTACGT", b"I" * 8) for i in range(12)]
    df = spark.createDataFrame(rows, "read_ord long, qname string, flag int, chr int, chr_name string, pos long, mapq int, cigar string, seq string, qual binary")
    bam.write_bam(df, str(tmp_path / "w"), "@SQ\tSN:c\tLN:1000\n", files=1)
    os.rename(glob.glob(str(tmp_path / "w" / "*.bam"))[0], tmp_path / "in.bam")
    uri = f"file://{tmp_path}"
    for window in (None, 50):
        assert api.dedup_files(spark, f"{uri}/in.bam", f"{uri}/o{window}", split_window=window, one_file=True) == {f"{uri}/in.bam": None}
        assert (tmp_path / f"o{window}" / "in_directional.bam").is_file() and (tmp_path / f"o{window}" / "in_directional.bam.bai").is_file()
        assert bam.read_bam(spark, f"{uri}/o{window}/in_directional.bam").count() == 2
    for wrong in (0, -5, 1.5):
        with pytest.raises(ValueError):
            api.dedup_files(spark, f"{uri}/in.bam", f"{uri}/o", split_window=wrong)
    assert api.coverage_files(spark, f"{uri}/in.bam", f"{uri}/cov") == {f"{uri}/in.bam": None}
    head, row = (tmp_path / "cov" / "in_coverage.tsv").read_text().strip().split("\n")
    assert dict(zip(head.split("\t"), row.split("\t")))["covbases"] == "16"


def test_command_line():
    p = command.parser()
    got = vars(p.parse_args("dedup -i x.bam -o out -g acyclic --split-window 50 -u --merge-pairs r.fa".split()))
    names = api.dedup_files.__code__.co_varnames[: api.dedup_files.__code__.co_argcount]
    assert set(got) - {"run", "input", "max_edit"} <= {*names, "outdir"} and got["method"] == "acyclic" and got["rev"] and got["split_window"] == 50 and got["merge_fasta"] == "r.fa"
    got = vars(p.parse_args("extract -i a.fq -o b.fq -p NNNX --mask-qual 10".split()))
    assert got["pattern1"] == "NNNX" and got["mask_qual"] == 10 and got["encoding"] == "phred33"
    with pytest.raises(SystemExit):
        p.parse_args(["dedup"])
