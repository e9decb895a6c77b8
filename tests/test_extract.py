import pytest

from strandfold.operators.extract import extract, extract_pairs, parse_pattern
from strandfold.streaming import extract_stream, read_stream

READ = "read_ord long, qname string, descr string, seq string, qual string"


def reads(spark, *rows):
    return spark.createDataFrame(list(rows), READ)


def test_patterns():
    assert parse_pattern("4N7C") == "NNNNCCCCCCC"
    assert parse_pattern("nnXc") == "NNXC"
    for bad in ("N47C", "4N7C8", "ABC", "", "0N"):
        with pytest.raises(ValueError):
            parse_pattern(bad)


def test_worked_example(spark):
    r = extract(reads(spark, (0, "id", "x", "GTTCCCGACCGTGC", "IIIIIIIIIIIIII")), "NNXXXXNNCC").first()
    assert (r.umi, r.cell, r.seq, r.qname, r.descr) == ("GTGA", "CC", "TCCCGTGC", "id_CC_GTGA", "x")
    assert len(r.qual) == len(r.seq)


def test_mask_filter_retain(spark):
    df = reads(spark, (0, "a", None, "ACGTTT", "I#IIII"), (1, "b", None, "ACGTTT", "IIIIII"), (2, "c", None, "ACGTTT", "\x1fIIIII"))
    assert [r.umi for r in extract(df, "NNX", mask_qual=10).orderBy("read_ord").collect()] == ["AN", "AC", "NC"]
    assert [r.read_ord for r in extract(df, "NNX", quality_filter=10).collect()] == [1]
    assert extract(df, "NNX", retain_seq=True).first().seq == "ACGTTT"
    assert extract(df, "NNX", retain_seq=True, compat=True).first().seq == "GACGTTT"


def test_short_read_is_an_error(spark):
    with pytest.raises(Exception, match="shorter than the pattern"):
        extract(reads(spark, (0, "a", None, "AC", "II")), "NNN").collect()


def test_pairs(spark):
    r1 = reads(spark, (0, "a", None, "ACGTT", "IIIII"), (1, "b", None, "CCGTT", "I#III"), (2, "c", None, "GCGTT", "IIIII"))
    r2 = reads(spark, (0, "a", "m", "TTTCA", "IIIII"), (1, "b", None, "TTTCA", "IIIII"))
    out = {r.read_ord: r for r in extract_pairs(r1, r2, "NC", "NNX").collect()}
    assert (out[0].qname1, out[0].qname2) == ("a_C_ATT", "a_C_ATT") and (out[0].seq1, out[0].seq2) == ("GTT", "TCA")
    assert out[2].qname2 is None and out[2].umi == "G"
    assert {r.read_ord for r in extract_pairs(r1, r2, "NC", None, quality_filter=10).collect()} == {0, 1, 2}
    assert {r.read_ord for r in extract_pairs(r1, r2, "NN", None, quality_filter=10).collect()} == {0, 2}
    assert extract_pairs(r1, r2, "NC", None).where("read_ord = 0").first().seq2 == "TTTCA"


def test_stream_gives_what_batch_gives(spark, tmp_path):
    df = reads(spark, *[(i, f"r{i}", None, "ACGTACGT"[i % 4 :] + "TTTT", "I" * (12 - i % 4)) for i in range(20)])
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    extract_stream(read_stream(spark, str(tmp_path / "in"), 1), "NNXC", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    key = ["read_ord", "qname", "seq", "qual", "cell", "umi"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect())) == sorted(map(tuple, extract(df, "NNXC").select(*key).collect()))
