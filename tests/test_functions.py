import pytest
from pyspark.sql import functions as F

from strandfold.functions import cigar as C
from strandfold.functions import sequence as S


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bytes: "binary", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("name,umi", [("r1_ACGT", "ACGT"), ("a_b_ACGT/1", "ACGT"), ("a_AC/G/2", "AC/G"), ("x_", ""), (None, None)])
def test_umi_from_name(spark, name, umi):
    assert one(spark, S.umi_from_name(F.col("n")), n=name) == umi


def test_name_without_separator_is_an_error(spark):
    with pytest.raises(Exception, match="without separator"):
        one(spark, S.umi_from_name(F.col("n"), ":"), n="r1_ACGT")


@pytest.mark.parametrize("seq,rc", [("GTCTATATA", "TATATAGAC"), ("acgn", "NCGT"), ("", "")])
def test_reverse_complement(spark, seq, rc):
    assert one(spark, S.reverse_complement(F.col("s")), s=seq) == rc
    assert one(spark, S.reverse_complement(S.reverse_complement(F.col("s"))), s=seq) == seq.upper()


def test_reverse_complement_refuses_other_letters(spark):
    with pytest.raises(Exception, match="no base"):
        one(spark, S.reverse_complement(F.col("s")), s="ACU")


@pytest.mark.parametrize("seq,n,want", [
    ("AGCTCTAGCTACGAG", 2, ["AGCTCTAG", "CTACGAG"]), ("GGGGGGGCCCCCCGGGGGGCCCCCC", 3, ["GGGGGGGCC", "CCCCGGGGG", "GCCCCCC"]), ("GTCTAC", 2, ["GTC", "TAC"]),
])
def test_chunks(spark, seq, n, want):
    assert one(spark, S.chunks(F.col("s"), n), s=seq) == want


def test_chunks_with_a_set_length(spark):
    assert one(spark, S.chunks(F.col("s"), 2, F.lit(6)), s="GTCTACG") == ["GTC", "TACG"]


@pytest.mark.parametrize("a,b,d", [("ACGT", "ACGT", 0), ("ACGT", "TCGA", 2), ("NNA", "NCA", 1), ("A", "AC", None), ("", "", 0)])
def test_hamming(spark, a, b, d):
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a=a, b=b) == d
    if d is not None and "N" not in a + b:
        assert one(spark, S.packed_mismatches(S.pack2(F.col("a")), S.pack2(F.col("b"))), a=a, b=b) == d


def test_threshold_is_single_precision(spark):
    import numpy as np

    rows = spark.range(1, 500).select("id", *[S.count_threshold(p / 100, F.col("id")).alias(f"p{p}") for p in range(1, 101, 7)]).collect()
    for r in rows:
        for p in range(1, 101, 7):
            assert r[f"p{p}"] == int(np.float32(p / 100) * np.float32(r.id + 1))


@pytest.mark.parametrize("cigar,ref,query,lead,trail", [("10M", 10, 10, 0, 0), ("3S5M2I4M1D2M4S", 12, 20, 3, 4), ("2H3S5=1X2S1H", 6, 11, 3, 2), ("5M100N5M", 110, 10, 0, 0), ("*", 0, 0, 0, 0)])
def test_cigar_lengths(spark, cigar, ref, query, lead, trail):
    ops = C.operations(F.col("c"))
    got = one(spark, F.array(C.reference_length(ops), C.query_length(ops), C.leading_softclip(ops), C.trailing_softclip(ops)), c=cigar)
    assert got == [ref, query, lead, trail]


def test_group_position(spark):
    ops = C.operations(F.col("c"))
    assert one(spark, C.group_position(F.col("p"), ops, F.lit(False)), c="3S10M2S", p=1) == -2
    assert one(spark, C.group_position(F.col("p"), ops, F.lit(True)), c="3S10M2S", p=1) == 13


def test_bad_cigar_is_an_error(spark):
    with pytest.raises(Exception, match="not a CIGAR"):
        one(spark, F.size(C.operations(F.col("c"))), c="10Q")


def test_quality_sums(spark):
    assert one(spark, S.quality_sum(F.col("q")), q=bytes([0, 255, 40, 7])) == 302
    assert one(spark, S.quality_sum(F.col("q")), q=b"") == 0
    assert one(spark, S.ascii_sum(F.col("q")), q="####") == 140
    assert one(spark, S.ascii_sum(F.col("q")), q="") == 0
