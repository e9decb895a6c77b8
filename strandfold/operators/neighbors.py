"""The directed graph of UMIs: which may absorb which.

Two UMIs of one length with at most k mismatches share at least one of k + 1 pieces in the
same place, so an equi-join on (bundle, length, piece number, piece) finds all pairs; a pair is
kept at its first common piece only, which spares a distinct. Mismatches are counted on
2-bit packed UMIs, letter by letter where a UMI has other letters than A, C, G, T.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.functions.sequence import chunks, count_threshold, hamming, pack2, packed_mismatches, reverse_complement
from strandfold.schema import BUNDLE


def _mismatches(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    return F.when(pa.isNotNull() & pb.isNotNull(), packed_mismatches(pa, pb)).otherwise(hamming(a, b))


def _pieces(umis: DataFrame, of: str, count: int, suffix: str) -> DataFrame:
    """One row per piece of the column `of`; all columns renamed with the suffix but the bundle, length and piece."""
    pieces = chunks(F.col(of), count)
    rows = umis.select(
        *BUNDLE, F.char_length(of).alias("len"), F.col(of).alias(f"s_{suffix}"), pack2(F.col(of)).alias(f"p_{suffix}"),
        F.col("rank").alias(f"{suffix}_rank"), F.col("n_reads").alias(f"n_{suffix}"), pieces.alias(f"c_{suffix}"), F.posexplode(pieces).alias("piece_no", "piece"),
    )
    return rows


def _first_common(count: int) -> Column:
    """True where no earlier piece is equal, too."""
    earlier = [(F.col("piece_no") > i) & (F.get("c_u", i) == F.get("c_v", i)) for i in range(count - 1)]
    out = F.lit(True)
    for e in earlier:
        out = out & ~e
    return out


def pairs(umis: DataFrame, k: int) -> DataFrame:
    """(bundle, u_rank, v_rank, n_u, n_v, mismatches), u_rank < v_rank, of all UMIs within k mismatches."""
    u, v = (_pieces(umis, "umi", k + 1, s) for s in "uv")
    both = u.join(v, [*BUNDLE, "len", "piece_no", "piece"]).where(F.col("u_rank") < F.col("v_rank")).where(_first_common(k + 1))
    wrong = _mismatches(F.col("s_u"), F.col("s_v"), F.col("p_u"), F.col("p_v"))
    return both.withColumn("mismatches", wrong).where(F.col("mismatches") <= k).select(*BUNDLE, "u_rank", "v_rank", "n_u", "n_v", "mismatches")


def pairs_by_gap(umis: DataFrame) -> DataFrame:
    """As pairs(umis, 1), for bundles of very many short UMIs: two UMIs that differ in one place are equal around it.

    Each UMI has a key per place, the UMI with that place blotted out; no key has more UMIs
    than the alphabet has letters, so the rows grow with the UMIs, however many a bundle has.
    """
    n = F.char_length("umi")
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col("umi"), F.lit(1), i - 1), F.lit("*"), F.substring(F.col("umi"), i + 1, n)))
    rows = umis.where(n > 0).select(*BUNDLE, "rank", "n_reads", F.posexplode(keys).alias("at", "key"))
    u, v = (rows.select(*BUNDLE, "at", "key", F.col("rank").alias(f"{s}_rank"), F.col("n_reads").alias(f"n_{s}")) for s in "uv")
    return u.join(v, [*BUNDLE, "at", "key"]).where("u_rank < v_rank").select(*BUNDLE, "u_rank", "v_rank", "n_u", "n_v", F.lit(1).alias("mismatches"))


def edges(umis: DataFrame, k: int = 1, percentage: float = 0.5, rev: bool = False, one_bundle: bool = False) -> DataFrame:
    """(bundle, u_rank, v_rank): u may absorb v. one_bundle: bundles are few and very large, as of a FASTQ file.

    u and v are within k mismatches and v has at most the threshold of u; with rev also if the
    reverse complement of u is v, whatever the counts, or within k of v under the threshold.
    """
    p = pairs_by_gap(umis) if one_bundle and k == 1 else pairs(umis, k)
    may = lambda a, b: F.col(b) <= count_threshold(percentage, F.col(a))
    ways = F.array(F.when(may("n_u", "n_v"), F.struct("u_rank", "v_rank")), F.when(may("n_v", "n_u"), F.struct(F.col("v_rank").alias("u_rank"), F.col("u_rank").alias("v_rank"))))
    out = p.select(*BUNDLE, F.explode(F.filter(ways, lambda e: e.isNotNull())).alias("e")).select(*BUNDLE, "e.u_rank", "e.v_rank")
    if rev:
        u = _pieces(umis.withColumn("rc", reverse_complement(F.col("umi"))), "rc", k + 1, "u")
        v = _pieces(umis, "umi", k + 1, "v")
        both = u.join(v, [*BUNDLE, "len", "piece_no", "piece"]).where(F.col("u_rank") != F.col("v_rank")).where(_first_common(k + 1))
        wrong = _mismatches(F.col("s_u"), F.col("s_v"), F.col("p_u"), F.col("p_v"))
        both = both.withColumn("mismatches", wrong).where((F.col("mismatches") == 0) | ((F.col("mismatches") <= k) & may("n_u", "n_v")))
        out = out.unionByName(both.select(*BUNDLE, "u_rank", "v_rank")).distinct()
    return out
