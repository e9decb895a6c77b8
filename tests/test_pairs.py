import itertools
import random

from pyspark.sql import functions as F

from strandfold.operators import align, coverage, pairs
from strandfold.plans import catalog

ROW = "read_ord long, qname string, flag int, chr int, pos long, cigar string, seq string, qual binary, bx string"


def row(n, name, flag, pos, seq, cigar=None, bx="B"):
    return (n, name, flag, 0, pos, cigar or f"{len(seq)}M", seq, b"I" * len(seq), bx)


def test_overlap_and_compare():
    assert pairs.overlaps((10, 14), (12, 16)) and not pairs.overlaps((10, 14), (20, 24)) and not pairs.overlaps((12, 16), (10, 14))
    assert pairs.overlaps((10, 14), (14, 18)) and pairs.overlaps((3, 5), (3, 5))
    assert pairs.compare({1: "A", 2: "C"}, {2: "C", 3: "G"}, 1) == ("merged", {1: "A", 2: "C", 3: "G"})
    assert pairs.compare({1: "A"}, {2: "C"}, 1)[0] == "unmerged" and pairs.compare({1: "A"}, {1: "C"}, 1)[0] == "discordant"


def test_worked_merge(spark):
    df = spark.createDataFrame([row(0, "a", 0, 10, "ATCG"), row(1, "b", 16, 13, "GATC")], ROW)
    (r,) = pairs.merge_pairs(df, "ATCGATC", 1).collect()
    assert (r.seq, r.cigar, r.pos, r.qname, r.status) == ("ATCGATC", "7=", 0, "a:MERGED", "merged") and bytes(r.qual) == b"\xff" * 7


def test_kinds_of_results_and_report(spark):
    df = spark.createDataFrame(
        [
            row(0, "lone", 0, 1, "ACGT", bx=None), row(1, "d", 0, 10, "ACGT", bx="D"), row(2, "d", 16, 11, "GGGG", bx="D"),
            row(3, "n", 0, 10, "ACGT", bx="N"), row(4, "n", 16, 14, "ACGT", bx="N"), row(5, "f", 0, 10, "ACGTA", bx="F"), row(6, "f", 0, 11, "CGTAA", bx="F"),
            row(7, "m", 0, 10, "ACGTA", bx="M"), row(8, "m", 16, 12, "GTACC", bx="M"),
        ],
        ROW,
    )
    out = pairs.merge_pairs(df, None, 3)
    got = {(r.qname, r.status) for r in out.collect()}
    assert got == {("lone", None), ("d", "discordant"), ("n", "unmerged"), ("f", "unmerged"), ("m:MERGED", "merged")}
    r = pairs.merge_report(out, df).first()
    assert (r.num_reads_in, r.num_reads_out, r.num_discordant, r.num_unmerged, r.num_merged) == (9, 6, 1, 4, 1)
    assert pairs.merge_pairs(df.limit(0), None).count() == 0


def score(query, ref, start, cigar):
    total, q, r, n = 0, 0, start, 0
    for c in cigar:
        if c.isdigit():
            n = n * 10 + int(c)
            continue
        if c in "=X":
            for i in range(n):
                total += align.SCORES[align.LETTERS.index(query[q + i])][align.LETTERS.index(ref[r + i])]
                assert (query[q + i] == ref[r + i]) == (c == "=")
            q, r = q + n, r + n
        elif c == "I":
            total, q = total - 5 - n, q + n
        else:
            total, r = total - 5 - n, r + n
        n = 0
    assert q == len(query)
    return total


def best(query, ref):
    """All scores by the plain recurrence."""
    m, n = len(query), len(ref)
    low = -(10**6)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    e = [[low] * (n + 1) for _ in range(m + 1)]
    f = [[low] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(n + 1):
            e[i][j] = max(h[i - 1][j] - 6, e[i - 1][j] - 1)
            f[i][j] = max(h[i][j - 1] - 6, f[i][j - 1] - 1) if j else low
            d = h[i - 1][j - 1] + align.SCORES[align.LETTERS.index(query[i - 1])][align.LETTERS.index(ref[j - 1])] if j else low
            h[i][j] = max(d, e[i][j], f[i][j])
    return max(h[m])


def test_alignment_is_optimal():
    rng = random.Random(5)
    for _ in range(150):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        a = rng.randrange(len(ref))
        query = list(ref[a : a + rng.randint(1, 20)])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(query))
            rng.choice([lambda: query.insert(at, rng.choice("ACGT")), lambda: query.__setitem__(at, rng.choice("ACGT")), lambda: query.pop(at) if len(query) > 1 else None])()
        query = "".join(query)
        start, cigar = align.ReferenceIndex(ref).align(query)
        assert score(query, ref, start, cigar) == best(query, ref)
    assert align.ReferenceIndex("ACGT").align("") == (0, "")


def test_mates_come_back(spark):
    reads = spark.createDataFrame([row(0, "a", 64, 1, "ACGT"), row(1, "a", 128, 9, "ACGT"), row(2, "b", 128, 9, "ACGT")], ROW)
    out = pairs.with_mates(reads.where("read_ord = 0").withColumn("ug", F.lit("t")), reads)
    assert sorted((r.read_ord, r.ug) for r in out.collect()) == [(0, "t"), (1, None)] or {r.read_ord for r in out.collect()} == {0, 1}
    assert [r.read_ord for r in pairs.by_coordinate(reads).collect()] == [0, 1, 2]


def test_coverage_against_counting(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        chrom = rng.choice(["c1", "c2"])
        rows.append((i, rng.choice([0, 0, 0, 4, 256, 1024]), chrom, rng.choice([rng.randrange(300), 65500 + rng.randrange(80)]), rng.randrange(60), rng.choice(["10M", "2S5M3D5M", "5M60N5M", "4M2I4M1S"])))
    q = {"10M": 10, "2S5M3D5M": 12, "5M60N5M": 10, "4M2I4M1S": 11}
    rows = [(*r, bytes(rng.randrange(40) for _ in range(q[r[5]]))) for r in rows]
    df = spark.createDataFrame(rows, "read_ord long, flag int, chr_name string, pos long, mapq int, cigar string, qual binary")
    refs = spark.createDataFrame([("c1", 70000), ("c2", 70000), ("c3", 10)], "chr_name string, length long")
    got = {r.rname: r for r in coverage.coverage(df, refs).collect()}
    for c in ("c1", "c2"):
        depth, quality, own = {}, 0, [r for r in rows if r[2] == c and r[1] & 1796 == 0]
        for r in own:
            a, _ = pairs._aligned(r[3], r[5])
            for qp, rp in a:
                depth[rp] = depth.get(rp, 0) + 1
                quality += r[6][qp]
        n = sum(depth.values())
        assert (got[c].numreads, got[c].covbases) == (len(own), len(depth))
        assert abs(got[c].meandepth - n / 70000) < 1e-9 and abs(got[c].meanbaseq - quality / n) < 1e-9 and abs(got[c].meanmapq - sum(r[4] for r in own) / len(own)) < 1e-9
    assert got["c3"].covbases == 0 and got["c3"].coverage == 0


def test_merge_takes_each_read_once():
    rows = [dict(zip([c.split()[0] for c in ROW.split(", ")], row(i, f"r{i}", f, p, s))) for i, (f, p, s) in enumerate(itertools.product([0, 16], [10, 12], ["ACGTACGT", "ACGTACGA"]))]
    out = pairs.merge_bundle(rows, 3, None)
    pairs_used = sum(2 if r["status"] in ("merged", "discordant") else 1 for r in out)
    assert pairs_used == len(rows)


def test_realign_query_takes_every_pair(spark, monkeypatch):
    orders = [*range(1995, 2010), 7201, 7210, 140_000]  # most have keys that a cap on read_ord would drop
    monkeypatch.setattr(catalog.fixtures, "reads", lambda spark, d: spark.createDataFrame([(o, "ACGT") for o in orders], "read_ord long, umi string"))
    got = {}
    for r in catalog.pair_realign(spark, "").collect():
        got.setdefault(r.qname.removesuffix(":MERGED"), []).append(r)
    assert got.keys() == {f"p{o}" for o in orders}
    for o in orders:
        offset, start, rows = 5 + o % 25, o * 13 % 1400, got[f"p{o}"]
        if offset < 20 and o % 9 == 0:
            assert [r.status for r in rows] == ["discordant"]
        elif offset > 17:
            assert [r.status for r in rows] == ["unmerged"] * 2
        else:
            (r,) = rows
            assert r.status == "merged" and r.seq == catalog.REFERENCE[start : start + 20 + offset]
            assert score(r.seq, catalog.REFERENCE, r.pos, r.cigar) == best(r.seq, catalog.REFERENCE)


def test_long_references_give_what_short_ones_do():
    """Seeds and stretches against all placements at once."""
    rng = random.Random(11)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    whole, long = align.ReferenceIndex(ref), align.ReferenceIndex(ref, stretch=500)
    assert whole.blocks is None and long.blocks is not None
    for _ in range(25):
        at = rng.randrange(2900)
        q = list(ref[at : at + rng.randint(45, 90)])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(q))
            q[i : i + 1] = rng.choice([[], [rng.choice("ACGT")], [q[i], "A"]])
        q = "".join(q)
        assert long.align(q) == whole.align(q)
    short = "ACGTTGCA"  # no word of block length: stretch by stretch
    assert long.align(short + "N") == whole.align(short + "N") and long.align("") == (0, "")


def test_reads_without_a_barcode_pass(spark):
    df = spark.createDataFrame([row(0, "a", 0, 10, "ATCG", bx=None), row(1, "b", 16, 13, "GATC", bx=None), row(2, "c", 0, 10, "ATCG")], ROW)
    assert sorted((r.read_ord, r.status) for r in pairs.merge_pairs(df, None, 1).collect()) == [(0, None), (1, None), (2, None)]
