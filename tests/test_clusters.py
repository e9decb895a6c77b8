"""Clusters and votes against a plain greedy model written from the description of the method."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.operators import consensus
from strandfold.operators.bundles import ranked, umi_counts
from strandfold.operators.clusters import clusters, reach
from strandfold.operators.neighbors import edges, pairs, pairs_by_gap
from strandfold.schema import BUNDLE, with_bundle


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def ham(a, b):
    return sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else 99


def greedy(counts, method, k, p, rev):
    """{umi: the umi whose visit took it}, going through (umi, n) by rank, with a flag for those still free."""
    order, free, taken = [u for u, _ in counts], dict.fromkeys((u for u, _ in counts), True), {}
    n = dict(counts)
    k = min(1, k) if method == "acyclic" else k
    most = {u: int(np.float32(p) * np.float32(c + 1)) for u, c in counts}

    def absorbs(u, v):
        return (ham(u, v) <= k and n[v] <= most[u]) or (rev and (v == rc(u) or (ham(rc(u), v) <= k and n[v] <= most[u])))

    for u in order:
        if method == "raw":
            taken[u] = u
        elif method == "acyclic":
            for v in order:
                if free[v] and (v == u or absorbs(u, v)):
                    free[v], taken[v] = False, u
        elif free[u]:
            todo, free[u], taken[u] = [u], False, u
            while todo:
                w = todo.pop()
                for v in order:
                    if free[v] and absorbs(w, v):
                        free[v], taken[v] = False, u
                        todo.append(v)
    return taken


def sample(seed, n=250, letters="ACGT", length=5):
    rng = random.Random(seed)
    centers = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(6)]
    rows = []
    for i in range(n):
        u = list(rng.choice(centers))
        if rng.random() < 0.4:
            u[rng.randrange(length)] = rng.choice(letters)
        u = "".join(u)
        if rng.random() < 0.1:
            u = rc(u.replace("N", "A"))
        rows.append((i, rng.randrange(3), rng.random() < 0.5, u, rng.choice(["AAAA", "AAAC", "AATT"]), rng.randrange(40)))
    return rows


def frame(spark, rows):
    return with_bundle(spark.createDataFrame(rows, "read_ord long, grp_pos long, reverse boolean, umi string, seq string, qual_sum long"))


@pytest.mark.parametrize("method", ["raw", "acyclic", "directional"])
@pytest.mark.parametrize("seed,k,p,rev,letters", [(1, 1, 0.5, False, "ACGT"), (2, 2, 0.1, True, "ACGT"), (3, 1, 1.0, False, "ACGTN"), (4, 0, 0.5, False, "AC")])
def test_labels_and_votes(spark, method, seed, k, p, rev, letters):
    if rev and "N" in letters:
        pytest.skip()
    rows = sample(seed, letters=letters)
    df = frame(spark, rows)
    got = {}
    labels = clusters(ranked(umi_counts(df)), method, k, p, rev).cache()
    for r in labels.collect():
        got.setdefault((r.grp_pos, r.reverse), {})[r.umi] = r
    winners = {(r.grp_pos, r.reverse, r.label_rank): r for r in consensus.winners(df, labels, 3).collect()}
    passing = 0
    for key in {(r[1], r[2]) for r in rows}:
        own = [r for r in rows if (r[1], r[2]) == key]
        first, n = {}, {}
        for r in own:
            first.setdefault(r[3], r[0])
            n[r[3]] = n.get(r[3], 0) + 1
        counts = sorted(n.items(), key=lambda x: (-x[1], first[x[0]]))
        rank = {u: i + 1 for i, (u, _) in enumerate(counts)}
        taken = greedy(counts, method, k, p, rev)
        assert {u: rank[t] for u, t in taken.items()} == {u: r.label_rank for u, r in got[key].items()}
        members = {}
        for u, t in taken.items():
            members.setdefault(t, []).append(u)
        for t, some in members.items():
            lead = min(some, key=rank.get)
            assert all(got[key][u].leader == lead for u in some)
            if sum(n[u] for u in some) < 3:
                assert (*key, rank[t]) not in winners
                continue
            passing += 1
            votes, best, seen = {}, {}, {}
            for r in own:
                if r[3] in some:
                    votes.setdefault(r[4], set() if r[3] != lead else set())
                    votes[r[4]].add(("read", r[0]) if r[3] == lead else ("umi", r[3]))
                    best[r[4]] = min(best.get(r[4], (0, 1e9)), (-r[5], r[0]))
                    seen[r[4]] = min(seen.get(r[4], (2, 0)), (0 if r[3] == lead else 1, r[0]))
            s = min(votes, key=lambda s: (-len(votes[s]), best[s][0], seen[s]))
            w = winners[(*key, rank[t])]
            assert (w.seq, w.votes, w.read_ord, w.n_reads, w.leader) == (s, len(votes[s]), best[s][1], sum(n[u] for u in some), lead)
    assert passing == len(winners)


def umis(spark, counts):
    rows = [(u, n, i) for i, (u, n) in enumerate(counts)]
    return ranked(with_bundle(spark.createDataFrame(rows, "umi string, n_reads long, first_ord long")))


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.label_rank, set()).add(r.umi)
    return sorted(map(sorted, out.values()))


def test_worked_example(spark):
    u = umis(spark, [("ATCG", 10), ("ATCC", 4), ("TTCC", 1), ("ATGA", 40)])
    assert groups(clusters(u, "directional")) == [["ATCC", "ATCG", "TTCC"], ["ATGA"]]
    assert groups(clusters(u, "acyclic")) == [["ATCC", "ATCG"], ["ATGA"], ["TTCC"]]
    assert len(groups(clusters(u, "raw"))) == 4


def test_reverse_complement_is_taken_at_any_count(spark):
    u = umis(spark, [("AACC", 10), ("GGTT", 10)])
    assert groups(clusters(u, "directional", rev=True)) == [["AACC", "GGTT"]]
    assert len(groups(clusters(u, "directional"))) == 2


def test_mixed_lengths_never_meet_and_singletons_do(spark):
    u = umis(spark, [("AAAA", 1), ("AAAT", 1), ("AAA", 1)])
    assert groups(clusters(u, "directional")) == [["AAA"], ["AAAA", "AAAT"]]


def test_big_bundles_by_rounds(spark):
    df = ranked(umi_counts(frame(spark, sample(9, 400))))
    found = edges(df, 1, 0.5)
    key = [*BUNDLE, "rank", "least"]
    small = sorted(map(tuple, reach(found).select(*key).collect()))
    large = sorted(map(tuple, reach(found, big_edges=3).select(*key).collect()))
    assert small and small == large


def test_bad_options(spark):
    u = umis(spark, [("A", 1)])
    for bad in ({"method": "x"}, {"percentage": 0.0}, {"percentage": 1.5}, {"max_edit": -1}):
        with pytest.raises(ValueError):
            clusters(u, **bad)


def test_dedup_outputs_and_report(spark):
    rows = sample(5, 300)
    df = frame(spark, rows)
    out, report = consensus.dedup(df)
    tagged, report_all = consensus.dedup(df, only_group=True)
    r, a = report.first(), report_all.first()
    assert out.count() == r.num_reads_output_file == r.num_passing_groups == a.num_passing_groups
    assert tagged.count() == a.num_reads_output_file <= r.num_reads_input_file == len(rows)
    assert tagged.groupBy("read_ord").count().where("count > 1").count() == 0
    assert tagged.select("ug").distinct().count() == tagged.select(*BUNDLE, "bx").distinct().count()
    one, _ = consensus.dedup(df, singletons=True, method="raw")
    assert one.count() == df.select(*BUNDLE, "umi").distinct().count()


def test_empty(spark):
    out, report = consensus.dedup(frame(spark, []))
    r = report.first()
    assert out.count() == 0 and r.num_total_groups == 0 and r.min_reads_group is None


def test_pairs_of_one_large_bundle(spark):
    rng = random.Random(2)
    umis = sorted({"".join(rng.choice("ACGTN") for _ in range(rng.choice([4, 5]))) for _ in range(400)})
    df = with_bundle(spark.createDataFrame([(u, i + 1, 1) for i, u in enumerate(umis)], "umi string, rank int, n_reads long"))
    want = sorted((i + 1, j + 1) for i, u in enumerate(umis) for j, v in enumerate(umis) if i < j and ham(u, v) == 1)
    for p in (pairs_by_gap(df), pairs(df, 1)):
        assert sorted((r.u_rank, r.v_rank) for r in p.collect()) == want


def test_long_paths_take_few_rounds(spark, monkeypatch):
    from strandfold.operators import clusters as c

    path = with_bundle(spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "u_rank int, v_rank int")).select(*BUNDLE, "u_rank", "v_rank")
    monkeypatch.setattr(c, "MOST_ROUNDS", 8)
    assert {(r.rank, r.least) for r in c.reach(path, 10).collect()} == {(i, 1) for i in range(1, 61)}
