"""Near duplicates, leaks, quality, fingerprints, shards, archives and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandfold.llm import bpe, decontam, encoding, graph, imatch, quality, registry, setsketch, sharding, warc
from strandfold.llm.shared import shared_dir
from tests.llm.common import DOCS, frame, rows, words
from tests.llm.test_lines import expected

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def groups(some, size, percent):
    """{key: (n, component)} by comparing all pairs."""
    s = {k: shingles(t, size) for k, t in some if k is not None}
    root = {k: k for k in s}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s[k]), find(k)) for k in keys}


def chains(seed, n=60):
    """Copies of copies, each a few words off the last, so that groups hang together by links only."""
    rng = random.Random(seed)
    out, w = [], words(rng, 90, 5000)
    for i in range(n):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        if i % 12 == 0:
            w = words(rng, 90, 5000)
        out.append((i, " ".join(w if rng.random() < 0.9 else [x.upper() for x in w]), "", "", 0))
    return out


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates(spark, seed, size, percent):
    some = chains(seed) + [(100 + i, *r[1:]) for i, r in enumerate(rows(seed))]
    want = groups([(r[0], r[1]) for r in some], size, percent)
    got = {r.doc_id: r for r in setsketch.near_duplicates(frame(spark, some + [(None, "a b c", "", "", 0)]).withColumn("component_id", F.lit(5)), size, percent).collect()}
    assert got.pop(None).kept
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert sum(c != k for k, (_, c) in want.items()) > 20
    assert setsketch.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_bands_are_parted(spark, monkeypatch):
    """Many different texts around one long passage: bands that many share, and near copies to be found among them."""
    monkeypatch.setattr(setsketch, "HOT_BAND", 4)
    monkeypatch.setattr(setsketch, "BLOCK", 3)
    rng = random.Random(12)
    passage, some = words(rng, 200, 5000), []
    for k in range(60):
        w = passage + words(rng, 120, 50_000)
        some += [(k * 2, " ".join(w), "", "", 0)]
        if k % 4 == 0:
            some += [(k * 2 + 1, " ".join([*w[:-2], "an", "end"]), "", "", 0)]
    want = groups([(r[0], r[1]) for r in some], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(frame(spark, some), 3, 85).collect()}
    assert got == want and sum(c != k for k, (_, c) in want.items()) == 15


def test_a_text_is_sent_once_to_the_group_of_its_partners(spark, monkeypatch):
    """A hundred texts of which each is compared with each: one group has them all, not one for each of them."""
    sent = []
    stored = setsketch.stored
    monkeypatch.setattr(setsketch, "stored", lambda df, name: sent.append((name, stored(df, name))) or sent[-1][1])
    rng = random.Random(15)
    core, some = words(rng, 300, 50_000), []
    for k in range(100):
        w = [x if rng.random() > 0.025 + 0.0001 * k else f"o{rng.randrange(10**6)}" for x in core]
        some.append((k, " ".join(w), "", "", 0))
    want = groups([(r[0], r[1]) for r in some], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(frame(spark, some), 3, 85).collect()}
    assert got == want
    pairs = [df for name, df in sent if name == "pairs"][1]
    ends = pairs.select("p", "q", "a").union(pairs.select("p", "q", "b")).distinct()
    assert pairs.count() > 500 and 3 * ends.count() < pairs.count()


def test_likelihood_at_two_points():
    rng = np.random.default_rng(5)
    up, down = rng.integers(0, 50, 3000), rng.integers(0, 50, 3000)
    na, nb = rng.integers(1, 500, 3000), rng.integers(1, 500, 3000)
    for least in (0.65, 0.7):
        assert (setsketch.reaches(up, down, na, nb, least) == (setsketch.estimate(up, down, na, nb) >= least)).all()
    near = rng.integers(0, 20, 3000), rng.integers(0, 20, 3000), rng.integers(90, 110, 3000), rng.integers(90, 110, 3000)
    assert (setsketch.reaches(*near, 0.7) == (setsketch.estimate(*near) >= 0.7)).all() and 300 < setsketch.reaches(*near, 0.7).sum() < 2900


def test_estimates_and_merging():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    rx, ry = setsketch.registers(x), setsketch.registers(y)
    (j,) = setsketch.estimate([(rx > ry).sum()], [(rx < ry).sum()], [900], [900])
    assert abs(j - 0.8) < 0.15
    assert (np.maximum(rx, ry) == setsketch.registers(np.concatenate([x, y]))).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


def plain(text):
    import re

    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if w]


def leaking(docs, items, window=13, tolerance=0.2):
    out = set()
    for k, text in docs:
        d = plain(text)
        for i, t in items:
            t = plain(t)
            w = min(window, len(t))
            if w >= decontam.SHORTEST and any(sum(x != y for x, y in zip(d[a : a + w], t[b : b + w])) <= int(tolerance * w + 1e-9) for a in range(len(d) - w + 1) for b in range(len(t) - w + 1)):
                out.add((k, i))
    return out


def benchmark_case(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 3000))) for i, n in enumerate([40, 20, 13, 12, 7, 5, 4, 1])] + [(90, None), (91, "")]
    docs = []
    for k in range(60):
        w = words(rng, rng.randint(0, 50), 3000)
        if k % 2:
            t = rng.choice(items[:8])[1].split(" ")
            a = rng.randrange(1 + len(t) // 3)
            some = [x if rng.random() > 0.06 else "other" for x in t[a : a + rng.randint(1, 30)]]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "!" for x in some]
        docs.append((k, " ".join(w), "", "", 0))
    return docs + [(100, None, "", "", 0), (101, "", "", "", 0), (102, items[0][1], "", "", 0), (102, items[0][1], "", "", 0)], items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"seed_rows": 150, "most_blocks": 100}), (3, {"seed_rows": 10})])
def test_leaks(spark, seed, options):
    docs, items = benchmark_case(seed)
    docs.append((103, " ".join(words(random.Random(1), 20_000, 3000)) + " " + items[0][1], "", "", 0))
    items.append((0, items[0][1]))  # a repeated item
    want = leaking([(d[0], d[1]) for d in docs], items)
    df = frame(spark, docs).withColumn("item_id", F.lit("clash"))
    got = [(r.doc_id, r.item_id) for r in decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 6 and (103, 0) in want
    assert decontam.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_masks_miss_nothing():
    for span, errors in ((10, 2), (9, 1), (5, 1), (4, 0)):
        from itertools import combinations

        for wrong in combinations(range(span), errors):
            assert any(not set(m) & set(wrong) for m in decontam.masks(span, errors))


def judged(seed=1, n=120):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = words(rng, rng.randint(5, 80))
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join([w[0]] * len(w)), " ".join(x + "%%%" for x in w)])
        docs.append((i, text, "", "", 0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality(spark):
    docs, labels = judged()
    lab = spark.createDataFrame(labels + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    odd = [(500, None, "", "", 0), (501, "", "", "", 0), (None, "w1 w2", "", "", 0), (502, "x" * 100000, "", "", 0)]
    got = {r.doc_id: r for r in quality.scored(frame(spark, docs + odd).withColumn("score", F.lit("clash")), lab).collect()}
    assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k, *_ in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k, *_ in docs)
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.9
    # the same model, from all rows at once
    x = quality.features(pa.array([d[1] for d in docs]))
    y, learn = np.array([q for _, q, _ in labels]), np.array([k not in held for k, *_ in docs])
    parts = [x[learn & (y == c)] for c in (0, 1)]
    model = quality.fit(np.array([len(p) for p in parts], float), np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts]))
    assert np.allclose(model.score(x), [got[k].score for k, *_ in docs], atol=1e-6)
    none = quality.scored(frame(spark, docs), lab.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.scored(spark.createDataFrame([], DOCS), lab).count() == 0


def test_gaussian_scores_are_log_densities():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (300, 3))
    m = quality.fit(np.array([500.0, 300.0]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]), 0.0, 0.0)
    x = rng.normal(0, 2, (20, 3))
    ll = []
    for z in (a, b):
        c = np.cov(z.T, bias=True)
        d = x - z.mean(0)
        ll.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]) + np.log(len(z)))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(ll[0] - ll[1])))


def test_fingerprints(spark):
    rng = random.Random(5)
    some = [(i * 3, " ".join(words(rng, rng.randint(0, 200), 3000)), "", "", 0) for i in range(150)]
    some += [(1000, None, "", "", 0), (1001, "", "", "", 0), (1002, some[7][1], "", "", 0), (1003, some[7][1], "", "", 0), (1004, "日本 é", "", "", 0)]
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, some).withColumn("fingerprint", F.lit("clash")).repartition(5)).collect()}
    assert len(got) == len(some)
    for i, (k, text, *_) in enumerate(some):
        text, after = text or "", some[(i + 1) % len(some)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (edited != text) or (r.fingerprint == r.edited_fingerprint and r.near_edited == 1)
    assert got[1002].fingerprint == got[1003].fingerprint == got[21].fingerprint and got[1002].near_next == 1
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for k, r in got.items() if k < 500])
    assert imatch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = imatch.fingerprints(frame(spark, [(1, "a b", "", "", 0)])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"a a").hexdigest()


def test_fingerprints_tell_all_terms_of_the_band_apart(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 20)
    rng = random.Random(8)
    some = [" ".join(words(rng, rng.randint(0, 60), 4000)) for _ in range(150)]
    some += ["d'été " * 3, "été d", "", None, "solitary", "w1", some[4], some[4]]
    for k in range(6):  # pairs of long texts with 300 terms of the band in common, and one that only the first has
        both = " ".join(f"long{k}x{i}" for i in range(300))
        some += [f"{both} lone{k}", both, f"lone{k}"]
    docs = [(None if i == 9 else i, t, "", "", 0) for i, t in enumerate(some)]
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, docs).repartition(3)).collect()}
    split = lambda t: {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w}
    df = collections.Counter(w for t in some for w in split(t))
    most = max(imatch.MIN_DOCS, int(imatch.MOST_SHARE * len(some)))
    texts = sorted(docs, key=lambda d: -1 if d[0] is None else d[0])
    known, n_band, n_seam = {}, 0, 0
    for i, (k, text, *_) in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        for t, print_ in ((text, got[k].fingerprint), (edited, got[k].edited_fingerprint)):
            band = frozenset(w for w in split(t) if imatch.MIN_DOCS <= df[w] <= most)
            n_band += len(band)
            known.setdefault(band or ("none", frozenset(split(t))), set()).add(print_)
        n_seam += any(imatch.MIN_DOCS <= df[w] <= most for w in split(edited) - split(text) - split(after))
        bands = [{w for w in split(t) if imatch.MIN_DOCS <= df[w] <= most} for t in (text, edited)]
        assert not any(bands) or (got[k].near_edited == 1) == (bands[0] == bands[1])
    assert n_band > 1000 and n_seam > 0 and all(len(p) == 1 for p in known.values())
    assert len(set.union(*known.values())) == len(known)


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    some = [(i * 7 % 1009, f"t{i}", "", "", 0) for i in range(300)]
    ids = sorted(r[0] for r in some)
    got = {r.id: (r.next_id, r.next_text) for r in imatch.with_next(frame(spark, some).select(F.col("doc_id").alias("id"), "text")).collect()}
    text = {r[0]: r[1] for r in some}
    assert got == {a: (b, text[b]) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_shards(spark):
    some = rows(6, 300) + [(None, "x", "", "", 0)] * 3 + [(77777, "same", "", "", 0)] * 50
    df = frame(spark, some).withColumn("slot", F.lit("clash"))
    out = sharding.shuffled(df, 16, bucket_rows=20).collect()
    again = sharding.shuffled(df.repartition(7), 16, bucket_rows=20).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.text), r.shard, r.slot)
    assert [(r.doc_id, r.text) for r in sorted(out, key=key)] == [(r[0], r[1]) for r in sorted(some, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))]
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    place = lambda rs: {r.doc_id: (r.shard, r.slot) for r in rs if r.doc_id not in (None, 77777)}
    unique = [r for r in some if r[0] not in (None, 77777)]
    a, b = (sharding.shuffled(frame(spark, unique).repartition(n), 16, bucket_rows=20).collect() for n in (2, 5))
    assert place(a) == place(b) and len(again) == len(some)
    assert len({r.shard for r in out if r.doc_id == 77777}) > 8
    assert sharding.shuffled(df.limit(0)).count() == 0


def test_fisher_yates_is_uniform(spark):
    d = spark.range(6000).select(sharding.fisher_yates(F.lit(4), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(d) == 24 and all(180 < r["count"] < 330 for r in d) and all(sorted(r.p) == [0, 1, 2, 3] for r in d)


def test_shard_files(spark, tmp_path):
    df = frame(spark, rows(1)).withColumn("shard", F.lit("clash"))
    sharding.write_shards(df, str(tmp_path / "s"), 4, bucket_rows=10)
    back = sharding.read_shards(spark, str(tmp_path / "s"), df).collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in back) == sorted((k, t or "", t is None) for k, t, *_ in rows(1))
    assert sorted((r.shard, r.slot) for r in back) == sorted((g % 4, g // 4) for g in range(len(back)))
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), 4)
    assert sharding.read_shards(spark, str(tmp_path / "none"), df).count() == 0


def test_shard_order_is_drawn_where_the_bucket_is(spark):
    plan = sharding.shuffled(frame(spark, rows(1)), 4, bucket_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    drawn = plan[plan.index("aggregate(sequence") :]
    # below the drawing comes the window that numbers the rows, and only then the other side of the join, with the counts
    assert drawn.index("row_number()") < drawn.index("Aggregate [__bucket")


def pages(n=80):
    rng = random.Random(7)
    some = [(i, f"http://x/{i}", "<p>" + " ".join(words(rng, rng.randint(0, 60))) + "é</p>") for i in range(n)]
    return some + [(1000, None, "a"), (1001, "u", None), (None, "u", "b"), (1002, "line\r\nbreak", ""), (1003, "u", "y" * 200_000)]


def test_warc_and_audit(spark):
    some = pages()
    df = spark.createDataFrame(some, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    place = f"{shared_dir(spark)}/warc-test-{random.random()}"
    manifest = warc.write(df, f"{place}/a", file_bytes=4000)
    bodies = {r.id: r for r in warc.bodies(manifest, f"{place}/a").collect()}
    assert {k: r.body_sha256 for k, r in bodies.items()} == {k: hashlib.sha256((h or "").encode()).hexdigest() for k, _, h in some}
    warc.replicate(manifest, f"{place}/a", f"{place}/same")
    warc.replicate(manifest, f"{place}/a", f"{place}/bad", [29, 3])
    a, same, bad = (warc.tree(manifest, f"{place}/{x}", 4) for x in ("a", "same", "bad"))
    files = manifest.select("file").distinct().count()
    wrong, compared = warc.differing(a, same, 4)
    assert wrong.count() == 0 and compared[0] == 1 and sum(compared[1:]) == 0 and files > 4
    wrong, compared = warc.differing(a, bad, 4)
    ids = {r.id for r in wrong.join(manifest, ["file", "number"]).collect()}
    assert ids == {k for k, *_ in some if k is not None and k % 29 == 3} and compared[-1] < len(some)
    nothing = warc.tree(manifest.limit(0), f"{place}/nowhere")
    assert warc.differing(nothing, nothing)[0].count() == 0
    missing, _ = warc.differing(a, warc.tree(manifest, f"{place}/nowhere", 4), 4)
    assert missing.count() == len(some) + files  # all records and tails
    assert {r.body_bytes for r in warc.bodies(manifest, f"{place}/nowhere").collect()} == {None}


def test_audit_sees_lengths_and_files(spark):
    df = spark.createDataFrame(pages() + [(7, "http://x/7", "<p>again</p>")] * 2, "page_id long, url string, html string")
    place = f"{shared_dir(spark)}/warc-test-{random.random()}"
    manifest = warc.write(df, f"{place}/a", file_bytes=4000)
    assert manifest.count() == len(pages()) + 2
    warc.replicate(manifest, f"{place}/a", f"{place}/b")
    a, here = warc.tree(manifest, f"{place}/a", 4), place.removeprefix("file://") + "/b"
    one, two, three = sorted(r.file for r in manifest.select("file").distinct().collect())[:3]
    tail = {r.file: r.n for r in manifest.groupBy("file").agg(F.count("*").alias("n")).collect()}

    def damage():
        return {(r.file, r.number) for r in warc.differing(a, warc.tree(manifest, f"{place}/b", 4), 4)[0].collect()}

    assert damage() == set()
    with open(f"{here}/{one}", "ab") as f:
        f.write(b"x" * 700)
    assert damage() == {(one, tail[one])}
    with open(f"{here}/{two}", "r+b") as f:
        f.truncate(manifest.where(F.col("file") == two).agg(F.sum("length")).first()[0] - 3)
    assert damage() == {(one, tail[one]), (two, tail[two]), (two, tail[two] - 1)}
    with open(f"{here}/unknown.warc.gz", "wb") as f:
        f.write(b"y")
    assert damage() == {(one, tail[one]), (two, tail[two]), (two, tail[two] - 1), ("unknown.warc.gz", 0)}
    import os

    os.remove(f"{here}/{three}")
    assert damage() >= {("unknown.warc.gz", 0), *((three, i) for i in range(tail[three] + 1))}
    none = warc.write(df.limit(0), f"{place}/none")
    assert none.count() == 0 and warc.bodies(none, f"{place}/none").count() == 0


def test_warc_records():
    raw = warc.record(1, "u\r\nv", b"body\r\n\r\nmore")
    assert warc.block(raw) == b"body\r\n\r\nmore"
    with pytest.raises(ValueError):
        warc.block(raw[:-20])


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = judged(9, 150)
    rng = random.Random(9)
    item = " ".join(words(rng, 30, 9000))
    docs = [(k, t if k % 13 else t + "\n" + item, "en", "s", len(t)) for k, t, *_ in docs]
    docs += [(200 + i, docs[i * 2 + 1][1] + " tail", "en", "s", 0) for i in range(20)] + [(300, "A shared line of some length.\n" + docs[5][1], "", "", 0), (301, "A shared line of some lengthy.\n" + docs[6][1], "", "", 0)]
    docs += [(400, None, None, None, None), (401, "", "", "", 0), (402, "   ", "", "", 3)]
    without_id = [(None, "a clean text without an id and with words", "en", "s", 0), (None, item + " leaks without an id", "en", "s", 0)]
    frame(spark, docs + without_id).withColumn("__key", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = encoding.load(bpe.tokenizer_file("byte_bpe_50k.json"))
    assert [r.ids for r in got if r.doc_id is None] in ([], [t.encode(without_id[0][1], add_special_tokens=False).ids])
    got = {r.doc_id: r for r in got if r.doc_id is not None}
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in docs]
    x = quality.features(pa.array([d[1] for d in docs], pa.string()))
    y = np.array([dict((k, q) for k, q, _ in labels).get(d[0], -1) for d in docs])
    parts = [x[(y == c) & ~np.array(held)] for c in (0, 1)]
    model = quality.fit(np.array([len(p) for p in parts], float), np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts]))
    left = [(d[0], d[1]) for d, s in zip(docs, model.score(x)) if s >= 0.3]
    gone = expected(left)
    left = [(k, t if t is None else "\n".join(v for i, v in enumerate(t.split("\n")) if i not in gone[k])) for k, t in left]
    comp = groups(left, 5, 80)
    left = [(k, t) for k, t in left if comp[k][1] == k]
    bad = {k for k, _ in leaking(left, [(0, item)])}
    left = [(k, t) for k, t in left if k not in bad]
    assert {k: r.ids for k, r in got.items()} == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in left}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got.values())
    assert bad and any(gone.values()) and len(left) < len(docs) - 30


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(k.split("_")[0] for k in registry.QUERIES) == sorted(f"op{n}" for n in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and set(registry.SQL) <= set(registry.QUERIES)
