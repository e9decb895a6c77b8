"""Every opN_ query over a small folder of tables, against models written from the contracts alone."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandfold.llm import bpe, encoding, imatch, quality, registry, sharding, warc
from tests.llm.common import DOCS, rows, words
from tests.llm.test_corpus import groups, leaking
from tests.llm.test_lines import expected
from tests.llm.test_text import cut


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    docs = [(k * 3, *rest) for k, *rest in rows(21, 60)]
    item = " ".join(words(rng, 40, 5000))
    docs += [(1000, "so " + item + " end", "", "", 0), (1001, "A line of some length, number one.\nA line of some length, number ona.", "", "", 0), (1002, "A line of some length, number one!", "", "", 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(place / "documents.parquet"))
    labels = [(d[0], int(i % 3 > 0), 0) for i, d in enumerate(docs) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    spark.createDataFrame([(7, item), (8, " ".join(words(rng, 20, 5000)))], "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    pages = [(i, f"http://x/{i}", "<p>" + " ".join(words(rng, 20)) + "</p>") for i in range(120)] + [(500, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(place / "pages.parquet"))
    return str(place), docs, labels, item, pages


_DONE = {}


def run(spark, tables, name):
    """The rows of a query, which is run once."""
    if (tables[0], name) not in _DONE:
        _DONE[tables[0], name] = registry.QUERIES[name](spark, tables[0]).collect()
    return _DONE[tables[0], name]


def test_op1(spark, tables):
    got = run(spark, tables, "op1_spaced_seeds")
    assert {(r.doc_id, r.item_id) for r in got} == leaking([(d[0], d[1]) for d in tables[1]], [(7, tables[3])]) == {(1000, 7)}
    assert [(r.windows, r.first_word, r.last_word) for r in got] == [(28, 1, 40)]


def test_op2(spark, tables):
    docs = [(d[0], d[1]) for d in tables[1]]
    gone = expected(docs)
    for r in run(spark, tables, "op2_segment_lines"):
        text = dict(docs)[r.doc_id] or ""
        kept = "\n".join(v for i, v in enumerate(text.split("\n")) if i not in gone[r.doc_id])
        assert sorted(gone[r.doc_id]) == r.removed and r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert gone[1002] and gone[1001]


def features(text):
    """The statistics of one text, word by word."""
    b = (text or "").encode()
    w = b.split()
    if not w:
        return [0.0] * len(quality.NAMES)
    full = sum(c not in b" \t\n\r\x0b\x0c" for c in b)
    n = lambda some: sum(c in some for c in b)
    root = lambda x, y: math.sqrt(x / y) if y else 0.0
    upper, lower = n(range(65, 91)), n(range(97, 123))
    signs = b"#$%&*+/<=>@[]\\^_`{}~"
    entropy = lambda counts: -sum(x / sum(counts) * math.log2(x / sum(counts)) for x in counts)
    times, k = collections.Counter(w), len(w)
    lengths = [len(x) for x in w]
    mean = sum(lengths) / k
    lines = b.split(b"\n")
    return [
        math.log1p(k), math.log(mean), root(upper, upper + lower), root(n(range(48, 58)), full), root(n(b".,;:'\"()-?"), full), root(n(signs), full), root(n(b"|"), full), root(n(b"!"), full), root(n(range(128, 256)), full), math.log1p(n(b"\n")) - math.log1p(k),
        len(times) / k**0.8, root(sum(x == y for x, y in zip(w, w[1:])), k), len(set(zip(w, w[1:]))) / max(1, k - 1), len(set(lines)) / len(lines), root(sum(x[-1] in signs + b"|!" for x in w), k), root(sum(65 <= x[0] <= 90 for x in w), k),
        entropy(collections.Counter(b).values()), entropy(times.values()) / math.log2(k + 1), root(max(times.values()), k), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in lengths) / k)),
    ]


def test_op3(spark, tables):
    _, docs, labels, *_ = tables
    odd = ["one line\n" * 50, "a\n\n\nb", "same\nsame\nother", "x" * 70_000 + "\n" + "y z " * 40_000, "\n", ""]
    texts = [d[1] for d in docs] + odd
    x = np.array([features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts, pa.string())), x, atol=1e-9)
    held = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0}
    at = {d[0]: i for i, d in enumerate(docs)}
    parts = [x[[at[k] for k, y, _ in labels if y == c and k not in held]] for c in (0, 1)]
    model = quality.fit(np.array([len(p) for p in parts], float), np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts]))
    got = {r.doc_id: r for r in run(spark, tables, "op3_shrunk_qda")}
    assert np.allclose([got[d[0]].score for d in docs], model.score(x[: len(docs)]), atol=1e-6)
    assert all(r.held_out == (k in held) and r.predicted == int(r.score >= 0.3) for k, r in got.items()) and len(got) == len(docs)


def test_op4(spark, tables):
    want = groups([(d[0], d[1]) for d in tables[1]], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, tables, "op4_setsketch")}
    assert got == want and any(c != k for k, (_, c) in want.items())


def x64(seed, *values):
    """Spark's xxhash64 from a seed on: an int takes 4 bytes, a long 8, a text its own; an array its elements; null nothing."""
    for v in values:
        raw = b"" if v is None else v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = seed if v is None else xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def spark_hash(*values):
    out = 42
    for v in values:
        out = x64(out % 2**64, v)
    return out


def fingerprint(own, every):
    """Of the terms in the band, and of all terms if there are none."""
    low32 = lambda v: v & 0xFFFFFFFF
    if not own:
        return (-1, [low32(spark_hash(*sorted(every)))], [], [])
    level = math.floor(math.log(max(len(own) / 16, 1)) / math.log(4))
    halves = lambda m: m & (m >> 32) & 0xFFFFFFFF

    def members(t, draws):
        m = 2**64 - 1
        for i in range(1, draws + 1):
            m &= spark_hash(t, (i,)) % 2**64
        return halves(m)

    def subset(draws):
        some = [(t, members(t, draws)) for t in sorted(own)]
        return [low32(spark_hash(*mine)) if (mine := [t for t, m in some if m >> k & 1]) else None for k in range(32)]

    whole = 0
    for t in own:
        whole ^= spark_hash(t, (102,)) % 2**64
    return (level, subset(level + 2), subset(level + 3), [low32(spark_hash(whole - 2**64 if whole >= 2**63 else whole))])


def likeness(x, y):
    if x[0] == y[0]:
        pairs = list(zip(x[1] + x[2] + x[3], y[1] + y[2] + y[3]))
    elif x[0] == y[0] - 1:
        pairs = list(zip(x[2] + x[3], y[1] + y[3]))
    elif x[0] == y[0] + 1:
        pairs = list(zip(x[1] + x[3], y[2] + y[3]))
    else:
        pairs = []
    if x[0] != y[0] and -1 in (x[0], y[0]):  # lists of different kinds
        return None
    some = sum(p is not None or q is not None for p, q in pairs)
    return sum(p is not None and p == q for p, q in pairs) / some if some else float(x == y)


def test_op5(spark, tables):
    docs = sorted((d[0], d[1] or "") for d in tables[1])
    terms = lambda t: {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.A) if w}
    df = collections.Counter(w for _, t in docs for w in terms(t))
    most = max(imatch.MIN_DOCS, int(imatch.MOST_SHARE * len(docs)))

    def made(t):
        return fingerprint({spark_hash(w) for w in terms(t) if imatch.MIN_DOCS <= df[w] <= most}, {spark_hash(w) for w in terms(t)})

    shown = lambda f: ":".join([str(f[0]), *("".join("-" if h is None else f"{h:08X}" for h in part) for part in f[1:])])
    got = {r.doc_id: r for r in run(spark, tables, "op5_imatch")}
    assert len(got) == len(docs)
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following, r = made(t), made(edited), made(after), got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == shown(own) and r.edited_fingerprint == shown(changed)
        for value, other in ((r.near_edited, changed), (r.near_next, following)):
            want = likeness(own, other)
            assert want is None or math.isclose(value, want)


def test_fingerprints_of_cut_words(spark, monkeypatch):
    """Edited texts whose words at the seam and at the end change with the letters around; a table of common terms with full cells."""
    monkeypatch.setattr(imatch, "MOST_SHARE", 0.5)
    monkeypatch.setattr(imatch, "CELLS", 4)
    rng = random.Random(3)
    parts = ["ΟΔΟΣ", "Σ", "ΑΣ", "'", ".", " ", " ", "\n", "a", "Bc", "İ", "é", "日本", "\U0001f600"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(120)]
    terms = lambda t: {w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower(), flags=re.A) if w}
    df = collections.Counter(w for _, t in docs for w in terms(t))
    assert sum(n > 60 for n in df.values()) == 0 < sum(n > 12 for n in df.values())
    shown = lambda f: ":".join([str(f[0]), *("".join("-" if h is None else f"{h:08X}" for h in part) for part in f[1:])])
    for share in (0.5, 0.1):
        monkeypatch.setattr(imatch, "MOST_SHARE", share)
        made = lambda t: shown(fingerprint({spark_hash(w) for w in terms(t) if 2 <= df[w] <= 120 * share}, {spark_hash(w) for w in terms(t)}))  # noqa: E731, B023
        got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        for k, t in docs:
            half = len(t) // 2
            edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
            assert (got[k].fingerprint, got[k].edited_fingerprint) == (made(t), made(edited)), (t, edited)


def test_op5_makes_terms_once_a_text(spark, tables, monkeypatch):
    """A text isn't hashed again for each of its terms, and the next text isn't taken apart as a whole."""
    plans, keep = {}, imatch.stored

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(imatch, "stored", spied)
    registry.QUERIES["op5_imatch"](spark, tables[0])
    counting, texts = plans["imatch-terms"], plans["imatch-texts"]
    assert counting.count("split(") == 1 and "xxhash64(" not in counting[: counting.index("Generate")]
    assert texts.count("split(") == 3  # the text, the edited one, and the words at its edges
    assert "split(lower(next_text" not in texts


def test_op6(spark, tables):
    t = encoding.load(bpe.tokenizer_file("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in run(spark, tables, "op6_tree_bpe")}
    for k, text, *_ in tables[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op7(spark, tables):
    got = {r.page_id: r for r in run(spark, tables, "op7_merkle_fixity")}
    for k, _, html in tables[4]:
        assert (got[k].body_bytes, got[k].body_sha256, got[k].decayed) == (len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest(), k % warc.DECAY[0] == warc.DECAY[1])


def test_op8(spark, tables):
    """One bucket: the rows by key, permuted by the drawn swaps, dealt to the shards."""
    docs = sorted((d[0], d[1]) for d in tables[1])
    assert len(docs) < sharding.BUCKET_ROWS
    order = []
    for i in range(len(docs)):
        j = spark_hash((sharding.SEED + 1,), (0,), (i,)) % (i + 1)
        order.append(i)
        order[i], order[j] = order[j], i
    got = {r.doc_id: r for r in run(spark, tables, "op8_external_shuffle")}
    for row, (k, t) in enumerate(docs):
        raw, g = (t or "").encode(), order[row]
        assert (got[k].size, got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        assert (got[k].shard, got[k].slot) == (g % 16, g // 16)


def test_op9(spark, tables):
    t, start = encoding.load(bpe.tokenizer_file("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in run(spark, tables, "op9_orc_tokens")}
    for k, text, *_ in sorted(tables[1], key=lambda d: d[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10(spark, tables):
    want = {k: (n, r, hashlib.sha256(kept.encode()).hexdigest()) for k, n, r, kept in cut([(d[0], d[1]) for d in tables[1]], 35)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, tables, "op10_fixed_blocks")}
    assert got == want and sum(r for _, r, _ in want.values()) > 100


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same_rows(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.sql(registry.SQL[name])
    columns = sorted(want.columns)
    rows_ = [dict(zip(want.columns, r)) for r in want.fetchall()]
    got = run(spark, tables, name)
    assert sorted(got[0].asDict()) == columns
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str([r[c] for c in columns]) for r in rows_)
