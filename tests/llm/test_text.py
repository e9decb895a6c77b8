"""Encoding, token files and repeats against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandfold.llm import bpe, encoding, repeats, textnum, token_files
from tests.llm.common import DOCS, frame, rows

BYTE, WORD = bpe.tokenizer_file("byte_bpe_50k.json"), bpe.tokenizer_file("word_bpe_49k.json")


def weird(seed):
    rng = random.Random(seed)
    some = [" ", "\n", "\t", "a", "b", "The", "th", "'s", "'ll", "é", "日本", "😀", "!", "..", ",", ". ", ", ", "_", "1", "23", "<|endoftext|>", " ", " ", "\x1c", "é", "́", "Σ", "İ", "  ", " \n", "ǅ"]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 50))) for _ in range(600)]


@pytest.mark.parametrize("path,byte_level", [(BYTE, True), (WORD, False)])
def test_pieces_are_what_the_library_gives(path, byte_level):
    texts = weird(1) + [r[1] or "" for r in rows()]
    p = encoding.Pieces(path, byte_level, limit=500)  # small, so that it is emptied on the way
    want = [e.ids for e in encoding.load(path).encode_batch(texts, add_special_tokens=False)]
    for s in encoding.chunks(texts, 3000):
        assert [np.frombuffer(b, np.uint32).tolist() for b in p.encode(texts[s])] == want[s]


def test_word_table_is_what_the_library_gives():
    texts = weird(3) + [r[1] for r in rows(4)] + weird(3)
    t = encoding.WordTable(WORD, limit=300)
    want = [e.ids + [2] for e in encoding.load(WORD).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = []
    for part in textnum.slices(pa.array(texts, pa.string()), 3000):
        ids, offsets = t.encode(part, 2)
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == want


@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_tree_of_unsplit_text(leaf):
    t, rng = encoding.load(BYTE), random.Random(leaf)
    for text in ["a" * 500, "ab" * 200, "!?" * 300, "日本語" * 90, "😀" * 80, " " * 200, "1" * 300] + ["".join(rng.choice("abcdethéλ") for _ in range(rng.randint(1, 700))) for _ in range(60)]:
        assert encoding.tree_encode(t, text, leaf) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("longest,leaf,threads", [(30, 11, 1), (20, 1, 1), (64, 17, 3)])
def test_tree_of_whole_texts(monkeypatch, longest, leaf, threads):
    monkeypatch.setattr(encoding, "LONG_TEXT", longest)
    monkeypatch.setattr(encoding, "LEAF", leaf)
    monkeypatch.setattr(encoding, "WINDOW_PIECES", 1)
    p, t = encoding.Pieces(BYTE, True), encoding.load(BYTE)
    texts = [x for i in range(3) for x in weird(10 + i)] + [(r[1] or "")[:3000] for r in rows()] + ["a" * 300, " " * 200, "a  \n" * 60]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, np.uint32).tolist() for b in p.encode(texts, threads)]
    assert got == want
    long = [x for x in texts if len(x) > longest and "<|endoftext|>" not in x and "\x1c" not in x]
    assert len(long) > 50 and p.joins >= len(long) and p.windows > p.joins  # some windows had to grow


def test_long_texts_of_the_query_are_joined(spark):
    """The very function that the tasks run, on a text over the production threshold."""
    text = next(r[1] for r in rows() if len(r[1] or "") > encoding.LONG_TEXT)
    p = encoding.Pieces(BYTE, True)
    (ids,) = p.encode([text])
    assert p.joins >= len(text) // encoding.LEAF and np.frombuffer(ids, np.uint32).tolist() == encoding.load(BYTE).encode(text, add_special_tokens=False).ids


def test_bpe_queries(spark):
    some = rows()
    t = encoding.load(BYTE)
    got = {r.doc_id: r for r in bpe.digests(frame(spark, some).withColumn("ids", F.lit(1)), BYTE).collect()}
    toks = {r.doc_id: r for r in bpe.tokenised(frame(spark, some), BYTE).collect()}
    ids = bpe.encoded(frame(spark, some), BYTE)
    back = {r.doc_id: r.text for r in bpe.decoded(ids, BYTE).collect()}
    for k, text, *_ in some:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(want) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert toks[k].ids == want and toks[k].exact and back[k] == (text or "")
    assert bpe.digests(spark.createDataFrame([], DOCS), BYTE).count() == 0


def test_token_files(spark, tmp_path):
    some = [(*r, "clash") for r in rows(2, 60)]
    df = spark.createDataFrame(some, DOCS + ", ids string").repartition(3)
    token_files.write_tokens(df, str(tmp_path / "t"), WORD, part_bytes=2000)
    got = {r.doc_id: r for r in token_files.token_index(spark, str(tmp_path / "t")).collect()}
    t, start = encoding.load(WORD), 0
    for r in some:
        want = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    files = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert files.where("doc_id = 7").count() == 1
    assert "EqualTo(doc_id,7)" in files.where("doc_id = 7")._jdf.queryExecution().toString()
    token_files.write_tokens(df.limit(0), str(tmp_path / "e"), WORD)
    assert token_files.token_index(spark, str(tmp_path / "e")).count() == 0
    for at, f in enumerate(sorted((tmp_path / "t").glob("part-*.orc"), reverse=True)):  # names don't matter, nor does their order
        f.rename(tmp_path / "t" / f"part-{99_999 + at}-renamed.orc")
    assert {r.doc_id: (r.start, r.n_tokens) for r in token_files.token_index(spark, str(tmp_path / "t")).collect()} == {k: (r.start, r.n_tokens) for k, r in got.items()}
    same = spark.createDataFrame([(5, "w " * n) for n in (3, 50, 7, 200, 1)], "doc_id long, text string")
    token_files.write_tokens(same, str(tmp_path / "k"), WORD)
    ordered = sorted((r.start, r.n_tokens) for r in token_files.token_index(spark, str(tmp_path / "k")).collect())
    assert [a for a, _ in ordered] == [sum(n for _, n in ordered[:i]) for i in range(5)]
    twice = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c")], "doc_id long, text string")
    token_files.write_tokens(twice, str(tmp_path / "d"), WORD)
    assert sorted(r.start for r in token_files.token_index(spark, str(tmp_path / "d")).collect()) == [0, 2, 4, 6]


def test_orc_layout(spark, tmp_path, monkeypatch):
    """Several stripes a file, integer run lengths of version 2, a row index, and Bloom filters on the key alone."""
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 64 << 10)
    rng = random.Random(1)
    some = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))) for i in range(12_000)]
    token_files.write_tokens(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), str(tmp_path / "t"), WORD, part_bytes=1 << 30)
    (file,) = (tmp_path / "t").glob("part-*.orc")
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == token_files.ROW_STRIDE and reader.getNumberOfRows() == 12_000
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0)).toString()
    columns = reader.getSchema().getFieldNames()
    assert list(columns) == ["doc_id", "part", "at", "ids"] and footer.count("kind: DIRECT_V2") >= 4
    assert footer.count("kind: ROW_INDEX") >= 5 and footer.count("kind: BLOOM_FILTER_UTF8") == 1


@pytest.mark.parametrize("block", [7, 64, 2 << 20])
def test_words_and_windows(block, monkeypatch):
    monkeypatch.setattr(textnum, "_BLOCK", block)
    texts = weird(2) + [None, "", " "]
    h, starts, ends, first, raw = textnum.words(pa.array(texts))
    by_word = {}
    for i, t in enumerate(texts):
        want = (t or "").encode().split()
        assert [raw[starts[j] : ends[j]].tobytes() for j in range(first[i], first[i + 1])] == want
        for w, x in zip(want, h[first[i] : first[i + 1]].tolist()):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def cut(some, size):
    """Brute force: (n_words, n_removed, kept) by key and text."""
    split = [(k, (t or "").encode().split()) for k, t in some]
    seen = {}
    for _, w in split:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,block,chunk,bucket,groups", [(35, 18, 20_000, 9_000, 12), (8, 4, 2_000, 1_000, 2), (5, 3, 10**9, 10**9, 12)])
def test_repeats(spark, monkeypatch, size, block, chunk, bucket, groups):
    monkeypatch.setattr(repeats, "MANY_ROWS", 2)  # rows without a key are too many for it
    some = rows(3) + [(None, "x y z " * 20, "", "", 0)] + [(900, "a b " * 50, "", "", 0), (None, "p q r s t u v w x y " * 9, "", "", 0), (None, "q r s t u v w x y z " * 9, "", "", 0)]
    got = repeats.repeats(frame(spark, some).withColumn("kept", F.lit(1)).withColumn("chunk", F.lit(2)), size=size, block=block, chunk_bytes=chunk, bucket_bytes=bucket, group_bits=groups).collect()
    want = cut([(r[0], r[1]) for r in some], size)
    assert sorted(map(tuple, got), key=str) == want and sum(w[2] for w in want) > 100


def test_repeats_edges(spark):
    assert repeats.repeats(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.n_words for r in repeats.repeats(frame(spark, [(1, None, "", "", 0)])).collect()] == [0]
    with pytest.raises(ValueError):
        repeats.repeats(frame(spark, rows()), size=10, block=6)


def test_rows_sent_do_not_grow_with_chunks_times_buckets(spark):
    """Whatever the number of buckets, a chunk sends a row to a group at most, and a slab a row to a bucket of its group."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**50, 5000, dtype=np.uint64)  # 32 bits of the hash, 12 of its bucket, 6 of its group
    sent = repeats.send(3, 0, h, None, None, None, 44)
    assert sent.num_rows <= 64
    one = sent.take([i for i in range(sent.num_rows) if sent.column(0)[i].as_py() == 5])
    again, more, owner, twice, special = repeats._received(one)
    assert more is None and special is None and set(owner) == {0} and not twice.any()
    assert sorted(again.tolist()) == sorted(set((h[h >> np.uint64(44) == 5] & np.uint64((1 << 44) - 1)).tolist()))


def test_packing():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.sort(rng.integers(0, 2**40, 1000, dtype=np.uint64)), np.array([0, 2**39], np.uint64), np.array([1, 2, 2**63], np.uint64), np.sort(rng.integers(0, 2**50, 99, dtype=np.uint64))):
        assert (repeats.unpack(repeats.pack(x)) == x).all()
