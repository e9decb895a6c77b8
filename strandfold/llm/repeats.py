"""Removal of long passages that occur more than once, found through fixed-block anchors.

A window is `size` consecutive words of one document. Wherever two windows are equal, the
first holds, at one and the same offset, a whole block of `block` words that starts at a
multiple of `block` in its document (size >= 2 * block - 1), and the second holds the same
words there. So:

1. the reference blocks (every block-th position of every document) are the index; every
   rolling block-sized window of every document probes it;
2. a probed hash that is a reference block and occurs at least twice is an anchor; windows
   around anchors are the candidates that hits are extended over;
3. candidates are compared as whole windows (64 bits of one hash of their words, and 32 or
   more of another). Every window whose words start anywhere else marks its words;
   overlapping marks join into the maximal repeats, which are cut out.

Hashes meet in buckets by value. Documents are first put in chunks (a hash of the key), and a
chunk sends each distinct hash once to its bucket as a packed array with one count, so a
passage that a third of all documents share costs one entry a chunk and no pairs are ever
made. The documents' chunks and the answers for them meet again by chunk number.

A chunk sends to at most 2**GROUP_BITS groups of buckets, so its arrays stay long and rows grow
with the data, not with chunks times buckets. Where that many buckets of BUCKET_BYTES aren't
enough (at some 32 GB of input), hashes take a second step: all that a slab of chunks sent to one group
is merged, and sent on to the group's buckets; the answers come back the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm import textnum
from strandfold.llm.shared import batched, parts, salted, table

WINDOW = 35
BLOCK = 18
#: Input to a chunk, which a task holds in memory some twenty times over, and to a bucket.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 8 << 20
#: A chunk sends to at most so many groups of buckets (a power of two).
GROUP_BITS = 12
#: Tasks of one pass; a task takes its chunks one at a time.
MOST_TASKS = 20_000
#: Rows of one key and text from which on rows are told apart, so that they spread over chunks.
MANY_ROWS = 1000
#: Bits of a hash besides those of its bucket.
BITS = 32
SENT = pa.schema([("bucket", pa.int32()), ("slab", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("twice", pa.binary()), ("special", pa.binary())])
SENT_SQL = "bucket int, slab int, chunk int, hashes binary, more binary, twice binary, special binary"
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())])
ANSWER_SQL = "chunk int, bucket int, hashes binary, more binary"


def pack(x: np.ndarray) -> bytes:
    """Sorted numbers: the first, then differences in as few bytes each as the largest needs (four at least)."""
    if not len(x):
        return b""
    d = np.diff(x)
    wide = max(4, -(-int(d.max()).bit_length() // 8)) if len(d) else 4
    return bytes([wide]) + x[:1].tobytes() + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    wide, n = b[0], (len(b) - 9) // b[0]
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(b, np.uint8, 8, 1)
    d[1:, :wide] = np.frombuffer(b, np.uint8, n * wide, 9).reshape(n, wide)
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def _runs(h: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """Where runs of equal (h, more) begin in sorted arrays."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    if more is not None:
        new[1:] |= more[1:] != more[:-1]
    return np.flatnonzero(new)


def _order(h: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    return np.argsort(h, kind="stable") if more is None else np.lexsort((more, h))


def send(chunk: int, slab: int, h: np.ndarray, more: np.ndarray | None, twice: np.ndarray | None, special: np.ndarray | None, low: int, above: int = 0) -> pa.Table:
    """Rows for the buckets (above, and the bits of h from bit low): each distinct hash once, and whether it occurs twice here and is special here."""
    order = _order(h, more)
    h, more = h[order], None if more is None else more[order]
    at = _runs(h, more)
    many = np.diff(np.append(at, len(h))) > 1
    over = lambda marks: np.maximum.reduceat(marks[order].astype(np.uint8), at) > 0 if marks is not None and len(at) else np.zeros(0, dtype=bool)
    mark = over(special)
    if twice is not None:
        many |= over(twice)
    h, more = h[at], None if more is None else more[at]
    bucket = (h >> np.uint64(low)).astype(np.int64)
    used, cut = np.unique(bucket, return_index=True)
    cut = np.append(cut, len(h))
    h = h & np.uint64((1 << low) - 1)
    ranges = list(zip(cut[:-1], cut[1:]))
    return pa.table(
        [
            (used + above).astype(np.int32),
            np.full(len(used), slab, dtype=np.int32),
            np.full(len(used), chunk, dtype=np.int32),
            [pack(h[a:b]) for a, b in ranges],
            [b"" if more is None else more[a:b].tobytes() for a, b in ranges],
            [np.packbits(many[a:b]).tobytes() for a, b in ranges],
            [np.packbits(mark[a:b]).tobytes() if len(mark) else b"" for a, b in ranges],
        ],
        schema=SENT,
    )


def _received(sent: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray | None]:
    """(hash, second hash, row, twice, special) of every entry of the rows."""
    cols = [sent.column(c).to_pylist() for c in range(3, 7)]
    each = [unpack(x) for x in cols[0]]
    n = [len(x) for x in each]
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    more = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in cols[1]]) if any(cols[1]) else None
    bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=k) for x, k in zip(c, n)])
    return h, more, np.repeat(np.arange(len(n)), n), bits(cols[2]), bits(cols[3]) if any(cols[3]) else None


def meet(sent: pa.Table) -> pa.Table:
    """The hashes of one bucket that occur twice (and, where any is marked, are special somewhere), for each chunk that sent them."""
    h, more, owner, twice, special = _received(sent)
    order = _order(h, more)
    h, owner, more = h[order], owner[order], None if more is None else more[order]
    at = _runs(h, more)
    size = np.diff(np.append(at, len(h)))
    good = (size > 1) | (np.maximum.reduceat(twice[order], at) > 0)
    if special is not None:
        good &= np.maximum.reduceat(special[order], at) > 0
    keep = np.flatnonzero(np.repeat(good, size))
    keep = keep[np.argsort(owner[keep], kind="stable")]
    return _answer(sent, owner[keep], h[keep], None if more is None else more[keep])


def _answer(sent: pa.Table, owner: np.ndarray, h: np.ndarray, more: np.ndarray | None) -> pa.Table:
    """One row for each row of sent that owns some of the hashes (in order of rows, sorted within)."""
    used, cut = np.unique(owner, return_index=True)
    ranges = list(zip(cut, np.append(cut[1:], len(h))))
    return pa.table(
        [
            sent.column(2).to_numpy()[used],
            sent.column(0).to_numpy()[used],
            [pack(h[a:b]) for a, b in ranges],
            [more[a:b].tobytes() if more is not None else b"" for a, b in ranges],
        ],
        schema=ANSWER,
    )


def answers(got: pa.Table, low: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All hashes in some answers, sorted; low: how many bits they have besides their bucket's."""
    rows = sorted(zip(got.column(1).to_pylist(), got.column(2).to_pylist(), got.column(3).to_pylist()), key=lambda r: r[0])
    h = [unpack(x) | np.uint64(b << low) for b, x, _ in rows]
    more = [np.frombuffer(x, dtype=np.uint64) for _, _, x in rows]
    return np.concatenate(h) if h else np.zeros(0, np.uint64), np.concatenate(more) if any(len(m) for m in more) else None


def exchanged(sent: DataFrame, group_bits: int, bucket_bits: int) -> DataFrame:
    """The answers to sent rows: by one meeting in 2**group_bits buckets, or, with bucket_bits, in that many buckets of each group."""
    if not bucket_bits:
        return sent.groupBy("bucket").applyInArrow(meet, ANSWER_SQL)
    low = BITS + bucket_bits

    def merge(t: pa.Table) -> pa.Table:
        h, more, _, twice, special = _received(t)
        return send(t.column(1)[0].as_py(), 0, h, more, twice, special, BITS, t.column(0)[0].as_py() << bucket_bits)

    def spread(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows or not got.num_rows:
            return ANSWER.empty_table()
        of, of_more = answers(got, BITS)
        h, more, owner, _, _ = _received(t)
        mine = np.flatnonzero(member(h | np.uint64(t.column(0)[0].as_py() << low), more, of, of_more))
        return _answer(t, owner[mine], h[mine], None if more is None else more[mine])

    by_slab = sent.groupBy("bucket", "slab")
    met = by_slab.applyInArrow(merge, SENT_SQL).groupBy("bucket").applyInArrow(meet, ANSWER_SQL)
    # the chunk that a merged row names is its slab
    back = met.select("chunk", "bucket", "hashes", "more", F.shiftright("bucket", bucket_bits).alias("group"))
    return by_slab.cogroup(back.groupBy("group", "chunk")).applyInArrow(spread, ANSWER_SQL)


def member(h: np.ndarray, more: np.ndarray | None, of: np.ndarray, of_more: np.ndarray | None) -> np.ndarray:
    """Which of the hashes are among the answers."""
    if not len(of) or not len(h):
        return np.zeros(len(h), dtype=bool)
    i = np.searchsorted(of, h)
    out = np.zeros(len(h), dtype=bool)
    step = 0
    while True:  # more than once only where answers differ in the second half alone
        j = np.minimum(i + step, len(of) - 1)
        same = (of[j] == h) & (i + step < len(of))
        out |= same if more is None or of_more is None else same & (of_more[j] == more)
        if more is None or of_more is None or not same.any():
            return out
        step += 1


def cover(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions 0 .. n-1 in a run of size that starts at a marked position."""
    d = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    d[at] += 1
    d[at + size] -= 1
    return np.cumsum(d)[:n] > 0


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def candidates(h: np.ndarray, first: np.ndarray, anchors: np.ndarray, size: int, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the windows that hold an anchor, and the two halves of their hashes."""
    n = len(h) - size + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n <= 0 or not len(anchors):
        return none
    rolling = textnum.windows(h, block)
    hit = member(_top(rolling, bits), None, anchors, None) & textnum.window_rows(first, block, len(rolling))
    some = np.concatenate([[0], np.cumsum(hit)])
    at = np.flatnonzero((some[size - block + 1 : size - block + 1 + n] > some[:n]) & textnum.window_rows(first, size, n))
    return (at, _top(textnum.windows(h, size, 1)[at], bits), textnum.windows(h, size, 2)[at]) if len(at) else none


def join_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """One string a row: its kept words, joined by one space."""
    at = np.flatnonzero(keep)
    row = np.searchsorted(first, at, side="right") - 1
    last = np.ones(len(at), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    size = ends[at] - starts[at] + ~last
    out_ends = np.cumsum(size)
    total = int(out_ends[-1]) if len(at) else 0
    where = np.arange(total) + np.repeat(starts[at] - (out_ends - size), size)
    out = np.append(raw, np.uint8(32))[np.minimum(where, len(raw))] if total else np.zeros(0, np.uint8)
    out[out_ends[~last] - 1] = 32
    offsets = np.concatenate([[0], out_ends])[np.searchsorted(at, first)]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out)))


def repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, group_bits: int = GROUP_BITS,
) -> DataFrame:
    """(key, n_words long, n_removed long, kept string): each text without the words that repeated windows cover.

    Windows are judged on the input, over all documents, the same one included. Words are
    runs of bytes outside {0x20, 0x09-0x0D}, unchanged; kept words are joined by one space.
    A null or empty text has no words. A very long text is one chunk, with those of its
    number. Rows with equal or null keys stay separate rows, and their texts are compared
    like any others; many rows of one key are spread by a number of their own. An empty
    table gives an empty result. Other columns aren't read.
    """
    if not 0 < block <= (size + 1) // 2:
        raise ValueError("a window must hold a whole reference block at any alignment")
    kind = docs.schema[key].dataType.simpleString()
    n_chunks = parts(docs, chunk_bytes)
    all_bits = max(1, (parts(docs, bucket_bytes) - 1).bit_length())
    first_bits = min(all_bits, group_bits)
    bucket_bits = all_bits - first_bits
    bits, low, slab = BITS + all_bits, BITS + bucket_bits, 1 << bucket_bits
    docs = salted(batched(docs).select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")), "k", MANY_ROWS)
    chunk = F.pmod(F.xxhash64("k", F.crc32(F.col("text").cast("binary")), "__salt"), F.lit(n_chunks)).cast("int")
    docs = docs.select(chunk.alias("chunk"), "k", "text").repartition(min(n_chunks, MOST_TASKS), "chunk")

    def probe(t: pa.Table) -> pa.Table:
        h, _, _, first, _ = textnum.words(t.column(2))
        rolling = textnum.windows(h, block)
        at = np.flatnonzero(textnum.window_rows(first, block, len(rolling)))
        row = np.searchsorted(first, at, side="right") - 1
        c = t.column(0)[0].as_py()
        return send(c, c // slab, _top(rolling[at], bits), None, None, (at - first[row]) % block == 0, low)

    def extend(t: pa.Table, got: pa.Table) -> pa.Table:
        if not t.num_rows or not got.num_rows:
            return SENT.empty_table()
        h, _, _, first, _ = textnum.words(t.column(2))
        _, a, b = candidates(h, first, answers(got, low)[0], size, block, bits)
        c = t.column(0)[0].as_py()
        return send(c, c // slab, a, b, None, None, low)

    def cut(t: pa.Table, got: pa.Table) -> pa.Table:
        h, starts, ends, first, raw = textnum.words(t.column(2))
        gone = np.zeros(len(h), dtype=bool)
        n = len(h) - size + 1
        if got.num_rows and n > 0:
            of, more = answers(got, low)
            same = member(_top(textnum.windows(h, size, 1), bits), textnum.windows(h, size, 2), of, more)
            gone = cover(same & textnum.window_rows(first, size, n), len(h), size)
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        columns = [t.column(1), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(removed), pa.int64()), join_words(raw, starts, ends, first, ~gone).cast(pa.string())]
        return pa.table(columns, names=["k", "n_words", "n_removed", "kept"])

    by_chunk = docs.groupBy("chunk")
    anchors = exchanged(by_chunk.applyInArrow(probe, SENT_SQL), first_bits, bucket_bits)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(extend, SENT_SQL)
    repeated = exchanged(windows, first_bits, bucket_bits)
    out = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(cut, f"k {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("k", key)


def op10_fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_fixed_blocks": op10_fixed_blocks}
#: Every window as a string, counted.
SQL = {
    "op10_fixed_blocks": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM v),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM r),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
