"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on full sets.

A text's set is its distinct word shingles. Register i keeps the smallest of exponential
variables drawn from the shingles' hashes, truncated to a power of BASE: sketches merge by
their larger registers, and two of them agree in a register with about the probability J,
the sets' Jaccard similarity. Bands of registers collect candidates; of two sketches and the
set sizes, J is estimated by maximum likelihood; candidates whose estimate isn't far below
the threshold are compared on their full sets.

Texts with one and the same set form a class with one representative, so thousands of copies
are one row here. Of a band with n representatives only n - 1 pairs (each with the smallest
id) are looked at first; what these leave in different components is then compared block
by block, pairs inside one component being decided already: those outside the largest component
meet all others. A band with more than HOT_BAND
representatives outside its largest component, as of very many texts with one long passage in common, is first parted by the bands
that its texts share besides, DEEPER levels deep: similar texts share more than three bands of
the 25 but for about one pair in 30,000 at a similarity of 0.85 (one in 600 at 0.8),
and the others fall apart. So no group is turned into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm import textnum
from strandfold.llm.graph import components
from strandfold.llm.shared import batched, small, stored, table

REGISTERS, ROWS = 100, 4
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Candidates whose estimate is this much below the threshold aren't verified: over four standard errors.
SLACK = 0.15
BLOCK = 512
HOT_BAND, DEEPER = 2048, 2
#: Shingles of the texts that are verified against each other in one group.
GROUP_SHINGLES = 200_000
SLICE = 1 << 18
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than size make one shingle, none make none."""
    for some in textnum.slices(column, SLICE):
        yield from _shingle_sets(some, size)


def _shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    h, _, _, first, _ = textnum.words(column, fold=True)
    w = textnum.windows(h, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(w[a : b - size + 1])
        elif b > a:
            yield textnum.windows(h[a:b], int(b - a), 3)
        else:
            yield np.zeros(0, np.uint64)


def registers(x: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes: uint16 registers."""
    low = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(x), 256):
        low = np.minimum(low, (x[lo : lo + 256, None] * _FACTORS[None, :]).min(axis=0))
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(up: np.ndarray, down: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest J, given in how many registers a is larger, b is larger, and the set sizes."""
    na, nb = np.asarray(na, float)[:, None], np.asarray(nb, float)[:, None]
    u, v = na / (na + nb), nb / (na + nb)
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    up, down = np.asarray(up)[:, None], np.asarray(down)[:, None]
    like = up * log(more) + down * log(less) + (REGISTERS - up - down) * log(1 - more - less)
    return j[np.arange(len(j)), like.argmax(axis=1)]


def reaches(up: np.ndarray, down: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether estimate() is at least least. The likelihood has one peak, so two points of its grid tell."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    u, v = na / (na + nb), nb / (na + nb)
    ratio = np.minimum(u / v, v / u)
    at = np.ceil(least / ratio * 200)
    at -= (at - 1) / 200 * ratio >= least
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    up, down = np.asarray(up), np.asarray(down)

    def like(g: np.ndarray) -> np.ndarray:
        j = np.clip(g, 0, 200) / 200 * ratio
        more, less = p(u - v * j), p(v - u * j)
        return up * log(more) + down * log(less) + (REGISTERS - up - down) * log(1 - more - less)

    return (at <= 0) | ((at <= 200) & (like(at) > like(at - 1)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, h1, h2, regs) of (id, text): set size, 128 bits of the set, its registers."""

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in bs:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                n, h1, h2, regs = [], [], [], []
                for x in shingle_sets(b.column(1), size):
                    n.append(len(x))
                    h1.append(x.sum(dtype=np.uint64).view(np.int64))
                    h2.append(textnum.mix(x + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))
                    regs.append(registers(x).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "h1", "h2", "regs"])

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least least."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bs:
            if not b.num_rows:
                continue
            x, y = _regs(b.column(4)), _regs(b.column(5))
            some = reaches((x > y).sum(axis=1), (x < y).sum(axis=1), b.column(2).to_numpy(), b.column(3).to_numpy(), least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(some))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def places(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, place): texts of one place have a smallest partner in common, and half of GROUP_SHINGLES shingles or so."""
    homes = sizes.join(members.groupBy("id").agg(F.min("pivot").alias("home")), "id")
    load = homes.groupBy("home").agg(F.ceil(2 * F.sum("n") / GROUP_SHINGLES).cast("int").alias("blocks"))
    return homes.join(load, "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("place"))


def verify(pairs: DataFrame, texts: DataFrame, at: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of (id, text) rows, which are at (id, place), with 100 * intersection >= percent * union, on full shingle sets.

    All pairs of two places come together, each text once: a text goes to as many groups as there are
    places that it has partners in, not to one for each of its partners.
    """
    side = lambda s, p: at.select(F.col("id").alias(s), F.col("place").alias(p))
    pairs = stored(pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").select("p", "q", "a", "b"), "pairs")
    ends = pairs.select("p", "q", F.col("a").alias("id")).union(pairs.select("p", "q", "b")).distinct()
    members = ends.join(texts, "id").select(F.col("p").alias("p"), F.col("q").alias("q"), "id", "text")

    def run(some: pa.Table, of: pa.Table) -> pa.Table:
        a, b = [], []
        rows: dict[int, list[int]] = {}
        sets = []
        for k, x in zip(of.column(2).to_pylist(), shingle_sets(of.column(3), size) if of.num_rows else []):
            if len(x):
                rows.setdefault(k, []).append(len(sets))
                sets.append(x)
        partners: dict[int, list[int]] = {}
        for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
            if x in rows and y in rows:
                partners.setdefault(x, []).append(y)
        if partners:
            n = np.array([len(x) for x in sets])
            every, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(codes, np.cumsum(n)[:-1])
            mark = np.zeros(len(every), np.int32)
        for x, ys in partners.items():
            theirs = [r for y in ys for r in rows[y]]
            whose = np.array([y for y in ys for _ in rows[y]])
            flat, first = np.concatenate([codes[r] for r in theirs]), np.cumsum([0, *n[theirs][:-1]])
            near = np.zeros(len(theirs), bool)
            for r in rows[x]:
                mark[codes[r]] = 1
                both = np.add.reduceat(mark[flat], first)
                mark[codes[r]] = 0
                near |= 100 * both >= percent * (n[r] + n[theirs] - both)
            linked = np.unique(whose[near]).tolist()
            a += [x] * len(linked)
            b += linked
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.groupBy("p", "q").cogroup(members.groupBy("p", "q")).applyInArrow(run, "a long, b long")


def rest_pairs(members: DataFrame, labels: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Likely pairs of one band that the pairs with its smallest id left in different components.

    Hot bands are parted by further bands, of which a pair has to share the next one, too.
    """
    labels = labels.withColumnRenamed("component", "c")
    m = members.join(labels, "id", "left").select("band", F.xxhash64("value").alias("value"), "id", "pivot", F.coalesce("c", "id").alias("c"))
    out = None
    for depth in range(DEEPER + 1):
        sizes = m.groupBy("band", "value", "c").agg(F.count("*").alias("kc"))
        mixed = sizes.groupBy("band", "value").agg(F.sum("kc").alias("k"), F.max(F.struct("kc", "c")).alias("main")).where("k > main.kc")
        mixed = mixed.select("band", "value", "k", (F.col("k") - F.col("main.kc")).alias("others"), F.col("main.c").alias("main"))
        mixed = stored(mixed, "mixed-bands")
        last = depth == DEEPER
        some = _in_blocks(m.join(mixed if last else mixed.where(F.col("others") <= HOT_BAND), ["band", "value"]), reps, least)
        out = some if out is None else out.union(some)
        hot = mixed.where(F.col("others") > HOT_BAND)
        if last or hot.isEmpty():
            break
        others = members.select("id", F.col("band").alias("next"), F.col("value").alias("also"))
        m = m.join(hot.select("band", "value"), ["band", "value"]).join(others, "id").where("next > band")
        m = stored(m.select(F.col("next").alias("band"), F.xxhash64("value", "also").alias("value"), "id", "pivot", "c"), "deeper-bands")
    return out.distinct()


def _in_blocks(m: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Likely pairs of different components in each (band, value) of m, whose members are k, of which others aren't of the component main.

    The others are cut into blocks of about BLOCK members, and so are all; each two blocks meet in
    one task, which compares sketches and gives out only likely pairs.
    """
    m = m.withColumns({"tall": F.ceil(F.col("others") / BLOCK).cast("int"), "wide": F.ceil(F.col("k") / BLOCK).cast("int")}).join(reps.select("id", "n", "regs"), "id")
    m = m.withColumns({"left": F.when(F.col("c") == F.col("main"), -1).otherwise(F.pmod(F.xxhash64("id"), F.col("tall"))).cast("int"), "right": F.pmod(F.xxhash64("id"), F.col("wide")).cast("int")})
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    row = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda y: at(F.col("left"), y))
    column = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda x: at(x, F.col("right")))
    m = m.withColumn("at", F.explode(F.when(F.col("left") < 0, column).otherwise(F.array_distinct(F.concat(row, column)))))
    m = m.select("band", "value", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "left", "right", "id", "pivot", "c", "n", "regs")

    def run(t: pa.Table) -> pa.Table:
        tall, wide, ids, pivot, c, n = (t.column(i).to_numpy() for i in (4, 5, 6, 7, 8, 9))
        x, y = t.column(2)[0].as_py(), t.column(3)[0].as_py()
        regs = _regs(t.column(10))
        left, right = np.flatnonzero(tall == x), np.flatnonzero(wide == y)
        a, b = [], []
        for i in left:
            j = right[(c[right] != c[i]) & ((tall[right] < 0) | (ids[right] > ids[i])) & (ids[right] != pivot[i]) & (ids[i] != pivot[right])]
            if len(j):
                j = j[(regs[j] == regs[i]).sum(axis=1) >= (least - 0.1) * REGISTERS]
            if len(j):
                j = j[reaches((regs[i] > regs[j]).sum(axis=1), (regs[i] < regs[j]).sum(axis=1), np.full(len(j), n[i]), n[j], least)]
                a += np.minimum(ids[i], ids[j]).tolist()
                b += np.maximum(ids[i], ids[j]).tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return m.groupBy("band", "value", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: the smallest key reachable over links of similar sets.

    A-Z count as a-z. Null and empty texts and those without words are linked with nothing; very long
    ones are compared whole. A row without a key is linked with nothing and kept, its
    component null. Rows with one key are one document of several texts, repeated rows one
    of equal ones. Other columns aren't read; an empty table gives an empty result.
    """
    docs = batched(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    least = percent / 100 - SLACK
    own = stored(sketches(docs, size), "sketches")
    classes = stored(own.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs")), "classes")
    reps = classes.select("id", "n", "regs").dropDuplicates(["id"])
    sizes = reps.select("id", "n")
    value = lambda i: F.substring("regs", i * 2 * ROWS + 1, 2 * ROWS)
    bands = classes.select("id", F.posexplode(F.array(*[value(i) for i in range(REGISTERS // ROWS)])).alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.min("id").alias("pivot"), F.count("*").alias("k")).where("k > 1").drop("k")
    members = stored(bands.join(shared, ["band", "value"]).distinct(), "members")
    texts = stored(docs.join(small(members.select("id").distinct()), "id"), "texts")
    star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    at = stored(places(members, sizes), "places")
    links = stored(verify(likely(star, reps, least), texts, at, size, percent), "links")
    more = stored(verify(rest_pairs(members, components(links), reps, least), texts, at, size, percent), "links")
    labels = components(links.union(more))
    labels = classes.select("h1", "h2", "n", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = own.select("id", "n", "h1", "h2").join(labels, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


QUERIES = {"op4_setsketch": op4_setsketch}
#: All pairs of texts with a shingle in common, and what can be reached over the links.
SQL = {
    "op4_setsketch": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
}
