"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line is removed if the same line, or one within `edits` edits of it, stands earlier in the
corpus (by document key, then line number). Blank lines stay; lines of fewer than MIN_CHARS
characters are compared by equality alone, since two edits could turn them into anything.

1. Equal lines are counted once: a distinct line is a 128-bit hash with its first place.
2. A line is cut into edits + 1 even segments. Of two lines within `edits` edits, the longer
   one holds a whole segment of the shorter at one of the few offsets that the
   multi-match-aware rule leaves. The index holds (length, number, segment); a line probes it
   for each length that may match.
3. A key with more than HOT index rows isn't joined. The segment is taken out of both lines
   instead (what is left is still within `edits` edits) and the rest is cut, indexed and
   probed again under the old key, up to DEPTH times: a phrase that a third of all lines
   share costs more rows, but never all pairs.
4. Candidates are verified by a banded bit-parallel edit distance: one integer holds the band
   around the diagonal, and each character updates it with a few bit operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Column

from strandfold.llm import shared
from strandfold.llm.shared import small, stored, table

EDITS = 2
MIN_CHARS = 20
HOT = 200
DEPTH = 5
#: Lines with more copies than this enter the join by their first place only.
MANY_COPIES = 100


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: lambdas have no variables of their own."""
    return F.get(F.transform(F.array(value), then), 0)


def bit_parallel_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most edits, else some larger number.

    The strings must have more than edits characters and lengths at most edits apart. Bit k of
    the band in column j is row j - edits + k. The score follows the lowest diagonal of the
    band until that leaves the matrix, then the last row.
    """
    one = F.lit(1).cast("long")
    width = 2 * edits + 1
    mask, top = F.lit((1 << width) - 1).cast("long"), F.lit(1 << (width - 1)).cast("long")
    zero = F.lit(0).cast("long")

    def step(chars: Column, n: Column, acc: Column, c: Column) -> Column:
        j = acc["j"]
        x = zero
        for k in range(width):
            x = x.bitwiseOR(F.when(F.get(chars, j + (k - edits - 1)) == c, F.lit(1 << k).cast("long")).otherwise(zero))

        def with_d0(d0: Column) -> Column:
            hp = acc["vn"].bitwiseOR(mask.bitwiseAND(F.bitwise_not(d0.bitwiseOR(acc["vp"]))))
            hn = d0.bitwiseAND(acc["vp"])
            down = F.shiftright(d0, 1)

            def with_h(h: Column) -> Column:
                at = F.call_function("shiftleft", one, F.greatest(n - j + edits, F.lit(0)))
                last = F.when(h["p"].bitwiseAND(at) != 0, 1).when(h["n"].bitwiseAND(at) != 0, -1).otherwise(0)
                diagonal = F.when(d0.bitwiseAND(top) != 0, 0).otherwise(1)
                return F.struct(
                    h["n"].bitwiseOR(mask.bitwiseAND(F.bitwise_not(down.bitwiseOR(h["p"])))).alias("vp"),
                    down.bitwiseAND(h["p"]).alias("vn"),
                    (acc["dist"] + F.when(j <= n - edits, diagonal).otherwise(last)).cast("int").alias("dist"),
                    (j + 1).cast("int").alias("j"),
                )

            return _let(F.struct(hp.alias("p"), hn.alias("n")), with_h)

        bits = _let(x, lambda x: _let((x.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"]).bitwiseOR(x).bitwiseOR(acc["vn"]).bitwiseAND(mask), with_d0))
        return F.when(acc["dist"] > 3 * edits, acc).otherwise(bits)  # the last 2 * edits columns can't make up for that

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).alias("dist"), F.lit(1).alias("j"))
    return _let(
        F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")),
        lambda s: _let(F.size(s["a"]), lambda n: F.aggregate(s["b"], start, lambda acc, c: step(s["a"], n, acc, c), lambda acc: acc["dist"])),
    )


def _common(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at their start (strings of less than 2**20 characters; else perhaps fewer)."""
    same = lambda p, k: F.substring(a, p + 1, k) == F.substring(b, p + 1, k)
    steps = F.array(*[F.lit(1 << k) for k in range(19, -1, -1)])
    return _let(
        F.least(F.char_length(a), F.char_length(b)),
        lambda most: F.aggregate(F.filter(steps, lambda k: k <= most), F.lit(0), lambda p, k: F.when((p + k <= most) & same(p, k), p + k).otherwise(p)),
    )


def trimmed(a: Column, b: Column, spare: int) -> Column:
    """struct(a, b) without the characters that both have at both ends, but for spare ones: the distance is the same."""

    def front(p: Column) -> Column:
        p = F.greatest(p - spare, F.lit(0))
        rest = F.struct(F.reverse(F.substr(a, p + 1)).alias("a"), F.reverse(F.substr(b, p + 1)).alias("b"))
        return _let(rest, lambda r: _let(_common(r["a"], r["b"]), lambda q: F.struct(F.substr(r["a"], F.greatest(q - spare, F.lit(0)) + 1).alias("a"), F.substr(r["b"], F.greatest(q - spare, F.lit(0)) + 1).alias("b"))))

    return _let(_common(a, b), front)


def surviving(a: Column, b: Column, edits: int, pieces: int = 8) -> Column:
    """How many of the even pieces of a stand in b at most edits characters from their place.

    An edit spoils one piece, so lines within edits edits keep pieces - edits of them.
    """
    total = F.lit(0)
    for i in range(pieces):
        start, size = _segment(F.char_length(a), i, pieces)
        around = F.substring(b, F.greatest(start + 1 - edits, F.lit(1)), size + edits + F.least(start, F.lit(edits)))
        total = total + F.when(F.contains(around, F.substring(a, start + 1, size)), 1).otherwise(0)
    return total


def sketch(line: Column) -> Column:
    """struct(one, two): the parities of a line's characters and of its pairs of neighbours, each in 64 bits by their codes.

    An edit takes or adds at most two characters and four pairs.
    """
    bit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)).cast("int"))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))

    def step(acc: Column, c: Column) -> Column:
        pair = F.when(acc["last"] == 0, F.lit(0).cast("long")).otherwise(bit(acc["last"] * 37 + c))
        return F.struct(c.alias("last"), acc["one"].bitwiseXOR(bit(c)).alias("one"), acc["two"].bitwiseXOR(pair).alias("two"))

    codes = F.transform(F.split(line, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, start, step, lambda acc: F.struct(acc["one"].alias("one"), acc["two"].alias("two")))


def alike(a_one: str, b_one: str, a_two: str, b_two: str, edits: int) -> Column:
    """Whether two sketches may be of lines within edits edits: those of lines that are always may."""
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return (apart(a_one, b_one) <= 2 * edits) & (apart(a_two, b_two) <= 4 * edits)


def _segment(n: Column, i: int | Column, pieces: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a string of n characters; the last n % pieces are one longer."""
    base, extra = F.floor(n / pieces).cast("int"), n % pieces
    late = F.greatest(F.lit(i) - (pieces - extra), F.lit(0))
    return base * i + late, base + F.when(F.lit(i) >= pieces - extra, 1).otherwise(0)


def _shifts(i: int, d: int, edits: int) -> range:
    """Where segment i of a line d characters shorter may begin, from its place."""
    return range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)


def _keyed(long: DataFrame, edits: int, role: str) -> DataFrame:
    """(h1, key) of the lines (h1, text, n): the index keys, or the probes that aren't among these.

    A row for each cut comes first and one expression makes its key: all keys in one expression
    are more bytecode than the JVM compiles (8,000 bytes a method), and would be interpreted.
    """
    every = [(i, d, s) for d in range(edits + 1) for i in range(edits + 1) for s in _shifts(i, d, edits)]
    own = [(i, 0, 0) for i in range(edits + 1)]
    cuts = own if role == "index" else [c for c in every if c not in own]
    struct = [F.struct(*[F.lit(x).alias(name) for name, x in zip("ids", c)]) for c in cuts]
    rows = long.select("h1", "text", "n", F.explode(F.array(*struct)).alias("cut"))
    length = (F.col("n") - F.col("cut.d")).cast("int")
    start, size = _segment(length, F.col("cut.i"), edits + 1)
    return rows.select("h1", F.xxhash64("cut.i", length, F.substring(F.col("text"), start + F.col("cut.s") + 1, size)).alias("key"))


def _keys(text: Column, n: Column, under: list[Column], edits: int, role: str, delta: int | None = None) -> Column:
    """(key, rest, delta): the index keys of a line, or its probes for lines delta shorter (None: for each delta), with what is left of it."""
    out = []
    for d in [0] if role == "index" else range(edits + 1) if delta is None else [delta]:
        length = (n - d).cast("int")
        for i in range(edits + 1):
            start, size = _segment(length, i, edits + 1)
            shifts = [0] if role == "index" else _shifts(i, d, edits)
            for s in shifts:
                at = start + s
                key = F.xxhash64(*under, F.lit(i), length, F.substring(text, at + 1, size))
                left = F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + size + 1, n))
                out.append(F.struct(key.alias("key"), left.alias("rest"), F.lit(d).alias("delta")))
    return F.array(*out)


def _pairs(index: DataFrame, probe: DataFrame) -> DataFrame:
    """(ha, hb) with a common key."""
    index = index.select("key", F.col("h1").alias("ha"))
    probe = probe.select("key", F.col("h1").alias("hb"))
    return probe.join(index, "key").where("ha <> hb").select(F.least("ha", "hb").alias("ha"), F.greatest("ha", "hb").alias("hb")).distinct()


_LOCAL_MAP, HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", 32 << 20


def _hash_where_small(spark: SparkSession) -> None:
    """Let joins hash a partition where its measured size is small, and sort, which can spill, where it isn't; a value that the session has set stays."""
    if spark.conf.get(_LOCAL_MAP, "0b") in ("0", "0b"):
        spark.conf.set(_LOCAL_MAP, str(HASHED_BYTES))


def _hot_pairs(long: DataFrame, hot: DataFrame, edits: int, hot_rows: int, depth: int) -> DataFrame:
    """Pairs under hot keys: cut the matched segment out and match the rest, level by level."""
    n = F.char_length("text")
    rows = lambda role: long.select("h1", F.explode(_keys(F.col("text"), n, [], edits, role)).alias("k")).select("h1", "k.key", "k.rest", "k.delta")
    index, probe = (rows(r).join(small(hot), "key", "left_semi") for r in ("index", "probe"))
    out = None
    for level in range(depth):
        n = F.char_length("rest")
        short = n - F.col("delta") < 2 * (edits + 1)  # little is left to cut; the length is that of the indexed line on both sides
        done = _pairs(index.where(short), probe.where(short))
        again = lambda df, role, d=None: df.select("h1", F.explode(_keys(F.col("rest"), n, [F.col("key")], edits, role, d)).alias("k")).select("h1", "k.key", "k.rest", "k.delta")  # noqa: E731, B023
        index = stored(again(index.where(~short), "index").distinct(), "hot-index")
        parts = [again(probe.where(~short & (F.col("delta") == d)), "probe", d) for d in range(edits + 1)]
        probe = parts[0]
        for p in parts[1:]:
            probe = probe.union(p)
        probe = stored(probe.distinct(), "hot-probe")
        hot = stored(index.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > hot_rows).select("key"), "hot-keys")
        last = level == depth - 1
        cold = lambda df: df if last else df.join(hot, "key", "left_anti")  # noqa: E731, B023
        done = done.union(_pairs(cold(index), cold(probe)))
        out = done if out is None else out.union(done)
        if last or hot.isEmpty():
            return out
        index, probe = index.join(hot, "key", "left_semi"), probe.join(hot, "key", "left_semi")
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(id, no, line) of (id, text): null texts have no lines."""
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _ids(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


#: Words of the bits that say which hashes are needed: up to 8 MB.
MOST_WORDS = 1 << 20


def _bits(hashes: DataFrame, n: int) -> DataFrame:
    """One row of bits: 16 or more for each of the n hashes (h), as far as MOST_WORDS goes."""
    words = 1
    while words < min(n / 4, MOST_WORDS):
        words *= 2
    found = hashes.groupBy(_word(F.col("h"), F.lit(words)).alias("word")).agg(F.bit_or(_bit(F.col("h"))).alias("bits"))
    found = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(found, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return stored(found.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("__bits")), "line-bits")


def _word(h: Column, words: Column) -> Column:
    return F.shiftright(h, 6).bitwiseAND(words - 1).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _where_bit(df: DataFrame, bits: DataFrame, h: Column, there: bool = True) -> DataFrame:
    """The rows of df whose hash has its bit, or those that have it not: all others besides few."""
    set_ = F.get("__bits", _word(h, F.size("__bits"))).bitwiseAND(_bit(h)) != 0
    return df.join(F.broadcast(bits), set_ if there else ~set_).drop("__bits")


def _among(df: DataFrame, own: Column, needed: DataFrame, theirs: Column) -> DataFrame:
    """df without most of the rows whose hash (own) isn't one of needed (theirs).

    Where needed is too large to be broadcast, 16 or more bits a row of it are, in a row of
    their own: only rows whose bit is set, some one in 16 besides those needed, go to the join.
    """
    n = needed.count()
    return df if n <= shared.BROADCAST_ROWS else _where_bit(df, _bits(needed.select(theirs.alias("h")), n), own)


def _near_places(every: DataFrame, needed: DataFrame) -> DataFrame:
    """The lines (id, no, line) without most of those that needed (p_id, p_no) doesn't name."""
    return _among(every, F.xxhash64("id", "no"), needed, F.xxhash64("p_id", "p_no"))


def duplicate_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, hot_rows: int = HOT, depth: int = DEPTH) -> DataFrame:
    """(id, removed array<int>) for the documents of (id, text) that lose lines: the line numbers, from 0."""
    _hash_where_small(docs.sparkSession)
    place = F.struct("id", "no")
    filled = _lines(docs).where("length(trim(line)) > 0")
    own = filled.select("id", "no", *_ids())
    firsts = stored(own.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "first-lines")
    copied = small(firsts.where(F.col("copies") > MANY_COPIES).select("h1", "h2", "first"))
    long = filled.select("id", "no", "line", *_ids()).where(F.char_length("line") >= min_chars)
    long = long.join(copied, ["h1", "h2"], "left").where("first is null or (first.id <=> id and first.no = no)").select("id", "no", "h1", "h2", F.col("line").alias("text"))
    long = long.withColumn("n", F.char_length("text"))
    index = stored(_keyed(long, edits, "index"), "line-index")
    probe = _keyed(long, edits, "probe").union(index)  # a line's own keys are probes, too
    many = stored(index.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > hot_rows).select("key"), "many-keys")
    hot = stored(index.join(small(many), "key", "left_semi").groupBy("key").agg(F.countDistinct("h1").alias("k")).where(F.col("k") > hot_rows).select("key"), "hot-keys")
    if hot.isEmpty():
        pairs = _pairs(index, probe)
    else:
        pairs = _pairs(index.join(hot, "key", "left_anti"), probe.join(hot, "key", "left_anti"))
        pairs = pairs.union(_hot_pairs(long.select("h1", "text").distinct(), hot, edits, hot_rows, depth)).distinct()
    pairs = stored(pairs, "line-candidates")
    ends = stored(pairs.select(F.col("ha").alias("h1")).union(pairs.select("hb")).distinct(), "line-ends")
    needed = stored(_among(firsts, F.col("h1"), ends, F.col("h1")).join(small(ends), "h1").select(F.col("first.id").alias("p_id"), F.col("first.no").alias("p_no"), "h1", "h2"), "line-needed")
    # null keys are one place too; the hashes tell the lines of documents with one key apart
    there = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("no") == F.col("p_no")) & (F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit(1), "line") == F.col("h2"))
    texts = _near_places(_lines(docs), needed).join(small(needed), there).select(F.struct("id", "no").alias("p"), "h1", "h2", "line")
    texts = stored(texts.withColumn("sketch", sketch(F.col("line"))).select("p", "h1", "h2", "line", "sketch.one", "sketch.two"), "line-texts")
    # most candidates share a segment by chance: sketches tell, before texts are joined to them
    side = lambda s: small(texts.select(F.col("h1").alias(f"h{s}"), F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("p").alias(s), F.col("one").alias(f"{s}_one"), F.col("two").alias(f"{s}_two")))
    pairs = pairs.join(side("a"), "ha").join(side("b"), "hb").where(alike("a_one", "b_one", "a_two", "b_two", edits))
    pairs = stored(pairs.select("a1", "a2", "b1", "b2", "a", "b"), "line-pairs")
    text = lambda s: texts.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("line").alias(f"t{s}"))
    pieces = 8
    late = [F.when(F.col("a") < F.col("b"), F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(f"h{i}") for i in (1, 2)]

    def settled(some: DataFrame) -> DataFrame:
        """(h1, h2) of the later lines of the pairs that are within the edits."""
        near = small(some).join(text("a"), ["a1", "a2"])
        near = near.join(text("b"), ["b1", "b2"]).where(surviving(F.col("ta"), F.col("tb"), edits, pieces) >= pieces - edits)
        distance = _let(trimmed(F.col("ta"), F.col("tb"), edits + 1), lambda t: bit_parallel_distance(t["a"], t["b"], edits))
        return near.where(distance <= edits).select(*late).distinct()

    # one near line before it is enough: the earliest is tried first, the others only for lines that it leaves open
    tried = stored(pairs.select("*", *late).groupBy("h1", "h2").agg(F.min_by(F.struct("a1", "a2", "b1", "b2", "a", "b"), F.least("a", "b")).alias("p")).select("p.*"), "tried-pairs")
    one = stored(settled(tried), "later-lines")
    rest = stored(pairs.select("*", *late).join(small(one), ["h1", "h2"], "left_anti").drop("h1", "h2").exceptAll(tried), "open-pairs")
    later = stored(one.union(settled(rest)).withColumn("near", F.lit(True)), "later-lines")
    flags = stored(firsts.join(small(later), ["h1", "h2"], "left").where("near or copies > 1").select("h1", "h2", "first", "near"), "line-flags")
    gone = _among(own, F.col("h1"), flags, F.col("h1")).join(small(flags), ["h1", "h2"]).where("near or not (first.id <=> id and first.no = no)")
    return gone.groupBy("id").agg(F.sort_array(F.collect_list("no")).alias("removed"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, **options) -> DataFrame:
    """All rows and columns of docs with text cut down, plus n_lines, n_removed, removed (line numbers from 0).

    Lines are cut at "\\n". A null text stays null and has no lines; an empty one has one
    blank line, which stays; a very long line is compared whole. Of repeated lines the first stays. The key orders the corpus and must tell documents apart; rows
    with one key (or none) lose the lines of any of them. Columns of docs with our names
    are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    cut = duplicate_lines(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), edits, **options)
    cut = stored(cut.select(F.col("id").alias("__id"), "removed"), "line-cuts")
    some, others, n = docs, None, cut.count()
    if n > shared.BROADCAST_ROWS:  # only documents that lose lines, and few others, are shuffled
        bits, own = _bits(cut.select(F.xxhash64("__id").alias("h")), n), F.xxhash64(F.col(key).cast(cut.schema["__id"].dataType))
        some, others = _where_bit(docs, bits, own), _where_bit(docs, bits, own, there=False)
    out = some.join(small(cut), F.col(key).eqNullSafe(F.col("__id")), "left")
    if others is not None:
        out = out.unionByName(others.withColumns({c: F.lit(None).cast(t) for c, t in cut.dtypes}))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    every = F.split(text, "\n")
    kept = F.when(F.size(removed) == 0, F.col(text)).otherwise(F.array_join(F.filter(every, lambda _, i: ~F.array_contains(removed, i)), "\n"))
    columns = [kept.alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size(every), F.lit(0)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))


def op2_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_segment_lines": op2_segment_lines}
#: levenshtein() counts bytes, so these become single bytes first; lines with other characters beyond ASCII may be farther apart here.
_ACCENTS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍàáôú\u00a0"
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(_ACCENTS)])
#: All pairs of distinct lines of about one length of which a third stands in the other.
SQL = {
    "op2_segment_lines": f"""
WITH every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
filled AS (SELECT doc_id, no, line FROM every WHERE length(trim(line)) > 0),
firsts AS (SELECT line, min((doc_id, no)) AS place FROM filled GROUP BY line),
long AS (SELECT line, place, length(line) AS n, translate(line, '{_ACCENTS}', {_BYTES}) AS b FROM firsts WHERE length(line) >= {MIN_CHARS}),
near AS MATERIALIZED (SELECT y.line, x.b AS xb, y.b AS yb FROM long x JOIN long y ON y.n BETWEEN x.n - {EDITS} AND x.n + {EDITS} AND x.place < y.place
    WHERE contains(y.b, substr(x.b, 1, x.n // 3)) OR contains(y.b, substr(x.b, x.n // 3 + 1, x.n // 3)) OR contains(y.b, substr(x.b, 2 * (x.n // 3) + 1))),
later AS (SELECT DISTINCT line FROM near WHERE levenshtein(xb, yb) <= {EDITS}),
gone AS (SELECT doc_id, no FROM filled JOIN firsts USING (line) WHERE (doc_id, no) <> place OR line IN (SELECT line FROM later)),
per AS (SELECT doc_id, list(no ORDER BY no) AS removed FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS kept FROM every ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS INT) AS n_lines, CAST(coalesce(len(removed), 0) AS INT) AS n_removed,
    CAST(coalesce(removed, []) AS INT[]) AS removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""
}
