"""I-Match fingerprints over randomised lexicons, in DataFrame functions only.

The lexicon is the terms whose inverse document frequency lies in a band: terms of very many
documents say nothing, terms of a single one are mostly slips. All distinct terms of a text
meet the band first. What is left is hashed as a whole, and in SUBSETS random subsets; each
draws its terms by itself, one in SPARSE * 4**l, where l follows from the number of the text's
terms in the band, so that a subset of a long or a short text has one to four of them. The
subsets of level l + 1 lie within those of level l, and a text has those of both. Two texts are
as alike as the share of equal hashes among the subsets, and the whole, that either has terms
in; so texts of different terms in the band are never told to be the same.

Document frequencies count every document. The terms above the band are at most
1 / MOST_SHARE times the mean number of distinct terms a text, however many texts there are,
and go to every task as one table. Those below it are in one document, and go to it with the shuffle that
brings each text to the next one. Of an edited text, words that touch its seam or its end may be cut ones; those
that its own text lacks are looked up by a join, and every other one is a whole word of one of the two texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold.llm.shared import stored, table

SUBSETS, SPARSE = 32, 16
DRAWS = (SPARSE.bit_length() - 1) // 2
LEAST_TERMS = 16
#: Subsets looked for at once.
FEW = 4
#: The band: at least MIN_DOCS documents, at most this share of all.
MIN_DOCS, MOST_SHARE = 2, 0.01
#: Documents of one range of ids; with more ranges than MOST_RANGES they become longer instead (a range's sort can spill).
RANGE_ROWS, MOST_RANGES = 4000, 50_000
#: Ids looked at to set the ends of a range.
SAMPLED = 20
#: Cells of the hash table of the terms above the band, a power of two.
CELLS = 1 << 16
#: [\s\p{Punct}]+ with each character by itself, which Java looks up in one table.
_SPLIT = "[" + "".join(f"\\x{c:02x}" for c in (*range(9, 14), *range(32, 127)) if not chr(c).isalnum()) + "]+"
_LOW = 0xFFFFFFFF


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), 0)


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms: lower-cased runs without white space and ASCII punctuation."""
    words = F.split(F.lower(text), _SPLIT)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def at_edges(kept: Column, added: Column) -> Column:
    """The terms of the runs without white space around the seam of kept and added, and at the end of both.

    No other term of both together can differ from one of the whole texts: lower case too depends on
    the letters around (a sigma) within such a run only.
    """
    tail = lambda t: F.regexp_replace(t, r"(?s)^.*\s", "")
    return terms(F.concat(tail(kept), F.regexp_extract(added, r"^\S*", 0), F.lit(" "), tail(F.concat(kept, added))))


def level(n: Column) -> Column:
    """The level that leaves about LEAST_TERMS to 4 * LEAST_TERMS of n terms."""
    return F.floor(F.log(F.greatest(n / LEAST_TERMS, F.lit(1.0))) / F.log(F.lit(4.0))).cast("int")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _members(terms_: Column, at: Column) -> Column:
    """64 bits a term, each set with a chance of one half a draw. Each draw leaves a term a quarter of the subsets: DRAWS of them make SPARSE, and each level takes one more."""
    first = lambda t: reduce(Column.bitwiseAND, [F.xxhash64(t, F.lit(i)) for i in range(1, DRAWS + 1)])
    more = lambda t: F.aggregate(F.sequence(F.lit(DRAWS + 1), at + DRAWS), first(t), lambda m, i: m.bitwiseAND(F.xxhash64(t, i)))
    return F.when(at == 0, F.transform(terms_, first)).otherwise(F.transform(terms_, more))


def _both(bits: Column) -> Column:
    """The subsets that both halves agree on, in the upper half: one in SPARSE at level 0."""
    return bits.bitwiseAND(F.shiftleft(bits, 32))


def sketch(in_band: Column) -> Column:
    """struct(n, whole, terms): the number of a text's terms in the band, a hash of all of them, and those in some subset (at level 0: all).

    More terms can be added later: the level can only rise, and its subsets lie in those of the lower one.
    """

    def one(t: Column) -> Column:
        some = _let(level(F.size(t)), lambda at: F.when(at == 0, t).otherwise(_let(_members(t, at), lambda m: F.filter(t, lambda _, i: _both(F.get(m, i)) != 0))))
        return F.struct(F.size(t).alias("n"), whole_hash(t).alias("whole"), some.alias("terms"))

    return _let(in_band, one)


def whole_hash(in_band: Column) -> Column:
    return F.aggregate(in_band, F.lit(0).cast("long"), lambda m, t: m.bitwiseXOR(F.xxhash64(t, F.lit(102))))


def _place(code: Column) -> Column:
    return code.bitwiseAND(F.lit(_LOW)).cast("int")


def subset_hashes(sorted_terms: Column, codes: Column) -> Column:
    """One 32-bit hash per subset of the sorted terms in it; null where it has none.

    A code has a term's subsets in its upper half and the term's place in the lower one. Codes are looked through for
    each few subsets and, if they have any of those, for each of them.
    """
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(64 - SUBSETS, 64)]

    def one(some: Column, bit: Column) -> Column:
        mine = F.transform(F.filter(some, lambda c: c.bitwiseAND(bit) != 0), lambda c: F.get(sorted_terms, _place(c)))
        return _let(mine, lambda m: F.when(F.size(m) > 0, F.xxhash64(m).bitwiseAND(F.lit(_LOW))))

    def few(some: Column) -> Column:
        mine = F.filter(codes, lambda c: c.bitwiseAND(some["any"]) != 0)
        return _let(mine, lambda m: F.transform(some["bits"], lambda bit: one(m, bit)))

    sets = [bits[i : i + FEW] for i in range(0, SUBSETS, FEW)]
    return F.flatten(F.transform(F.array(*[F.struct(F.lit(sum(x)).alias("any"), F.array(*map(F.lit, x)).alias("bits")) for x in sets]), few))


def fingerprint(n: Column, whole: Column, some: Column, all_terms: Column) -> Column:
    """struct(level, a, b, c): the subset hashes of a text at its level and at the next sparser one, and the hash of the whole.

    some are those of the text's n terms in the band that are in some subset, and any others of them. A text without terms
    in the band has level -1 and the hash of all its terms, so that it is like texts with the very same terms only.
    """

    def own(at: Column) -> Column:
        def made(ts: Column, codes: Column) -> Column:
            draws = F.transform(codes, lambda c: F.xxhash64(F.get(ts, _place(c)), at + (DRAWS + 1)))
            sparser = F.zip_with(codes, draws, lambda c, m: c.bitwiseAND(_both(m).bitwiseOR(F.lit(_LOW))))
            b = _let(_drawn(sparser), lambda k: subset_hashes(ts, k))
            c = F.array(F.xxhash64(whole).bitwiseAND(F.lit(_LOW)))
            return F.struct(at.alias("level"), subset_hashes(ts, codes).alias("a"), b.alias("b"), c.alias("c"))

        def coded(ts: Column) -> Column:
            codes = F.transform(_members(ts, at), lambda m, i: _both(m).bitwiseOR(i.cast("long")))
            return _let(_drawn(codes), lambda k: made(ts, k))

        return _let(F.sort_array(some), coded)

    alone = F.struct(F.lit(-1).alias("level"), F.array(all_terms.bitwiseAND(F.lit(_LOW))).alias("a"), _none("bigint").alias("b"), _none("bigint").alias("c"))
    return F.when(n > 0, _let(level(n), own)).otherwise(alone)


def _drawn(codes: Column) -> Column:
    """The codes of terms that are in some subset."""
    return F.filter(codes, lambda c: c.bitwiseAND(F.lit(~_LOW)) != 0)


def shown(fp: Column) -> Column:
    text = lambda a: F.array_join(F.transform(a, lambda h: F.coalesce(F.lpad(F.hex(h), 8, "0"), F.lit("-"))), "")
    return F.concat_ws(":", fp["level"].cast("string"), text(fp["a"]), text(fp["b"]), text(fp["c"]))


def likeness(x: Column, y: Column) -> Column:
    """The share of equal hashes among the subsets of a common level, and the whole, that x or y has terms in.

    Levels more than one apart have nothing in common (0).
    """
    pairs = (
        F.when(x["level"] == y["level"], F.arrays_zip(F.concat(x["a"], x["b"], x["c"]).alias("p"), F.concat(y["a"], y["b"], y["c"]).alias("q")))
        .when(x["level"] == y["level"] - 1, F.arrays_zip(F.concat(x["b"], x["c"]).alias("p"), F.concat(y["a"], y["c"]).alias("q")))
        .when(x["level"] == y["level"] + 1, F.arrays_zip(F.concat(x["a"], x["c"]).alias("p"), F.concat(y["b"], y["c"]).alias("q")))
        .otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>"))
    )
    some = F.size(F.filter(pairs, lambda z: z["p"].isNotNull() | z["q"].isNotNull()))
    same = F.size(F.filter(pairs, lambda z: z["p"] == z["q"]))
    return F.when(some > 0, same / some).otherwise(F.when(x == y, 1.0).otherwise(0.0))


def _ranges(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What adds bucket, the number of its id's range, to rows: ranges have about equal numbers of documents.

    The ends come from a hashed sample of SAMPLED ids a range, at most a million in all. A
    row finds its range in two steps, each over the square root of the number of ends.
    """
    n = docs.count()
    pieces = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    every = max(1, n // (pieces * SAMPLED))
    some = docs.where("id is not null").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(every)) == 0).select(F.sort_array(F.collect_set("id")).alias("ids")) if pieces > 1 else None
    ids = some.first()["ids"] if some is not None else []
    ends = [ids[i * len(ids) // pieces] for i in range(1, pieces)] if len(ids) >= pieces else ids
    wide = max(1, int(len(ends) ** 0.5))
    table_ = docs.sparkSession.createDataFrame([(ends[wide - 1 :: wide], [ends[i : i + wide - 1] for i in range(0, len(ends) + 1, wide)])], "far array<bigint>, near array<array<bigint>>")

    def add(rows: DataFrame) -> DataFrame:
        if not ends:
            return rows.withColumn("bucket", F.lit(0))
        before = lambda a: F.size(F.filter(a, lambda c: c <= F.col("id")))
        far = F.when(F.col("id").isNull(), 0).otherwise(before(F.col("far")))
        near = F.when(F.col("id").isNull(), 0).otherwise(before(F.get("near", F.col("__far"))))
        rows = rows.crossJoin(F.broadcast(table_)).withColumn("__far", far)  # one row
        return rows.withColumn("bucket", F.col("__far") * wide + near).drop("far", "near", "__far")

    return add


def with_next(docs: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """(id, text) with next_id and next_text by ascending id; the last is followed by the first.

    rare (id, hash, rare) adds the columns rare and next_rare, null for texts that aren't in it: its
    rows go with the texts, each before the one of its id and hash.

    Ids are cut into ranges of about RANGE_ROWS rows, and each range is sorted by itself; the
    first row of each range follows the last of the range before. Equal ids are ordered by a
    hash of their text; null ids come first.
    """
    with_range = _ranges(docs)
    order = [F.col("id").asc_nulls_first(), "hash", "kind", "text"]
    rows = with_range(docs.select("id", "text", F.xxhash64("text").alias("hash"), F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("rare")))
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "hash", "text")).alias("head")).select("bucket", "head.id", "head.hash", "head.text")
    if rare is None:
        heads = heads.withColumn("rare", F.lit(None).cast("array<bigint>"))
    else:
        of = rare.select(F.col("id").alias("rare_id"), F.col("hash").alias("rare_hash"), "rare")
        heads = heads.join(of, F.col("id").eqNullSafe(F.col("rare_id")) & (F.col("hash") == F.col("rare_hash")), "left")
    heads = stored(heads.select("bucket", F.col("id").alias("head_id"), F.col("text").alias("head_text"), F.col("rare").alias("head_rare")), "range-heads")
    following = Window.orderBy("o")
    ring = heads.select("bucket").withColumn("o", F.col("bucket"))
    ring = ring.withColumn("then", F.coalesce(F.lead("bucket").over(following), F.first("bucket").over(following))).drop("o")
    heads = ring.join(heads.withColumnRenamed("bucket", "then"), "then").drop("then")
    w = Window.partitionBy("bucket").orderBy(*order)
    if rare is not None:
        rows = rows.unionByName(with_range(rare.select("id", F.lit(None).cast("string").alias("text"), "hash", F.lit(0).alias("kind"), "rare")))
        before = F.lag(F.struct("kind", "id", "hash", "rare")).over(w)
        mine = (F.col("before.kind") == 0) & F.col("before.id").eqNullSafe(F.col("id")) & (F.col("before.hash") == F.col("hash"))
        rows = rows.withColumn("before", before).where("kind = 1").withColumn("rare", F.when(mine, F.col("before.rare"))).drop("before")
    last = F.col("after").isNull()
    out = rows.withColumn("after", F.lead(F.struct("id", "text", "rare")).over(w)).join(heads, "bucket")
    out = out.select("id", "text", F.when(last, F.col("head_id")).otherwise(F.col("after.id")).alias("next_id"), F.when(last, F.col("head_text")).otherwise(F.col("after.text")).alias("next_text"), "rare", F.when(last, F.col("head_rare")).otherwise(F.col("after.rare")).alias("next_rare"))
    return out.drop("rare", "next_rare") if rare is None else out


def counted(docs: DataFrame) -> DataFrame:
    """(term, df, id, hash): every term of (id, text), with how many documents have it and, if it is one, which."""
    # The hash is taken before the explode: beside it, Spark would hash the text again for each of its terms. A plain explode would also
    # make the terms twice, as Spark asks for their number first.
    found = docs.select("id", F.xxhash64("text").alias("hash"), terms(F.col("text")).alias("terms")).select("id", "hash", F.explode_outer("terms").alias("term")).where("term is not null")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.max("id").alias("id"), F.max("hash").alias("hash"))


def _cell(term: Column) -> Column:
    return term.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def hashed(some: DataFrame) -> DataFrame:
    """One row: the terms of some as a hash table, CELLS first terms (a term of another cell where there is none) and arrays of the others (null: none)."""
    cells = some.groupBy(_cell(F.col("term")).alias("cell")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    each = some.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left")
    first = F.coalesce(F.get("terms", F.lit(0)), F.col("cell") + F.lit(1).cast("long"))
    others = F.when(F.size("terms") > 1, F.slice("terms", F.lit(2), F.size("terms")))
    pairs = F.array_sort(F.collect_list(F.struct("cell", first.alias("first"), others.alias("others"))))
    return each.agg(pairs.alias("p")).select(F.transform("p", lambda p: p["first"]).alias("first"), F.transform("p", lambda p: p["others"]).alias("others"))


def below_top(arrays: Column, first: Column, others: Column) -> Column:
    """Arrays of terms without those in the table of hashed."""
    top = lambda t: (F.get(first, _cell(t)) == t) | F.coalesce(F.array_contains(F.get(others, _cell(t)), t), F.lit(False))
    return F.transform(arrays, lambda a: F.filter(a, lambda t: ~top(t)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the start of the next one.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A
    null text is an empty one; a text without terms of the band is like texts
    of the same terms only. Rows of one key with one text are fingerprinted once and given back as often.
    Other columns aren't read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_docs = docs.count()
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    kept, added = F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    # A term below the band is in a single document (MIN_DOCS is 2).
    most = max(MIN_DOCS, int(MOST_SHARE * n_docs))
    all_terms = stored(counted(docs), "imatch-terms")
    rare = all_terms.where(F.col("df") < MIN_DOCS).groupBy("id", "hash").agg(F.collect_list("term").alias("rare"))
    common = stored(hashed(all_terms.where(F.col("df") > most)), "imatch-common")
    base = with_next(docs, rare).withColumns({"kept": kept, "added": added, "n_chars": n.cast("long")}).withColumn("edited", F.concat("kept", "added"))
    base = base.select(
        "id", "next_id", F.xxhash64("next_text").alias("next_hash"), F.xxhash64("text").alias("hash"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        terms(F.col("text")).alias("t"), terms(F.col("edited")).alias("e"), at_edges(F.col("kept"), F.col("added")).alias("edges"), F.coalesce("rare", _none("bigint")).alias("rare"), F.coalesce("next_rare", _none("bigint")).alias("next_rare"),
    )
    # The table is read where terms are looked up, not copied to each row: each of its columns is used once, so Spark puts it in there.
    base = base.withColumns({"e_all": F.xxhash64(F.sort_array("e")), "t_all": F.xxhash64(F.sort_array("t")), "first": common.select("first").scalar(), "others": common.select("others").scalar()})
    base = base.withColumn("below", below_top(F.array("e", "t", "edges"), F.col("first"), F.col("others")))
    base = base.withColumns({"e": F.get("below", F.lit(0)), "t": F.get("below", F.lit(1)), "seam": F.array_except(F.get("below", F.lit(2)), F.get("below", F.lit(1)))})
    base = base.withColumns({"e": F.array_except("e", F.concat("seam", "rare", "next_rare")), "t": F.array_except("t", "rare")})
    base = base.select("id", "next_id", "next_hash", "hash", "n_chars", "edited_sha256", "e_all", "seam", sketch(F.col("e")).alias("e"), fingerprint(F.size("t"), whole_hash(F.col("t")), F.col("t"), F.col("t_all")).alias("fp"))
    base = stored(base, "imatch-texts").withColumn("row", F.xxhash64("id", "hash", "next_id", "next_hash"))
    seams = base.dropDuplicates(["row"]).select("row", F.explode("seam").alias("term"))
    found = seams.join(all_terms.where(F.col("df").between(MIN_DOCS, most)).select("term"), "term").groupBy("row").agg(F.collect_list("term").alias("more"))
    e, more = F.col("e"), F.coalesce("more", _none("bigint"))
    ep = fingerprint(e["n"] + F.size(more), e["whole"].bitwiseXOR(whole_hash(more)), F.concat(e["terms"], more), F.col("e_all"))
    out = base.join(found, "row", "left").select("id", "hash", "next_id", "next_hash", "n_chars", "edited_sha256", "fp", ep.alias("ep"))
    out = stored(out, "imatch-fingerprints")
    following = out.groupBy(F.col("id").alias("next_id"), F.col("hash").alias("next_hash")).agg(F.first("fp").alias("np"))
    joined = out.join(following, out.next_id.eqNullSafe(following.next_id) & (out.next_hash == following.next_hash))
    return joined.select(F.col("id").alias(key), "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("ep")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("ep")).alias("near_edited"), likeness(F.col("fp"), F.col("np")).alias("near_next"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op5_imatch": op5_imatch}
SQL: dict[str, str] = {}
