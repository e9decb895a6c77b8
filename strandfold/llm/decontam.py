"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A document leaks an item if WINDOW consecutive words of both agree in all but a fifth of the
places (two of thirteen); of an item with fewer words, the whole item. Shorter agreement,
such as a common phrase, is no leak.

A seed hashes the words of a span and leaves out the places that its mask ignores. Places are
dealt into e + 2 groups, and there is a mask for each e groups: e substitutions lie in at most
e groups, so some mask ignores them all and its hash is equal on both sides. Every item has
seeds at every place; a document only at every STEP-th, since each window of WINDOW words
holds a whole span at such a place. Around each hit the windows are compared word by word.

All items, of whatever lengths, are looked for in one pass. An index row is a seed with the few
words around its place; places with the same words, as in questions made from one template,
are one row, which stands for all their items until the documents' hits are known. The index
is broadcast in blocks of at most SEED_ROWS rows of at most a few dozen words; if that would
take more than MOST_BLOCKS passes, documents' seeds are shuffled to it instead.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm.shared import small, stored, table

WINDOW, STEP = 13, 4
TOLERANCE = 0.2
#: Items of fewer words aren't looked for: any document may hold them by chance.
SHORTEST = 5
#: A broadcast block of the index: rows of at most WINDOW + STEP words, some 250 bytes each.
SEED_ROWS, MOST_BLOCKS = 250_000, 4
_SPLIT = r"[\s\p{Punct}]+"


def tokens(text: Column) -> Column:
    """Hashes of the words in order: lower-cased runs without white space and ASCII punctuation."""
    return F.transform(F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w))


def masks(span: int, errors: int) -> list[list[int]]:
    """The places that each mask looks at."""
    groups = errors + 2 if errors else 1
    return [[i for i in range(span) if i % groups not in some] for some in combinations(range(groups), errors)]


def _classes(widths: list[int], tolerance: float, window: int) -> list[tuple[int, int, int, int]]:
    """(width, errors, step, span) for each width of window to be looked for."""
    out = []
    for w in sorted(widths):
        step = STEP if w == window and w > 2 * STEP else 1
        out.append((w, int(tolerance * w + 1e-9), step, w - step + 1))
    return out


_AT = 1 << 40


def _places(n: Column, classes: list[tuple[int, int, int, int]], every: bool) -> Column:
    """Where spans of each class start, at each place (every) or each step-th: place + _AT * width, as numbers."""
    none = F.array().cast("array<bigint>")
    each = [F.when(n >= span, F.sequence(F.lit(w * _AT), F.lit(w * _AT) + (n - span), F.lit(1 if every else step).cast("long"))).otherwise(none) for w, _, step, span in classes]
    return F.concat(*each) if len(each) > 1 else each[0]


def _seeds(words: Column, w: Column, at: Column, classes: list[tuple[int, int, int, int]]) -> Column:
    """The hashes of the span at a place under each mask of its class."""
    out = F.array().cast("array<bigint>")
    for width, errors, _, span in classes:
        some = F.array(*[F.xxhash64(F.lit(width * 64 + m), *[F.get(words, at + i) for i in places]) for m, places in enumerate(masks(span, errors))])
        out = some if len(classes) == 1 else F.when(w == width, some).otherwise(out)
    return out


def _seeded(df: DataFrame, words: str, n: str, classes: list[tuple[int, int, int, int]], every: bool) -> DataFrame:
    """df with w, at and seed of every span and mask: no array of all seeds of a text is ever built."""
    df = df.withColumn("__p", F.explode(_places(F.col(n), classes, every)))
    df = df.withColumns({"w": F.floor(F.col("__p") / _AT).cast("int"), "at": F.pmod("__p", F.lit(_AT)).cast("int")}).drop("__p")
    return df.withColumn("seed", F.explode(_seeds(F.col(words), F.col("w"), F.col("at"), classes)))


def _overlap(d: Column, dn: Column, dat: Column, t: Column, tn: Column, tat: Column, window: int, step: int, errors: int) -> Column:
    """The starts in the document, null where not, of the windows around the hit that have at most errors substitutions."""
    out = []
    for j in range(step):
        wrong = F.lit(0)
        for i in range(window):
            wrong = wrong + (F.get(d, dat + (i - j)) != F.get(t, tat + (i - j))).cast("int")
        inside = (dat >= j) & (tat >= j) & (dat - j + window <= dn) & (tat - j + window <= tn)
        out.append(F.when(inside & (wrong <= errors), dat - j))
    return F.array(*out)


def _around(words: Column, n: Column, at: Column, span: Column, step: Column) -> Column:
    """struct(words, lead): the span at a place with up to step - 1 words on either side, and how many of them are in front."""
    lead = F.least(at, step - 1)
    return F.struct(F.slice(words, at - lead + 1, lead + span + F.least(n - at - span, step - 1)).alias("a"), lead.alias("lead"))


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, tolerance: float = TOLERANCE, shortest: int = SHORTEST,
    seed_rows: int = SEED_ROWS, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """(key, item, windows, first_word, last_word): one row per document and item it leaks.

    windows counts the places in the document where a window agrees with one of the item;
    first_word and last_word bound them, counted in words from 0. Null and
    empty texts leak nothing, and neither do items of fewer than shortest words. Very long
    texts are searched whole. Rows with equal keys count as one document, null keys as one,
    too; repeated items give a row each. Empty tables give an empty result. Other columns
    aren't read.
    """
    none = docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, windows long, first_word int, last_word int")
    items = items.select(F.col(item).alias("item"), tokens(F.coalesce(F.col(item_text), F.lit(""))).alias("t"))
    items = stored(items.withColumn("tn", F.size("t")).where(F.col("tn") >= max(1, shortest)).withColumn("w", F.least(F.col("tn"), F.lit(window))), "benchmark-words")
    classes = _classes([r["w"] for r in items.select("w").distinct().collect()], tolerance, window)  # at most `window` values
    if not classes:
        return none
    of = lambda k: F.create_map(*[F.lit(x) for c in classes for x in (c[0], c[k])])[F.col("w")]
    # an item has seeds of its own class only
    own = [_seeded(items.where(F.col("w") == c[0]).drop("w"), "t", "tn", [c], True) for c in classes]
    index = own[0]
    for x in own[1:]:
        index = index.union(x)
    index = index.select("item", "w", "seed", _around(F.col("t"), F.col("tn"), F.col("at"), of(3), of(2)).alias("x"))
    index = stored(index.select("item", "seed", "w", "x.a", "x.lead", F.xxhash64("w", "x.lead", "x.a").alias("place")), "benchmark-seeds")
    places = stored(index.select("place", "item").distinct(), "benchmark-places")
    index = stored(index.select("seed", "w", "a", "lead", "place").distinct(), "benchmark-index")
    docs = docs.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("d")).withColumn("dn", F.size("d"))
    probes = _seeded(docs, "d", "dn", classes, False)
    blocks = max(1, -(-index.count() // seed_rows))
    if blocks <= most_blocks:
        hits = [probes.drop("w").join(F.broadcast(index.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b) if blocks > 1 else index), "seed") for b in range(blocks)]
    else:
        narrow = probes.select("id", "seed", "at", _around(F.col("d"), F.col("dn"), F.col("at"), of(3), of(2)).alias("y"))
        narrow = narrow.select("id", "seed", F.col("y.a").alias("d"), F.size("y.a").alias("dn"), F.col("y.lead").alias("at"), (F.col("at") - F.col("y.lead")).alias("base"))
        hits = [narrow.join(index, "seed")]
    found = None
    for hit in hits:
        base = F.col("base") if "base" in hit.columns else F.lit(0)
        start = F.array().cast("array<int>")
        for w, errors, step, _ in classes:
            start = F.when(F.col("w") == w, _overlap(F.col("d"), F.col("dn"), F.col("at"), F.col("a"), F.size("a"), F.col("lead"), w, step, errors)).otherwise(start)
        one = hit.select("id", "place", "w", base.alias("base"), F.explode(start).alias("start")).where("start is not null").select("id", "place", "w", (F.col("start") + F.col("base")).alias("start")).distinct()
        found = one if found is None else found.union(one)
    each = found.join(small(places), "place").select("id", "item", "start", "w").distinct()
    out = each.groupBy("id", "item").agg(F.count("*").alias("windows"), F.min("start").alias("first_word"), F.max(F.col("start") + F.col("w") - 1).alias("last_word"))
    return out.select(F.col("id").alias(key), F.col("item").alias(item), "windows", "first_word", "last_word")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_spaced_seeds": op1_spaced_seeds}
#: Words that a document and an item have in common on one diagonal, and how many of each WINDOW of them there are.
SQL = {
    "op1_spaced_seeds": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r!-/:-@\\[-`{{-~]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r!-/:-@\\[-`{{-~]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS dn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, least(len(w), {WINDOW}) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i WHERE len(w) >= {SHORTEST}),
same AS (SELECT doc_id, item_id, p - q AS diagonal, p, dn, n, size, count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS k FROM dw JOIN iw USING (word)),
starts AS (SELECT doc_id, item_id, diagonal, dn, n, size, unnest(generate_series(p - size + 1, p)) AS start FROM same WHERE k >= size - CAST(floor({TOLERANCE} * size + 1e-9) AS INT)),
good AS (SELECT doc_id, item_id, start, size FROM starts WHERE start >= 0 AND start + size <= dn AND start >= diagonal AND start - diagonal + size <= n
    GROUP BY doc_id, item_id, diagonal, start, size HAVING count(*) >= size - CAST(floor({TOLERANCE} * size + 1e-9) AS INT))
SELECT doc_id, item_id, count(DISTINCT start) AS windows, CAST(min(start) AS INT) AS first_word, CAST(max(start + size - 1) AS INT) AS last_word FROM good GROUP BY doc_id, item_id"""
}
