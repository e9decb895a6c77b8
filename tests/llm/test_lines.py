import random

import pytest
from pyspark.sql import functions as F

from strandfold.llm import lines, shared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, s, n, alphabet):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(3)
        if k == 0:
            s.insert(rng.randrange(len(s) + 1), rng.choice(alphabet))
        elif k == 1:
            s[rng.randrange(len(s))] = rng.choice(alphabet)
        else:
            del s[rng.randrange(len(s))]
    return "".join(s)


def expected(docs, edits=lines.EDITS, min_chars=lines.MIN_CHARS):
    """Brute force: what stands in each text after dedup, in key order."""
    seen, out = [], {}
    for k, text in sorted(docs):
        removed = []
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if not line.strip(" "):
                continue
            if any(line == s or (min(len(line), len(s)) >= min_chars and abs(len(line) - len(s)) <= edits and distance(line, s) <= edits) for s in seen):
                removed.append(i)
            seen.append(line)
        out[k] = removed
    return out


def corpus(seed, n, alphabet="abé "):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 45))) for _ in range(12)]
    docs = []
    for k in range(n):
        some = [mutate(rng, rng.choice(base), rng.randint(0, 4), alphabet) if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        docs.append((k, "\n".join(some)))
    return docs


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(3)
    rows = []
    while len(rows) < 400:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(6, 30)))
        b = mutate(rng, a, rng.randint(0, 4), "abé")
        if len(b) > edits and abs(len(a) - len(b)) <= edits:
            rows.append((a, b, distance(a, b)))
    got = spark.createDataFrame(rows, "a string, b string, d int").select("d", lines.bit_parallel_distance(F.col("a"), F.col("b"), edits).alias("g"), lines.surviving(F.col("a"), F.col("b"), edits).alias("s")).collect()
    trims = spark.createDataFrame([("x" * 40 + a + "é" * 30, "x" * 40 + b + "é" * 30, d) for a, b, d in rows], "a string, b string, d int")
    t = lines.trimmed(F.col("a"), F.col("b"), edits + 1)
    for r in trims.select("d", t.alias("t")).select("d", "t", lines.bit_parallel_distance(F.col("t.a"), F.col("t.b"), edits).alias("g")).collect():
        assert len(r.t.a) < 50 and ((r.g == r.d) if r.d <= edits else (r.g > edits))
    for r in got:
        assert (r.g == r.d) if r.d <= edits else (r.g > edits)
        assert r.d > edits or r.s >= 8 - edits


@pytest.mark.parametrize("seed,hot,edits", [(1, 200, 2), (2, 2, 2), (3, 1, 1)])
def test_against_brute_force(spark, seed, hot, edits):
    docs = corpus(seed, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicated(df, edits=edits, hot_rows=hot).collect()}
    want = expected(docs, edits)
    assert len(got) == len(docs) and sum(map(len, want.values())) > 20
    for k, text in docs:
        assert list(got[k].removed) == want[k]
        assert got[k].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[k])
        assert (got[k].n_lines, got[k].n_removed) == (len(text.split("\n")), len(want[k]))


def test_edges(spark):
    long = "x" * 5000
    rows = [(1, None, "u", 1), (2, "", "u", 2), (3, "same line\n\nsame line", "v", 3), (4, "same line\n" + long, "w", 4), (5, long + "y", "w", 5), (None, "same line", "w", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, first long")
    got = {r.doc_id: r for r in lines.deduplicated(df).collect()}
    assert got[1].text is None and got[1].n_lines == 0
    assert got[2].text == "" and got[2].n_lines == 1
    assert got[None].removed == [] and got[None].first == 6  # a null key is first in order
    assert got[3].removed == [0, 2] and got[3].text == ""
    assert got[4].removed == [0] and got[5].removed == [0]
    assert lines.deduplicated(df.limit(0)).count() == 0


def test_near_lines_of_documents_without_a_key(spark):
    line = "a line that is long enough to be near another"
    other = "quite some other words that nobody else has here"
    rows = [(None, line), (None, other), (1, line + "s"), (2, "mine\n" + line[2:]), (3, other + "!!!"), (4, "x" + other)]
    got = {(r.doc_id, r.n_lines): list(r.removed) for r in lines.deduplicated(spark.createDataFrame(rows[:1] + rows[2:], "doc_id long, text string")).collect()}
    assert got == {(None, 1): [], (1, 1): [0], (2, 2): [1], (3, 1): [], (4, 1): []}
    got = {r.doc_id: list(r.removed) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id > 0").collect()}
    assert got == {1: [0], 2: [1], 3: [], 4: [0]}


@pytest.mark.parametrize("role", ["index", "probe"])
def test_keys_are_compiled(spark, role):
    long = spark.createDataFrame([(1, "x" * 30, 30)], "h1 long, text string, n int")
    stages = lines._keyed(long, 2, role)._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_lines_too_many_to_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    docs = corpus(4, 60) + [(None, "a line without a key, long enough")]
    want = expected(docs[:-1])
    got = {r.doc_id: list(r.removed) for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want | {None: []}
    every = lines._lines(spark.range(4000).select("id", F.lit("some\nlines").alias("text")))
    needed = every.where("id % 20 = 0").select(F.col("id").alias("p_id"), F.col("no").alias("p_no"))
    near = lines._near_places(every, needed)
    assert near.join(needed, (F.col("id") == F.col("p_id")) & (F.col("no") == F.col("p_no"))).count() == 400
    assert near.count() < 1200  # of 8000


def test_sketches_leave_near_lines_and_few_others(spark):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcdefghijklmnopé ") for _ in range(30))
    rows = []
    for _ in range(300):
        a = line()
        rows += [(a, mutate(rng, a, 2, "abcxyzé "), True), (a, a[:10] + line()[10:], False)]
    df = spark.createDataFrame(rows, "a string, b string, near boolean")
    for s in "ab":
        df = df.withColumn(f"s{s}", lines.sketch(F.col(s))).withColumns({f"{s}_one": F.col(f"s{s}.one"), f"{s}_two": F.col(f"s{s}.two")})
    got = df.select("near", lines.alike("a_one", "b_one", "a_two", "b_two", 2).alias("alike")).collect()
    assert all(r.alike for r in got if r.near) and sum(r.alike for r in got if not r.near) < 15
