"""Small corpora with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n)]


def rows(seed=1, n=40):
    """Random texts, exact and near copies, shared passages, null and empty texts, odd spaces, a long text."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = []
    for i in range(n):
        w = words(rng, rng.randint(0, 120))
        if i % 5 == 1 and texts:
            w = [x if rng.random() > 0.02 else x + "x" for x in (rng.choice(texts) or "").split(" ")]
        if i % 7 == 2:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        sep = [" ", " ", " ", "\n", "  ", "\t", "  "]
        texts.append("".join(x + rng.choice(sep) for x in w).strip(" "))
    texts += [None, "", "   ", "é", texts[3], texts[3], "".join(f"{x} " for x in words(rng, 5000)), "x" * 9000, "Über straße ÇÁ <|endoftext|> d'été's"]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def frame(spark, some):
    return spark.createDataFrame(some, DOCS)
