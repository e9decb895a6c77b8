"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics of its characters, words and lines.
Each class of labelled documents gives a mean and a covariance, shrunk towards the pooled
covariance and a multiple of its diagonal; the score is the posterior probability from the difference of the two Gaussian
log-densities, whose Mahalanobis distances use Cholesky factors made once.

Statistics come from whole texts. Class moments are sums over all labelled rows, added up in
the executors; the driver sees one small matrix per task and class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from strandfold.llm import textnum
from strandfold.llm.shared import batched, stored, table

FOLDS = 5
THRESHOLD = 0.3
#: Share of the pooled covariance, and of its diagonal, in each class's covariance.
POOLED, DIAGONAL = 0.1, 0.02
NAMES = (
    "log_words", "word_length", "upper", "digits", "marks", "signs", "bars", "shouts", "high_bytes", "lines",
    "distinct_words", "same_as_last", "distinct_pairs", "distinct_lines", "ending_signs", "capital_words", "byte_entropy", "word_entropy", "top_word", "length_spread",
)


def _classes() -> np.ndarray:
    """Weights that turn 256 byte counts into counts of upper, lower, digits, marks, signs, bars, shouts, high, space, newline."""
    w = np.zeros((256, 10))
    w[ord("A") : ord("Z") + 1, 0] = 1
    w[ord("a") : ord("z") + 1, 1] = 1
    w[ord("0") : ord("9") + 1, 2] = 1
    for c, some in ((3, b".,;:'\"()-?"), (4, b"#$%&*+/<=>@[]\\^_`{}~"), (5, b"|"), (6, b"!"), (8, b" \t\n\r\x0b\x0c"), (9, b"\n")):
        w[list(some), c] = 1
    w[128:, 7] = 1
    return w


_CLASSES = _classes()
_SIGNS = _CLASSES[:, 4] + _CLASSES[:, 5] + _CLASSES[:, 6] > 0


def _entropy(counts: np.ndarray) -> float:
    p = counts / counts.sum() if len(counts) else counts
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def features(column: pa.Array) -> np.ndarray:
    """One row of len(NAMES) finite numbers per text; an empty or null text is the row of an empty document.

    Texts are taken a quarter of a megabyte at a time; a longer one costs some fifty bytes a byte for
    its words.
    """
    return np.concatenate([_features(x) for x in textnum.slices(column, 1 << 18)] or [np.zeros((0, len(NAMES)))])


def _features(column: pa.Array) -> np.ndarray:
    h, starts, ends, first, raw = textnum.words(column)
    _, offsets = textnum.batch_bytes(column)
    n = len(first) - 1
    out = np.zeros((n, len(NAMES)))
    share = lambda a, b: a / b if b else 0.0
    root = lambda a, b: np.sqrt(share(a, b))
    for i in range(n):
        a, e = first[i], first[i + 1]
        b = raw[offsets[i] : offsets[i + 1]]
        if a == e:
            continue
        counts = np.bincount(b, minlength=256)
        upper, lower, digits, marks, signs, bars, shouts, high, space, newline = counts @ _CLASSES
        full = len(b) - space
        w, length = h[a:e], ends[a:e] - starts[a:e]
        _, times = np.unique(w, return_counts=True)
        k = e - a
        pairs = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) if k > 1 else 0
        lines = textnum.lines(b)
        out[i] = (
            np.log1p(k), np.log(length.mean()), root(upper, upper + lower), root(digits, full), root(marks, full), root(signs, full), root(bars, full), root(shouts, full), root(high, full), np.log1p(newline) - np.log1p(k),
            share(len(times), k ** 0.8), root((w[1:] == w[:-1]).sum(), k), share(pairs, max(1, k - 1)), share(len(np.unique(lines)), len(lines)), root(_SIGNS[raw[ends[a:e] - 1]].sum(), k), root(((raw[starts[a:e]] >= 65) & (raw[starts[a:e]] <= 90)).sum(), k),
            _entropy(counts), _entropy(times) / np.log2(k + 1), root(times.max(), k), np.log1p(length.std()),
        )
    return out


@dataclass
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors, log determinants, log prior odds of class 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        ll = [-0.5 * (np.square((x - m) @ f.T).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(ll[1] - ll[0] + self.odds, -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
    """From the counts, sums and sums of outer products of each class; None if a class has fewer than two rows."""
    if min(counts) < 2:
        return None
    means = sums / counts[:, None]
    covs = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    common = (counts[:, None, None] * covs).sum(axis=0) / counts.sum()
    p = len(common)
    ridge = np.diag(np.maximum(np.diag(common), 1e-6))
    factors, dets = [], []
    for c in covs:
        low = np.linalg.cholesky((1 - pooled - diagonal) * c + pooled * common + diagonal * ridge)
        factors.append(np.linalg.solve(low, np.eye(p)))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), np.array(dets), float(np.log(counts[1] / counts[0])))


def _packed(x: np.ndarray) -> pa.Array:
    """Each row's numbers as one binary value."""
    wide = x.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


@F.arrow_udf(BinaryType())
def _vector(texts: pa.Array) -> pa.Array:
    return _packed(features(texts))


def vectors(docs: DataFrame, text: str) -> DataFrame:
    """docs plus __x, the features of each row's text as float64 numbers in a binary."""
    return batched(docs).withColumn("__x", _vector(F.col(text)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, len(NAMES))


def learn(rows: DataFrame) -> Discriminant | None:
    """From (x, y): moments per class and task, added up."""

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(NAMES)
        total = np.zeros((2, 1 + p + p * p))
        for b in bs:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy()
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "m"])

    parts = rows.mapInArrow(run, "y int, m array<double>")
    width = 1 + len(NAMES) + len(NAMES) ** 2
    both = {r["y"]: np.array(r["m"]) for r in parts.groupBy("y").agg(F.array(*[F.sum(F.get("m", i)) for i in range(width)]).alias("m")).collect()}
    if len(both) < 2:
        return None
    p, m = len(NAMES), np.stack([both[0], both[1]])
    return fit(m[:, 0], m[:, 1 : 1 + p], m[:, 1 + p :].reshape(2, p, p))


def prepared(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", carry: list[str] | None = None) -> tuple[DataFrame, Discriminant | None]:
    """(__id, held_out, __x, and the columns to carry) of every row, stored, and the discriminant of the labelled rows that aren't held out.

    Each text's features are computed once; what learns and scores reads them from the table.
    """
    rest = F.pmod(F.crc32(F.col(key).cast("long").cast("string").cast("binary")), F.lit(FOLDS))
    x = vectors(docs.select(F.col(key).cast("long").alias("__id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry or []], F.col(text).alias("__text")), "__text").drop("__text")
    x = stored(x, "quality-vectors")
    marks = labels.select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    return x, learn(x.where("not held_out").join(marks, "__id").select("__x", "y"))


def _scores(model: Discriminant | None):
    """A column function: the score of the features in a binary column; 0.5 without a model."""

    @F.arrow_udf(DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)))

    return score if model else lambda x: F.lit(0.5)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that score at least threshold (all, if nothing could be learned).

    Rows travel with their features in one stored table, so rows with equal or null keys are
    told apart and only the labelled rows' features are shuffled. Null and empty texts, very
    long ones, ties and empty tables are as in scored(). Clashing column names do no harm.
    """
    x, model = prepared(docs, labels, key, text, label, docs.columns)
    if model:
        x = x.where(_scores(model)(F.col("__x")) >= threshold)
    return x.select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs.

    Learns from labelled rows whose crc32 of the key as text isn't 0 modulo FOLDS. A row with a
    null key is scored, in no fold and never learned from. Null labels and keys without a
    document are left out; a key labelled twice counts twice, and so does a repeated row.
    Without two rows of each class every score is 0.5. Equal texts have equal scores; a null
    text is an empty one, and a very long one is read whole, in blocks. An empty table gives
    an empty result. Other columns aren't read.
    """
    x, model = prepared(docs, labels, key, text, label)
    score = _scores(model)(F.col("__x"))
    out = x.select(F.col("__id").alias(key), "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_shrunk_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_shrunk_qda": op3_shrunk_qda}
SQL: dict[str, str] = {}
