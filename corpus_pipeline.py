"""From raw documents to token ids: five stages, each on all that the one before kept.

Between stages stands a Parquet table in the folder that all executors share, so a lost
executor costs at most the tasks of one stage. Each stage but the last returns the columns of
documents; decisions are made on keys, and only sets of keys whose counted size is small are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm import bpe, decontam, lines, quality, setsketch
from strandfold.llm.shared import small, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: words a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80


def _keyed(docs: DataFrame) -> DataFrame:
    """docs plus __key, which follows from the whole row's id and text, so rows without an id have keys, too, and only equal rows share one."""
    return docs.withColumn("__key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant doesn't reject.

    Null and empty texts score as empty documents, very long ones by all their words; rows with
    equal or no ids and repeated rows are judged each by its text. An empty table stays
    empty; without labels of both classes all stay. Columns besides those of documents are dropped.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand, but for two edits, earlier in the corpus.

    A null text stays null, an empty one empty, and n_chars follows the text where lines
    went; very long lines are compared whole. Rows with one id (or none) lose the lines of
    any of them; of repeated rows all lose the same. An empty table stays empty.
    """
    out = lines.deduplicated(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near duplicates.

    Null and empty texts are in no group and stay; very long ones are compared whole. Rows
    without an id stay; rows with one id stay or go together, and so do repeated rows. An
    empty table stays empty.
    """
    groups = stored(setsketch.near_duplicates(docs, SHINGLE, PERCENT), "near-duplicates")
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Each row is judged by its own text, whether it has an id, shares it or is repeated. Null
    and empty texts hold nothing and stay; very long ones are searched whole. An empty table
    stays empty, and an empty benchmark lets all stay.
    """
    docs = _keyed(docs)
    found = stored(decontam.leaks(docs, table(spark, sf_dir, "benchmark"), "__key").select("__key").distinct(), "leaks")
    return docs.join(small(found), "__key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): the token ids, and whether they decode to the very text.

    A row each, whatever its id; a null text is an empty one, and a very long one a tree of
    halves. An empty table gives an empty result.
    """
    return bpe.tokenised(docs, bpe.tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality", quality_filter), ("lines", line_dedup), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("encoding", encode)]

#: The discriminant's covariances and the tokenizer can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
