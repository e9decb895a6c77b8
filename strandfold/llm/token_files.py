"""Token ids as ORC: documents in ascending key order, one part per range of keys.

Spark's ORC writer stores the ids run-length encoded (version 2: short repeats, direct,
patched base or delta, chosen per 512 values), with a row index each ROW_STRIDE rows and a
Bloom filter on the key, in stripes of STRIPE_BYTES. Readers take stripes in parallel, and
skip files, stripes and row groups by their minima, maxima and Bloom filters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold.llm import encoding, textnum
from strandfold.llm.bpe import tokenizer_file
from strandfold.llm.shared import batched, parts, shared_dir, stored, table

STRIPE_BYTES = 4 << 20
ROW_STRIDE = 1000
END_ID = 2


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", part_bytes: int = 12 << 20) -> None:
    """Encode every whole text (null: empty), append end_id, write (key, part, at, ids) to the folder out.

    A part is one range of keys, written by one task; at counts its rows from 0. The order of
    documents is that of (part, at), whatever the files are called: by key, rows with equal
    keys by a hash of their text (they may go to more than one part, so no key is too big
    for a task), null keys first. A very long text is one row, encoded whole. Other columns
    aren't read. An empty table gives an empty folder that reads as no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = batched(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = encoding.word_table(path), TaskContext.get().partitionId(), 0
        for b in bs:
            lo = 0
            for texts in textnum.slices(b.column(1)):
                n = len(texts)
                ids, offsets = words.encode(texts, end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns = [b.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "ids"])
                lo, at = lo + n, at + n

    ranged = docs.repartitionByRange(parts(docs, part_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    tokens = ranged.mapInArrow(run, f"doc_id {kind}, part int, at long, ids array<int>")
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    tokens.write.options(**options).orc(out)


def read_tokens(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, part, at, ids) of a written folder; a filter on doc_id is pushed to the files' indexes and Bloom filters."""
    return spark.read.schema(f"doc_id {kind}, part int, at long, ids array<int>").orc(out)


def token_index(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, all from the files read back.

    start counts the ids before the document in the order of (part, at): a running sum inside
    each part plus the sum of the parts before it. Null, equal and repeated keys keep the
    places that they were written to. An empty folder gives an empty result.
    """

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bs:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            n = np.diff(at).astype(np.int64)
            crc = [zlib.crc32(flat[a:e]) for a, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = batched(read_tokens(spark, out, kind)).mapInArrow(run, f"doc_id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    rows = stored(rows, "token-counts")  # used twice; the files are read once
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("within", within).join(totals, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_file("word_bpe_49k.json"))
    return token_index(spark, out)


QUERIES = {"op9_orc_tokens": op9_orc_tokens}
SQL: dict[str, str] = {}
