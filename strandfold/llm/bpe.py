"""BPE encoding and decoding of whole texts, by tree concatenation of long ones (see encoding.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandfold.llm import encoding
from strandfold.llm.shared import batched, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cores() -> int:
    """The cores that Spark gives this task (spark.task.cpus)."""
    task = TaskContext.get()
    return task.cpus() if task else 1


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, as the library encodes its whole text without special tokens added.

    A null text is an empty one and has no ids. A very long text is a tree of halves. Rows with
    equal or null keys and repeated rows stay separate rows; other columns aren't read. An
    empty table gives an empty result. path: a byte-level BPE file of the tokenizers library.
    """
    docs = batched(docs).select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoding.pieces(path, True)
        for b in bs:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s in encoding.chunks(texts):
                ids = pieces.encode(texts[s], cores())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return docs.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, exact): exact says whether the ids decode to the very text. All cases are as in encoded()."""
    docs = batched(docs).select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoding.pieces(path, True)
        for b in bs:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s in encoding.chunks(texts):
                ids = [np.frombuffer(x, dtype=np.uint32) for x in pieces.encode(texts[s], cores())]
                back = pieces.t.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                n = [len(x) for x in ids]
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(n, pa.int64()), lists, pa.array([x == y for x, y in zip(back, texts[s])])], [key, "n_tokens", "ids", "exact"])

    return docs.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, exact boolean")


def decoded(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids), special tokens written out; null ids give an empty text."""
    tokens = tokens.select(key, ids)
    kind = tokens.schema[key].dataType.simpleString()

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoding.pieces(path, True).t
        for b in bs:
            lists = [x or [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.decode_batch(lists, skip_special_tokens=False), pa.string())], [key, "text"])

    return tokens.mapInArrow(run, f"`{key}` {kind}, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so ids and texts never leave the task.

    All cases are as in encoded(); a null or empty text has the hashes of empty strings.
    """
    docs = batched(docs).select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoding.pieces(path, True)
        decimal = np.array([str(i) for i in range(pieces.t.get_vocab_size())], dtype=object)
        for b in bs:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s in encoding.chunks(texts):
                n, a, d = [], [], []
                ids = [np.frombuffer(x, dtype=np.uint32) for x in pieces.encode(texts[s], cores())]
                for x, back in zip(ids, pieces.t.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)):
                    n.append(len(x))
                    a.append(hashlib.sha256(",".join(decimal[x].tolist()).encode()).hexdigest())
                    d.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES = {"op6_tree_bpe": op6_tree_bpe}
SQL: dict[str, str] = {}
