"""WARC archives with a Merkle fixity audit.

Pages are written as WARC/1.0 response records, each a gzip member of its own, into files of
the shared folder; the manifest has file, number, offset and length of every record. A
replica is audited by hashing the byte range of each record as it lies there, and as a last
leaf of each file its length and the bytes behind its last record. FANOUT neighbouring leaves
make one node, up to one root a file. Files, those of the manifest and any others that lie in
the folder, are dealt into slots by a hash of their name; slots are the ordered leaves of the
tree above, which ends in one root of the replica. Replica roots are compared first, and only
the children of nodes that differ are looked at further, so equal parts of two replicas cost
one comparison, and a file too many or too few doesn't shift the others.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm.shared import batched, parts, shared_dir, stored, table

FANOUT = 16
FILE_BYTES = 4 << 20
#: Bytes read at once.
PIECE = 1 << 20
RECORDS = "array<struct<number:bigint,id:bigint,offset:bigint,length:bigint>>"
MANIFEST = "file string, number long, id long, offset long, length long"


def record(key: int | None, url: str | None, body: bytes) -> bytes:
    """One response record: version line, headers, blank line, block, two line ends."""
    head = [
        "WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>", f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def block(raw: bytes) -> bytes:
    """The block of a record; ValueError if it isn't whole."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    sizes = [int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not head.startswith(b"WARC/") or not gap or not sizes or len(rest) < sizes[0]:
        raise ValueError("not a whole WARC record")
    return rest[: sizes[0]]


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """The manifest, stored: one row per row of pages, whose records now lie in the folder out.

    Pages are spread by a hash of all three columns and ordered by key within a file. A null html
    is an empty block; a null key or url is written as none; a very long page is one record.
    Repeated rows are records of their own. An empty table makes no file and an empty
    manifest. Other columns aren't read. A task that runs again writes the same bytes under
    another name and then moves them to the file's name.
    """
    n = parts(pages, file_bytes)
    pages = batched(pages).select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    pages = pages.repartition(n, F.xxhash64("id", "url", F.crc32(F.col("html").cast("binary")))).sortWithinPartitions("id", "url", "html")

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = _place(out)
        fs.create_dir(folder, recursive=True)
        file, offset, number = f"part-{task.partitionId():06d}.warc.gz", 0, 0
        trying = f"{folder}/.{file}.{task.taskAttemptId()}"
        rows: dict[str, list] = {c: [] for c in ("file", "number", "id", "offset", "length")}
        with fs.open_output_stream(trying, compression=None) as to:
            for b in bs:
                for k, u, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                    raw = _gzip(record(k, u, (h or "").encode()))
                    to.write(raw)
                    for c, v in zip(rows, (file, number, k, offset, len(raw))):
                        rows[c].append(v)
                    offset, number = offset + len(raw), number + 1
        if number:
            fs.move(trying, f"{folder}/{file}")
        else:
            fs.delete_file(trying)
        yield pa.RecordBatch.from_arrays([pa.array(rows["file"], pa.string())] + [pa.array(rows[c], pa.int64()) for c in list(rows)[1:]], list(rows))

    return stored(pages.mapInArrow(run, MANIFEST), "warc-manifest")


def _files(manifest: DataFrame) -> DataFrame:
    """(file, records) with the records of one file, ordered; a file has a bounded number of bytes."""
    return manifest.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("number", "id", "offset", "length"))).alias("records"))


def _spread(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files over as many tasks as their records are worth: a file's records are read by one task."""
    return files.repartition(parts(manifest, 64 << 10), "file")


def replicate(manifest: DataFrame, source: str, target: str, decayed: list | None = None) -> None:
    """Copy the files to another folder. decayed: (modulus, rest) of record ids that lose a bit on the way, for drills and tests."""
    rows = _spread(_files(manifest), manifest)

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, src = _place(source)
        to, dst = _place(target)
        to.create_dir(dst, recursive=True)
        for b in bs:
            for file, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trying = f"{dst}/.{file}.{TaskContext.get().taskAttemptId()}"
                with fs.open_input_file(f"{src}/{file}") as f, to.open_output_stream(trying, compression=None) as g:
                    for r in records:  # records lie one behind the other, in order
                        raw = bytearray(f.read(r["length"]))
                        if decayed and raw and r["id"] is not None and r["id"] % decayed[0] == decayed[1]:
                            raw[len(raw) // 2] ^= 0x10
                        g.write(bytes(raw))
                    while raw := f.read(PIECE):
                        g.write(raw)
                to.move(trying, f"{dst}/{file}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["file"])

    rows.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files that lie in a replica's folder now (no hidden ones); none if there is no such folder."""
    fs, place = _place(folder)
    if fs.get_file_info(place).type != pafs.FileType.Directory:
        return spark.createDataFrame([], "file string, bytes long")
    uri = folder if "://" in folder else f"file://{place}"
    found = spark.read.format("binaryFile").load(uri)  # only names and lengths are read
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"))


def leaves(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, number, id, offset, length, hash) of each record's byte range in a replica, and behind each file's records its tail.

    A range that isn't there has the hash of what is. The tail's hash covers the file's length
    and all bytes behind the last record; a file that isn't in the manifest is all tail, and
    a missing one has a tail that says so. Bytes are read piece by piece, never a whole file.
    """
    rows = _files(manifest).join(listing(manifest.sparkSession, folder), "file", "full").select("file", F.coalesce("records", F.array().cast(RECORDS)).alias("records"), "bytes")
    rows = _spread(rows, manifest)
    names = ["file", "number", "id", "offset", "length", "hash"]

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _place(folder)
        for b in bs:
            for file, records, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                hashes, last = [], max([r["offset"] + r["length"] for r in records], default=0)
                tail = hashlib.sha256(f"{size}:".encode())
                if size is None:
                    hashes = [hashlib.sha256(b"").hexdigest()] * len(records)
                else:
                    with fs.open_input_file(f"{place}/{file}") as f:
                        for r in records:
                            hashes.append(_range_hash(f, min(r["offset"], size), r["length"]))
                        f.seek(min(last, size))
                        while raw := f.read(PIECE):
                            tail.update(raw)
                columns = [[r[c] for r in records] + [v] for c, v in (("number", len(records)), ("id", None), ("offset", last), ("length", max(0, (size or 0) - last)))]
                yield pa.RecordBatch.from_arrays([pa.array([file] * (len(records) + 1)), *[pa.array(x, pa.int64()) for x in columns], pa.array([*hashes, tail.hexdigest()])], names)

    return rows.mapInArrow(run, "file string, number long, id long, offset long, length long, hash string")


def _range_hash(f: pa.NativeFile, at: int, left: int) -> str:
    h = hashlib.sha256()
    f.seek(at)
    while left > 0 and (raw := f.read(min(left, PIECE))):
        h.update(raw)
        left -= len(raw)
    return h.hexdigest()


def _up(nodes: DataFrame, level: int, file: F.Column, number: F.Column) -> DataFrame:
    """The nodes of a level from their children: hashed in order, over the range from the first's start to the last's end."""
    some = F.sort_array(F.collect_list(F.struct("number", "file", "hash")))
    up = nodes.groupBy(file.alias("up_file"), number.alias("up")).agg(some.alias("s"), F.min("start").alias("start"), F.max("end").alias("end"))
    return up.select(F.col("up_file").alias("file"), F.lit(level).alias("level"), F.col("up").alias("number"), "start", "end", F.sha2(F.concat_ws("", F.lit(f"node {level}"), F.col("s.hash")), 256).alias("hash"))


@dataclass
class Tree:
    """The levels of a replica's tree, leaves first; levels[top] and those above are over slots of file names, slots[i] of them."""

    levels: list[DataFrame]
    top: int
    slots: int


def tree(manifest: DataFrame, folder: str, fanout: int = FANOUT) -> Tree:
    """The levels (file, level, number, start, end, hash) of a replica's tree, from the leaves to its one root.

    Below, nodes belong to a file, up to number 0 of each; above, with file "", to slots of
    file names. How many levels there are follows from the manifest alone, so replicas of one
    manifest can be compared. Without records and files all levels have no rows. Repeated
    manifest rows are repeated leaves; null ids don't matter, since leaves go by number.
    """
    own = leaves(manifest, folder).select("file", F.lit(0).alias("level"), "number", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "hash")
    levels = [stored(own, "merkle-0")]
    most, files = manifest.agg(F.max("number"), F.count_distinct("file")).first()
    most = 1 + (most or 0)  # the tail
    while most:
        levels.append(stored(_up(levels[-1], len(levels), F.col("file"), F.floor(F.col("number") / fanout).cast("long")), "merkle"))
        most //= fanout
    slots, top = 1, len(levels)
    while slots < files:
        slots *= fanout
    levels.append(stored(_up(levels[-1], top, F.lit(""), _slot(slots)), "merkle"))
    left = slots
    while left > 1:
        levels.append(stored(_up(levels[-1], len(levels), F.lit(""), F.floor(F.col("number") / fanout).cast("long")), "merkle"))
        left //= fanout
    return Tree(levels, top, slots)


def _slot(slots: int) -> F.Column:
    return F.pmod(F.xxhash64("file"), F.lit(slots)).cast("long")


def differing(a: Tree, b: Tree, fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """The leaves (file, number, hash_a, hash_b) that differ, and how many nodes were compared on each level from the root.

    The trees must be of one manifest. The roots are compared first; below, only children of
    nodes that differ. A file that one replica lacks has a null hash on its side.
    """
    compared, open_nodes, wrong = [], None, None
    for i in range(len(a.levels) - 1, -1, -1):
        x, y = a.levels[i], b.levels[i]
        if open_nodes is not None:
            parent = _slot(a.slots) if i == a.top - 1 else F.floor(F.col("number") / fanout).cast("long")
            up_file = F.col("file") if i < a.top - 1 else F.lit("")
            under = lambda n: n.withColumns({"up_file": up_file, "up": parent}).join(open_nodes, ["up_file", "up"], "left_semi").drop("up_file", "up")  # noqa: E731, B023
            x, y = under(x), under(y)
        both = x.select("file", "number", F.col("hash").alias("hash_a")).join(y.select("file", "number", F.col("hash").alias("hash_b")), ["file", "number"], "full")
        both = stored(both, "merkle-compared")
        compared.append(both.count())
        wrong = both.where("not (hash_a <=> hash_b)")
        open_nodes = wrong.select(F.col("file").alias("up_file"), F.col("number").alias("up"))
    return wrong, compared


def bodies(manifest: DataFrame, folder: str) -> DataFrame:
    """(file, number, id, body_bytes, body_sha256) of each record, read back by its offset; null where it can't be read.

    One record is in memory at a time. Null ids and repeated rows of the manifest are given back as they are.
    """
    rows = _spread(_files(manifest), manifest)

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _place(folder)
        for b in bs:
            for file, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes, hashes = [None] * len(records), [None] * len(records)
                there = fs.get_file_info(f"{place}/{file}")
                if there.type == pafs.FileType.File:
                    with fs.open_input_file(f"{place}/{file}") as f:
                        for i, r in enumerate(records):
                            f.seek(min(r["offset"], there.size))
                            try:
                                body = block(zlib.decompress(f.read(r["length"]), 31))
                            except (ValueError, zlib.error):
                                continue
                            sizes[i], hashes[i] = len(body), hashlib.sha256(body).hexdigest()
                columns = [pa.array([file] * len(records))] + [pa.array([r[c] for r in records], pa.int64()) for c in ("number", "id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], ["file", "number", "id", "body_bytes", "body_sha256"])

    return rows.mapInArrow(run, "file string, number long, id long, body_bytes long, body_sha256 string")


#: Records of the second replica that decay in the query's drill.
DECAY = [97, 13]


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: its body as read from the archive, and whether the audit located its record as decayed in the replica."""
    place = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "pages"), f"{place}/a")
    replicate(manifest, f"{place}/a", f"{place}/b", DECAY)
    wrong, _ = differing(tree(manifest, f"{place}/a"), tree(manifest, f"{place}/b"))
    wrong = wrong.select("file", "number", F.lit(True).alias("wrong"))
    out = bodies(manifest, f"{place}/a").join(wrong, ["file", "number"], "left")
    return out.select(F.col("id").alias("page_id"), "body_bytes", "body_sha256", F.coalesce("wrong", F.lit(False)).alias("decayed"))


QUERIES = {"op7_merkle_fixity": op7_merkle_fixity}
SQL = {
    "op7_merkle_fixity": f"""
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS body_bytes, sha256(coalesce(html, '')) AS body_sha256,
       coalesce(page_id % {DECAY[0]} = {DECAY[1]}, false) AS decayed
FROM pages"""
}
