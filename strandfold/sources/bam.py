"""BAM as a Spark data source, from the public SAM/BAM specification: BGZF blocks, records, and back.

    spark.dataSource.register(BamSource); spark.read.format("bam").load(path)

A file is read in ranges of compressed bytes. BGZF blocks are entered anywhere (each begins
with its own header and length); the first record of a range is found by checking that a chain of
record headers holds together. With the
option pushdown, filters on chr, pos, flag and mapq are applied while decoding, before any string is made.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from strandfold.sources import storage

SCHEMA = "read_ord long, sample string, qname string, flag int, chr int, chr_name string, pos long, mapq int, cigar string, mate_chr int, mate_pos long, tlen long, seq string, qual binary, tags map<string,string>"
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
RANGE_BYTES, BATCH = 32 << 20, 5000
#: Content of a block.
BLOCK_BYTES = 65_280
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FIXED = [("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")]
#: Content that is decoded at once.
DECODE_BYTES = 2 << 20
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_CODES = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


# --- BGZF


def block_size(head: bytes) -> int | None:
    """Length of the BGZF block that starts with these 18 or more bytes; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def find_block(f, at: int, size: int) -> int:
    """The first block start at or behind a place: one whose length leads to another block or the end."""
    f.seek(at)
    data = f.read(3 * 65536)
    i = -1
    while (i := data.find(b"\x1f\x8b\x08\x04", i + 1)) >= 0:
        n = block_size(data[i : i + 18])
        if n and (at + i + n == size or block_size(data[i + n : i + n + 18])):
            return at + i
    return size


def blocks(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks that start in a range."""
    f.seek(start)
    at = start
    while at < end:
        head = f.read(18)
        n = block_size(head)
        if n is None:
            if head:
                raise ValueError(f"no BGZF block at byte {at}")
            return
        raw = head + f.read(n - 18)
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[skip : n - 8], -15)
        at += n


def deflate(data: bytes, level: int = 6) -> bytes:
    """One BGZF block of at most 65280 bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


# --- records


def parse_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, [(reference, length)], bytes used); IndexError or struct.error if data is too short."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    if len(data) < 12 + n:
        raise IndexError
    text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    refs = []
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(count):
        k = struct.unpack_from("<i", data, at)[0]
        name = data[at + 4 : at + 3 + k]
        refs.append((name.decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return text, refs, at


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """(text, references, place of the block with the first record, offset in it)."""
    data, ends = b"", []
    with storage.reader(path) as f:
        for at, some in blocks(f, 0, storage.size(path)):
            ends.append((len(data), at))
            data += some
            try:
                text, refs, used = parse_header(data)
            except (IndexError, struct.error):
                continue
            start, place = [e for e in ends if e[0] <= used][-1]
            return text, refs, place, used - start
    raise ValueError(f"{path} ends in its header")


def plausible(data: bytes, at: int, n_refs: int, records: int = 4) -> bool | None:
    """Whether records seem to start here; None if data ends before that can be told."""
    for k in range(records):
        if at == len(data) and k:
            return True
        if at + 36 > len(data):
            return None
        size, ref, pos, name, _, _, ops, flag, seq, mref, mpos = struct.unpack_from("<iiiBBHHHiii", data, at)
        least = 32 + name + 4 * ops + (seq + 1) // 2 + seq
        if size < least or name < 1 or seq < 0 or not -1 <= ref < n_refs or not -1 <= mref < n_refs or pos < -1 or mpos < -1:
            return False
        if at + 36 + name <= len(data) and data[at + 35 + name] != 0:
            return False
        at += 4 + size
        if at > len(data):
            return None if k == 0 else True
    return True


def decode_tags(raw: bytes) -> dict[str, str]:
    """All auxiliary fields as text; arrays as type,value,value."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind in _INTS:
            out[name] = str(struct.unpack_from(_INTS[kind], raw, at)[0])
            at += struct.calcsize(_INTS[kind])
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            vals = struct.unpack_from(f"<{n}{_INTS[sub][1]}", raw, at + 5)
            out[name] = ",".join([sub, *map(str, vals)])
            at += 5 + n * struct.calcsize(_INTS[sub])
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


def _encode_cigar(cigar: str | None) -> tuple[bytes, int]:
    """The operations as numbers, and how many reference bases they span."""
    ops, n, span = [], 0, 0
    for c in (cigar or "").replace("*", ""):
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            span += n if c in "MDN=X" else 0
            n = 0
    return struct.pack(f"<{len(ops)}I", *ops), span


def _encode_tags(tags: dict[str, str]) -> bytes:
    """Whole numbers as i, everything else as text (Z)."""
    out = b""
    for k, v in tags.items():
        whole = v.lstrip("-").isdigit() and (v == "0" or not v.lstrip("-").startswith("0")) and abs(int(v)) < 2**31 and k not in ("BX", "UG")
        out += k.encode() + (b"i" + struct.pack("<i", int(v)) if whole else b"Z" + v.encode() + b"\0")
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the length of each value; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return raw[at[0] : at[-1]] if len(column) else raw[:0], np.diff(at)


def _bins(beg: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The index bin of each interval."""
    out, last = np.zeros(len(beg), np.int64), np.maximum(end - 1, beg)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(beg >> shift == last >> shift, offset + (beg >> shift), out)
    return np.where(beg < 0, 4680, out)


class Encoder:
    """Arrow batches as records, by whole columns; chr_name decides the reference where it is given."""

    HEAD = np.dtype([("size", "<i4"), *FIXED])

    def __init__(self, refs: dict[str, int]) -> None:
        self.refs, self.cigars = refs, {}

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The records' bytes, and ref, pos, end and length of each for the index."""
        n, have = b.num_rows, b.schema.names
        column = lambda c: b.column(have.index(c)) if c in have else pa.nulls(n)
        number = lambda c, none: np.array([none if x is None else x for x in column(c).to_pylist()], np.int64) if column(c).null_count or c not in have else column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        names = [(x or "*").encode() + b"\0" for x in column("qname").to_pylist()]
        cigars = []
        for c in column("cigar").to_pylist():
            if c not in self.cigars:
                if len(self.cigars) > 100_000:
                    self.cigars.clear()
                self.cigars[c] = _encode_cigar(c)
            cigars.append(self.cigars[c])
        seq, l_seq = _flat(column("seq").cast(pa.string()))
        qual_column = column("qual").cast(pa.binary())
        qual, l_qual = _flat(qual_column)
        none = np.asarray(qual_column.is_null())
        if (l_qual != np.where(none, 0, l_seq)).any():
            at = int(np.flatnonzero(l_qual != np.where(none, 0, l_seq))[0])
            raise ValueError(f"sequence and qualities of {column('qname')[at].as_py()} differ in length")
        made: dict[tuple, bytes] = {}
        tags = []
        for t, x, g in zip(column("tags").to_pylist(), column("bx").to_pylist(), column("ug").to_pylist()):
            pairs = t.items() if isinstance(t, dict) else t or ()
            key = (tuple(map(tuple, pairs)), x, g)
            if key not in made:
                made[key] = _encode_tags({**dict(key[0]), **{k: v for k, v in (("BX", x), ("UG", g)) if v is not None}})
            tags.append(made[key])
        ref = number("chr", -1)
        if "chr_name" in have:
            ref = np.array([r if x is None else self.refs.get(x, -1) for r, x in zip(ref.tolist(), column("chr_name").to_pylist())], np.int64)
        pos, span = number("pos", -1), np.array([max(1, c[1]) for c in cigars], np.int64)
        ops = [c[0] for c in cigars]
        l_name, l_ops, l_tags = (np.array([len(x) for x in some], np.int64) for some in (names, ops, tags))
        size = 32 + l_name + l_ops + (l_seq + 1) // 2 + l_seq + l_tags
        h = np.zeros(n, self.HEAD)
        for c, v in (("size", size), ("ref", ref), ("pos", pos), ("l_name", l_name), ("mapq", number("mapq", 0)), ("bin", _bins(pos, pos + span)), ("n_ops", l_ops // 4), ("flag", number("flag", 0)), ("l_seq", l_seq), ("mref", number("mate_chr", -1)), ("mpos", number("mate_pos", -1)), ("tlen", number("tlen", 0))):
            h[c] = v
        out = np.zeros(int((size + 4).sum()), np.uint8)
        at = np.cumsum(size + 4) - size - 4
        out[at[:, None] + np.arange(36)] = h.view(np.uint8).reshape(n, 36)
        at = at + 36
        for some, length in ((names, l_name), (ops, l_ops)):
            out[_runs(at, length)] = np.frombuffer(b"".join(some), np.uint8)
            at = at + length
        nibble, code = _runs(2 * at, l_seq), _CODES[seq]
        high = nibble & 1 == 0
        out[nibble[high] >> 1] = code[high] << 4
        out[nibble[~high] >> 1] |= code[~high]
        at = at + (l_seq + 1) // 2
        out[_runs(at[none], l_seq[none])] = 255
        out[_runs(at[~none], l_seq[~none])] = qual
        out[_runs(at + l_seq, l_tags)] = np.frombuffer(b"".join(tags), np.uint8)
        return out, {"ref": ref, "pos": pos, "end": pos + span, "size": size + 4}


# --- index


class Index:
    """A BAI index of coordinate-sorted records, as they come: chunks by bin, and the first record over each 16 kb. Of single records nothing is kept."""

    def __init__(self, n_refs: int) -> None:
        self.n_refs, self.ordered, self.unplaced = n_refs, True, 0
        self.first: tuple[int, int] | None = None
        self.last: tuple[int, int] | None = None
        self.chunks = np.zeros((0, 4), np.int64)  # ref, bin, start, stop
        self.some: list[np.ndarray] = []
        self.linear: dict[tuple[int, int], int] = {}

    def add(self, ref: np.ndarray, pos: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Records that follow each other, and the last ones, in the file."""
        if not len(ref):
            return
        key = np.where(ref < 0, self.n_refs, ref)
        first, last = (int(key[0]), int(pos[0])), (int(key[-1]), int(pos[-1]))
        same = (np.diff(key) == 0) & (key[1:] < self.n_refs)
        self.ordered = self.ordered and not (np.diff(key) < 0).any() and not (same & (np.diff(pos) < 0)).any() and self._follows(first)
        self.first, self.last = self.first or first, last
        self.unplaced += int((ref < 0).sum())
        ref, pos, end, start, stop = (x[ref >= 0] for x in (ref, pos, end, start, stop))
        if not len(ref) or not self.ordered:
            return
        bins = _bins(pos, end)
        new = np.flatnonzero(np.append(True, (np.diff(bins) != 0) | (np.diff(ref) != 0)))
        runs = np.stack([ref[new], bins[new], start[new], stop[np.append(new[1:], len(ref)) - 1]], axis=1)
        if self.some and (self.some[-1][-1, :2] == runs[0, :2]).all():  # a chunk goes on while records of one bin follow each other
            self.some[-1][-1, 3] = runs[0, 3]
            runs = runs[1:]
        if len(runs):
            self.some.append(runs)
        low, high = np.maximum(pos, 0) >> 14, np.maximum(end - 1, 0) >> 14
        n = high - low + 1
        over, which = np.unique(np.repeat(ref, n) << 32 | _runs(low, n), return_index=True)
        for w, i in zip(over.tolist(), np.repeat(start, n)[which].tolist()):
            self.linear.setdefault((w >> 32, w & 0xFFFFFFFF), i)

    def _follows(self, first: tuple[int, int]) -> bool:
        return self.last is None or first[0] > self.last[0] or (first[0] == self.last[0] and (first[0] >= self.n_refs or first[1] >= self.last[1]))

    def placed(self, virtual: Callable[[np.ndarray], np.ndarray]) -> None:
        """Places in the content become virtual offsets."""
        self.chunks, self.some = np.concatenate([self.chunks, *self.some]), []
        self.chunks[:, 2:] = virtual(self.chunks[:, 2:])
        if self.linear:
            self.linear = dict(zip(self.linear, virtual(np.array(list(self.linear.values()), np.int64)).tolist()))

    def append(self, other: Index, base: int) -> None:
        """The index of a file that is put behind this one's, at byte base."""
        if other.first is None:
            return
        self.ordered = self.ordered and other.ordered and self._follows(other.first)
        self.first, self.last = self.first or other.first, other.last
        self.unplaced += other.unplaced
        self.chunks = np.concatenate([self.chunks, other.chunks + np.array([0, 0, base << 16, base << 16])])
        for w, v in other.linear.items():
            self.linear.setdefault(w, v + (base << 16))

    def to_bytes(self) -> bytes:
        out = bytearray(b"BAI\1" + struct.pack("<i", self.n_refs))
        windows: dict[int, dict[int, int]] = {}
        for (r, w), v in self.linear.items():
            windows.setdefault(r, {})[w] = v
        for r in range(self.n_refs):
            own = self.chunks[self.chunks[:, 0] == r]
            own = own[np.argsort(own[:, 1], kind="stable")]
            numbers, at, count = np.unique(own[:, 1], return_index=True, return_counts=True)
            out += struct.pack("<i", len(numbers))
            for b, i, k in zip(numbers.tolist(), at.tolist(), count.tolist()):
                out += struct.pack("<Ii", b, k) + own[i : i + k, 2:].astype("<u8").tobytes()
            mine = windows.get(r, {})
            wide = max(mine, default=-1) + 1
            linear = np.zeros(wide, np.int64)
            for i in range(wide - 1, -1, -1):  # a window without records has the next one's offset
                linear[i] = mine[i] if i in mine else linear[i + 1]
            out += struct.pack("<i", wide) + linear.astype("<u8").tobytes()
        return bytes(out) + struct.pack("<Q", self.unplaced)


def indexed_span(data: bytes, ref: int) -> tuple[int, int] | None:
    """(first, last) virtual offsets of a reference's records by its BAI index; None if it has none."""
    at = 8
    for r in range(struct.unpack_from("<i", data, 4)[0]):
        low, high = None, None
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            _, k = struct.unpack_from("<Ii", data, at)
            chunks = np.frombuffer(data, "<u8", 2 * k, at + 8).reshape(-1, 2)
            low, high = min(int(chunks.min()), low if low is not None else 2**63), max(int(chunks.max()), high or 0)
            at += 8 + 16 * k
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
        if r == ref:
            return None if low is None else (low, high)
    return None


# --- source


class BamSource(DataSource):
    """Options: path (file, folder or pattern), rangebytes; to write: header (SAM header text with @SQ lines)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool) -> None:
        self.path, self.start, self.end, self.first = path, start, end, first


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.bounds: list[tuple[str, str, int]] = []

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in _paths(self.path):
            size = storage.size(p)
            low, high = self._wanted(p, size)
            out += [_Range(p, a, min(a + self.size, size), a == 0) for a in range(0, size, self.size) if a < high and a + self.size > low]
        return out

    def _wanted(self, path: str, size: int) -> tuple[int, int]:
        """The bytes that may hold what a filter on one reference lets through, if the file has an index beside it."""
        refs = [v for c, op, v in self.bounds if c == "chr" and op == "=="]
        if not refs or refs[0] < 0 or not storage.is_file(path + ".bai"):
            return 0, size
        with storage.reader(path + ".bai") as f:
            span = indexed_span(f.read(), refs[0])
        return (0, 0) if span is None else (span[0] >> 16, (span[1] >> 16) + 1)

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing that is wanted
            return
        _, refs, first_block, first_offset = read_header(part.path)
        sample, decoder = part.path.rpartition("/")[2], Decoder([r[0] for r in refs], self.bounds)
        for data, at, ordinals in self._records(part, len(refs), first_block, first_offset):
            for lo in range(0, len(at), BATCH):
                batch = decoder.batch(data, at[lo : lo + BATCH], ordinals[lo : lo + BATCH], sample)
                if batch.num_rows:
                    yield batch

    def _records(self, part: _Range, n_refs: int, first_block: int, first_offset: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """(bytes, where records begin in them, read_ord of each) of the records that start in blocks that start in the range.

        read_ord: block place, then offset in the block, so it grows along the file.
        """
        size = storage.size(part.path)
        with storage.reader(part.path) as f:
            start = first_block if part.start <= first_block else find_block(f, part.start, size)
            if start >= part.end:
                return
            data, marks, at = b"", [], first_offset if start == first_block else None
            gone, some = 0, []  # bytes of content dropped in front of data; blocks not yet added to it
            waiting = 0
            for place, content in chain(blocks(f, start, size), [(size, b"")]):
                marks.append((gone + len(data) + waiting, place))
                some.append(content)
                waiting += len(content)
                if waiting < DECODE_BYTES and place < part.end:
                    continue
                data, some, waiting = data + b"".join(some), [], 0
                if at is None:
                    at = next((i for i in range(len(data)) if plausible(data, i, n_refs)), None)
                    if at is None or plausible(data, at, n_refs) is None:
                        at = None
                        if place >= size:
                            return
                        continue
                found = []
                while at + 4 <= len(data):
                    n = int.from_bytes(data[at : at + 4], "little")
                    if at + 4 + n > len(data):
                        break
                    found.append(at)
                    at += 4 + n
                where = np.array(found, dtype=np.int64)
                begins, places = (np.array(x, dtype=np.int64) for x in zip(*marks))
                block = np.searchsorted(begins, where + gone, side="right") - 1
                inside = places[block] < part.end if len(where) else np.zeros(0, bool)
                where, block = where[inside], block[inside]
                if len(where):
                    yield data, where, (places[block] << 16) | (gone + where - begins[block])
                following = np.searchsorted(begins, gone + at, side="right") - 1
                if len(where) < len(found) or places[following] >= part.end:
                    return
                data, gone, at = data[at:], gone + at, 0
                marks = marks[following:]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of all runs, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _offsets(length: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))


class Decoder:
    """Records as Arrow batches: fixed fields, names, sequences and qualities by whole columns; CIGARs and tags once per distinct value."""

    HEAD = np.dtype(FIXED)
    MOST_KEPT = 100_000

    def __init__(self, names: list[str], bounds: list[tuple[str, str, int]]) -> None:
        self.names, self.bounds = pa.array([*names, None], pa.string()), bounds
        self.cigars: dict[bytes, str | None] = {}
        self.tags: dict[bytes, list] = {}

    def _each(self, data: bytes, start: np.ndarray, end: np.ndarray, known: dict, make, kind: pa.DataType) -> pa.Array:
        if len(known) > self.MOST_KEPT:
            known.clear()
        number: dict[bytes, int] = {}
        which = [number.setdefault(data[a:e], len(number)) for a, e in zip(start.tolist(), end.tolist())]
        values = []
        for raw in number:
            if raw not in known:
                known[raw] = make(raw)
            values.append(known[raw])
        return pa.array(values, kind).take(pa.array(which, pa.int32()))

    def batch(self, data: bytes, at: np.ndarray, ordinals: np.ndarray, sample: str) -> pa.RecordBatch:
        d = np.frombuffer(data, np.uint8)
        h = np.ascontiguousarray(d[at[:, None] + np.arange(4, 36)]).view(self.HEAD).ravel()
        keep = np.ones(len(at), bool)
        for c, op, v in self.bounds:
            x = h["ref" if c == "chr" else c].astype(np.int64)
            keep &= x == v if op == "==" else x > v if op == ">" else x >= v if op == ">=" else x < v if op == "<" else x <= v
        at, ordinals, h = at[keep], ordinals[keep], h[keep]
        n, i8 = len(at), lambda c: h[c].astype(np.int64)
        size = np.ascontiguousarray(d[at[:, None] + np.arange(4)]).view("<i4").ravel().astype(np.int64) if n else np.zeros(0, np.int64)
        name = at + 36
        ops = name + i8("l_name")
        seq = ops + 4 * i8("n_ops")
        l_seq = i8("l_seq")
        qual = seq + (l_seq + 1) // 2
        tags, end = qual + l_seq, at + 4 + size
        raw = d[_runs(name, i8("l_name") - 1)]
        if (raw >= 128).any():
            names = pa.array([data[a : a + k - 1].decode("latin-1") for a, k in zip(name.tolist(), h["l_name"].tolist())], pa.string())
        else:
            names = pa.StringArray.from_buffers(n, _offsets(i8("l_name") - 1), pa.py_buffer(raw))
        nibble = _runs(2 * seq, l_seq)
        pair = d[nibble >> 1]
        letters = _LETTERS[np.where(nibble & 1, pair & 15, pair >> 4)]
        ref = h["ref"].astype(np.int32)
        arrays = [
            pa.array(ordinals, pa.int64()), pa.array([sample] * n, pa.string()), names, pa.array(h["flag"].astype(np.int32)), pa.array(ref), self.names.take(pa.array(np.where(ref >= 0, ref, len(self.names) - 1), pa.int32())),
            pa.array(i8("pos")), pa.array(h["mapq"].astype(np.int32)), self._each(data, ops, seq, self.cigars, _cigar, pa.string()), pa.array(h["mref"].astype(np.int32)), pa.array(i8("mpos")), pa.array(i8("tlen")),
            pa.StringArray.from_buffers(n, _offsets(l_seq), pa.py_buffer(letters)), pa.BinaryArray.from_buffers(pa.binary(), n, [None, _offsets(l_seq), pa.py_buffer(d[_runs(qual, l_seq)])]),
            self._each(data, tags, end, self.tags, lambda raw: list(decode_tags(raw).items()), pa.map_(pa.string(), pa.string())),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _cigar(raw: bytes) -> str | None:
    return "".join([f"{o >> 4}{OPS[o & 15]}" for o in struct.unpack(f"<{len(raw) // 4}I", raw)]) or None


class _PushReader(_Reader):
    """Takes filters on numbers of the record's head; Spark allows that only with spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in names and f.attribute in (("chr",), ("pos",), ("flag",), ("mapq",)) and isinstance(f.value, int):
                self.bounds.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f


_ARROW = pa.schema([
    ("read_ord", pa.int64()), ("sample", pa.string()), ("qname", pa.string()), ("flag", pa.int32()), ("chr", pa.int32()), ("chr_name", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()),
    ("cigar", pa.string()), ("mate_chr", pa.int32()), ("mate_pos", pa.int64()), ("tlen", pa.int64()), ("seq", pa.string()), ("qual", pa.binary()), ("tags", pa.map_(pa.string(), pa.string())),
])


def _paths(path: str) -> list[str]:
    return storage.find(path, lambda f: f.endswith(".bam"))


# --- sink


class _Message(WriterCommitMessage):
    def __init__(self, trying: str | None, final: str | None, index: Index | None = None) -> None:
        self.trying, self.final, self.index = trying, final, index


class _Writer(DataSourceArrowWriter):
    """One BAM a partition, with an index beside it if it is in coordinate order; files appear under their names only when all tasks are done.

    With onefile the partitions' records are compressed by the tasks and put behind each other when all are done.
    """

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.header, self.one = options["path"], options.get("header", ""), options.get("onefile") == "true"
        if storage.is_dir(self.path) and (old := storage.files(self.path)):
            if not overwrite:
                raise FileExistsError(self.path)
            for f in old:
                if f.endswith((".bam", ".bai")):
                    storage.remove(f)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        final = storage.join(self.path, f"part-{task.partitionId():05d}.bam")
        trying = storage.join(self.path, f".{task.partitionId():05d}-{task.taskAttemptId()}")
        refs = header_references(self.header)
        encoder = Encoder({name: i for i, (name, _) in enumerate(refs)})
        index, head = Index(len(refs)), b"" if self.one else bytes(header_bytes(self.header, refs))
        where, made = [0], len(head)
        with storage.writer(trying) as f:
            buffer = bytearray(head)

            def put(last: bool) -> None:
                lo = 0
                while len(buffer) - lo > (0 if last else BLOCK_BYTES):
                    where.append(where[-1] + f.write(deflate(bytes(buffer[lo : lo + BLOCK_BYTES]))))
                    lo += BLOCK_BYTES
                del buffer[:lo]

            for b in batches:
                for lo in range(0, b.num_rows, BATCH):
                    raw, own = encoder.batch(b.slice(lo, BATCH))
                    buffer += raw.tobytes()
                    ends = made + np.cumsum(own["size"])
                    index.add(own["ref"], own["pos"], own["end"], ends - own["size"], ends)
                    made += len(raw)
                    put(False)
            put(True)
            if not self.one:
                f.write(EOF)
        if index.first is None and (self.one or task.partitionId() > 0):
            storage.remove(trying)
            return _Message(None, None)
        places = np.array(where, np.int64)
        index.placed(lambda c: (places[c // BLOCK_BYTES] << 16) | c % BLOCK_BYTES)
        if index.ordered and not self.one:
            _put(trying + ".bai", index.to_bytes())
        return _Message(trying, final, index)

    def commit(self, messages) -> None:
        done = [m for m in messages if m and m.trying]
        if self.one:
            done = [self._joined(sorted(done, key=lambda m: m.final))]
        for m in done:
            storage.move(m.trying, m.final)
            if m.index.ordered:
                storage.move(m.trying + ".bai", m.final + ".bai")

    def _joined(self, parts: list[_Message]) -> _Message:
        refs = header_references(self.header)
        index, trying, head = Index(len(refs)), storage.join(self.path, ".joined"), bytes(header_bytes(self.header, refs))
        with storage.writer(trying) as f:
            at = sum(f.write(deflate(head[lo : lo + BLOCK_BYTES])) for lo in range(0, len(head), BLOCK_BYTES))
            for m in parts:
                index.append(m.index, at)
                with storage.reader(m.trying) as part:
                    while some := part.read(8 << 20):
                        at += f.write(some)
            f.write(EOF)
        if index.ordered:
            _put(trying + ".bai", index.to_bytes())
        for m in parts:
            storage.remove(m.trying)
        return _Message(trying, storage.join(self.path, "part-00000.bam"), index)

    def abort(self, messages) -> None:
        for m in messages:
            for f in [m.trying, m.trying + ".bai"] if m and m.trying else []:
                if storage.is_file(f):
                    storage.remove(f)


def _put(path: str, data: bytes) -> None:
    with storage.writer(path) as f:
        f.write(data)


def header_references(text: str) -> list[tuple[str, int]]:
    out = []
    for line in text.split("\n"):
        if line.startswith("@SQ"):
            f = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            out.append((f["SN"], int(f["LN"])))
    return out


def header_bytes(text: str, refs: list[tuple[str, int]]) -> bytearray:
    raw = text.encode()
    out = bytearray(b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs)))
    for name, n in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    return out


def read_bam(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads of a file, folder or pattern; filters on chr, pos, flag and mapq are applied while decoding."""
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bam").options(pushdown="true", **options).load(path)


def references(spark: SparkSession, path: str) -> DataFrame:
    """(chr, chr_name, length) of the references in a file's header."""
    rows = [(i, name, n) for i, (name, n) in enumerate(read_header(_paths(path)[0])[1])]
    return spark.createDataFrame(rows, "chr int, chr_name string, length long")


def write_bam(reads: DataFrame, path: str, header: str, ordered: bool = True, files: int | None = None) -> None:
    """A folder of BAM files in coordinate order; reads without a reference come last. files=1 makes one file, which all tasks' records are put into."""
    reads.sparkSession.dataSource.register(BamSource)
    if ordered:
        keys = [F.when(F.col("chr") >= 0, F.col("chr")).otherwise(2**31 - 1), F.col("pos"), F.col("read_ord")]
        reads = reads.repartitionByRange(*([files] if files and files > 1 else []), *keys).sortWithinPartitions(*keys)
    reads.write.format("bam").option("header", header).option("onefile", str(ordered and files == 1).lower()).mode("append").save(path)
