"""Exact tokenisation of many texts with the tokenizers library.

A text is split where its tokenizer provably never joins across (single spaces and line
ends), and the pieces, which repeat a lot, are encoded by the library once per worker
process and remembered. A long text is encoded as a tree: it is halved at any place, down to
leaves, which are encoded apart (by as many threads as Spark gives the task cores); then
growing windows of pieces around each join are split and encoded again until the first and
the last piece are the old ones on both sides. A long piece without white space is a tree of
tokens in the same way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from strandfold.llm import textnum

#: Pieces kept per worker process; the memory of a worker doesn't grow with the data.
CACHE_PIECES = 250_000
#: Pieces of more characters than this are encoded as a tree, and never kept.
LONG_PIECE = 4096
#: Texts of more characters than this are encoded as a tree, with leaves of at most so many.
LONG_TEXT, LEAF = 16_384, 8_192
#: Pieces on each side of a join that are looked at first.
WINDOW_PIECES = 4
#: Characters that one library decides are white space and another doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A plain word (letters that are stable under composition and folded one by one), perhaps after a space, then signs: two pre-tokens, whichever tokenizer.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_BYTE_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s")


def _shown() -> list[str]:
    """The character that stands for each byte in the files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


_SHOWN = _shown()


def load(path: str) -> Tokenizer:
    """A tokenizer without truncation and padding, one thread per Spark task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tree_encode(t: Tokenizer, text: str, leaf: int = LONG_PIECE) -> list[int]:
    """The tokens of one long unsplit piece (all of it one pre-token of a byte-level BPE).

    Halves are cut until they have at most leaf characters; all leaves are encoded as one
    batch. Two neighbours are joined by encoding again a window of k tokens on each side,
    k doubling until the window's first and last token are the old ones: then every pair of
    neighbouring tokens occurs in an encoding made by the library, which makes the whole
    the one encoding that the merge rules allow. If the windows reach both ends, the whole
    has been encoded at once.
    """
    if len(text) <= leaf:
        return t.encode(text, add_special_tokens=False).ids

    def cuts(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return [hi]
        mid = (lo + hi) // 2
        return cuts(lo, mid) + cuts(mid, hi)

    ends = cuts(0, len(text))
    leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
    level = []  # (text, token ids, end offset of each token within the text)
    for x, e in zip(leaves, t.encode_batch(leaves, add_special_tokens=False)):
        level.append((x, list(e.ids), [b for _, b in e.offsets]))
    while len(level) > 1:
        joined = [_join(t, *level[i], *level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = joined + level[len(joined) * 2 :]
    return level[0][1]


def _join(t: Tokenizer, ltext: str, left: list[int], lends: list[int], rtext: str, right: list[int], rends: list[int]) -> tuple[str, list[int], list[int]]:
    n, k = len(ltext), 8
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        while a > 0 and a < len(left) and lends[a - 1] == lends[a]:  # inside one character
            a -= 1
        while b < len(right) and rends[b - 1] == rends[b]:
            b += 1
        lo, hi = (lends[a - 1] if a else 0), (rends[b - 1] if b else 0)
        whole = lo == 0 and hi == len(rtext)
        e = t.encode(ltext[lo:] + rtext[:hi], add_special_tokens=False)
        ids = e.ids
        if whole or (ids and (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1])):
            ends = lends[:a] + [lo + x for _, x in e.offsets] + [n + x for x in rends[b:]]
            return ltext + rtext, left[:a] + list(ids) + right[b:], ends
        k *= 2


class Pieces:
    """Encodings of pieces as little-endian unsigned 32-bit ids, remembered up to CACHE_PIECES."""

    def __init__(self, path: str, byte_level: bool, limit: int = CACHE_PIECES) -> None:
        self.t, self.byte_level, self.limit = load(path), byte_level, limit
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        #: Joins made, and windows encoded for them, since the process began.
        self.joins = self.windows = 0

    def split(self, text: str) -> list[str]:
        """Pieces whose encodings, one after the other, are the text's.

        Byte level: its pattern matches a run of white space before it looks at what
        follows, takes at most one space into the next word, and never runs from a word
        into white space; so cutting before each word, with its one space, changes
        nothing. Word level: white space is dropped, so words are on their own.
        """
        if _ODD_SPACE.search(text):
            return [text]
        if self.byte_level and any(x in text for x in self.special):  # the library cuts at these first
            return [p for x in self.at_special.split(text) for p in ([x] if x in self.special else _BYTE_PIECE.findall(x))]
        if self.byte_level:
            return _BYTE_PIECE.findall(text)
        return text.split()

    def _long(self, piece: str) -> list[int]:
        if not self.byte_level or any(x in piece for x in self.special) or _ODD_SPACE.search(piece):
            return self.t.encode(piece, add_special_tokens=False).ids
        return [i for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(piece) for i in tree_encode(self.t, piece[a:b])]

    def _stem(self, stem: str) -> bytes:
        """A plain word is one pre-token as it stands, so the library's merges can be called on it directly."""
        if not self.byte_level:
            stem = stem.lower()
        ids = self.known.get(stem)
        if ids is None:
            shown = stem if stem.isascii() and stem[0] != " " else "".join(map(_SHOWN.__getitem__, stem.encode()))
            self.known[stem] = ids = array("I", [x.id for x in self.t.model.tokenize(shown)]).tobytes()
        return ids

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids by piece, for the pieces given and perhaps others; long pieces aren't kept in the cache."""
        known, slow, long = self.known, [], {}
        for p in pieces:
            if len(p) > LONG_PIECE:
                long[p] = array("I", self._long(p)).tobytes()
            elif m := _PLAIN.fullmatch(p):
                ids, end = self._stem(m[1]), m[2]
                if end:
                    if end not in known:
                        known[end] = array("I", self.t.encode(end, add_special_tokens=False).ids).tobytes()
                    ids += known[end]
                known[p] = ids
            else:
                slow.append(p)
        for lo in range(0, len(slow), 4096):
            some = slow[lo : lo + 4096]
            for p, e in zip(some, self.t.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = array("I", e.ids).tobytes()
        return {**known, **long} if long else known

    def in_pieces(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """The pieces of each text and their ids."""
        get, rows, gaps = self.known.get, [], []
        for x in texts:
            some = self.split(x)
            ids = list(map(get, some))
            if not all(ids):
                gaps.append((ids, [(i, some[i]) for i, b in enumerate(ids) if b is None]))
            rows.append((some, ids))
        if gaps:
            known = self.learn({p for _, lacking in gaps for _, p in lacking})
            for ids, lacking in gaps:
                for i, p in lacking:
                    ids[i] = known[p]
        return rows

    def encode(self, texts: list[str], threads: int = 1) -> list[bytes]:
        """The ids of each text; threads: how many leaves of a long text may be encoded at a time."""
        if len(self.known) > self.limit:
            self.known.clear()
        long = [i for i, x in enumerate(texts) if len(x) > LONG_TEXT and self.byte_level]
        if not long:
            return [b"".join(ids) for _, ids in self.in_pieces(texts)]
        out: list[bytes] = [b""] * len(texts)
        rest = [i for i, x in enumerate(texts) if not (len(x) > LONG_TEXT and self.byte_level)]
        for i, (_, ids) in zip(rest, self.in_pieces([texts[i] for i in rest])):
            out[i] = b"".join(ids)
        for i in long:
            out[i] = b"".join(self.tree(texts[i], threads))
        return out

    def tree(self, text: str, threads: int = 1) -> list[bytes]:
        """The ids of a long text's pieces: leaves first, then joins, level by level.

        What is split off a text depends on nothing in front of a split and on one character
        behind it, so two splittings that share a split agree from there on. Names of special
        tokens and odd spaces, which the library cuts at first, are no matter of pieces: texts
        with them are encoded as they are.
        """
        if _ODD_SPACE.search(text) or any(x in text for x in self.special):
            return self.in_pieces([text])[0][1]

        def halves(lo: int, hi: int) -> list[str]:
            mid = (lo + hi) // 2
            return [text[lo:hi]] if hi - lo <= LEAF else halves(lo, mid) + halves(mid, hi)

        leaves = halves(0, len(text))
        if threads > 1:
            with ThreadPoolExecutor(threads) as pool:
                level = list(pool.map(lambda x: self.in_pieces([x])[0], leaves))
        else:
            level = self.in_pieces(leaves)
        while len(level) > 1:
            joined = [self.join(*level[i], *level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0][1]

    def join(self, left: list[str], lids: list[bytes], right: list[str], rids: list[bytes]) -> tuple[list[str], list[bytes]]:
        self.joins += 1
        k = WINDOW_PIECES
        while True:
            self.windows += 1
            a, b = max(0, len(left) - k), min(len(right), k)
            some, ids = self.in_pieces(["".join(left[a:]) + "".join(right[:b])])[0]
            if (a == 0 or some[:1] == left[a : a + 1]) and (b == len(right) or some[-1:] == right[b - 1 : b]):
                return left[:a] + some + right[b:], lids[:a] + ids + rids[b:]
            k *= 2


class WordTable:
    """Encodings of whole columns with a word-level tokenizer, looked up by word hash in sorted arrays.

    White space is dropped by such a tokenizer, so words (see textnum) are on their own, and so
    is a comma or full stop after a letter at a word's end, a pre-token of its own. A
    table entry takes some thirty bytes; after LIMIT entries the table begins anew.
    """

    LIMIT = 1_000_000
    MOST_IDS = 64

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        self.pieces, self.limit = Pieces(path, False), limit
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _put(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Append encodings to the flat array: their places and lengths."""
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        new = np.frombuffer(b"".join(ids), dtype=np.uint32)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(new)), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        return at, n

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets): each row's ids with end_id behind them; null rows have that alone."""
        if len(self.keys) > self.limit:
            self._empty()
        # case is folded by the tokenizer, but not in the names of its special tokens
        fold = not pc.any(pc.match_substring(column, "<|")).as_py()
        hashes, starts, ends, first, raw = textnum.words(column, fold=fold, marks=True)
        keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        i = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == keys[inside]
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], n[known] = self.at[i[known]], self.n[i[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            new = [raw[a:b].tobytes().decode() for a, b in zip(starts[where[fresh]], ends[where[fresh]])]
            self.pieces.known = {}
            ids = self.pieces.learn(set(new))
            at[fresh], n[fresh] = self._put([ids[w] for w in new])
            keep = fresh[n[fresh] <= self.MOST_IDS]
            to = np.searchsorted(self.keys, keys[keep])
            self.keys, self.at, self.n = np.insert(self.keys, to, keys[keep]), np.insert(self.at, to, at[keep]), np.insert(self.n, to, n[keep])
        n_word = n[which]
        ends_out = np.cumsum(n_word)
        total = int(ends_out[-1]) if len(ends_out) else 0
        ids = self.flat[np.arange(total) + np.repeat(at[which] - (ends_out - n_word), n_word)]
        rows = np.concatenate([[0], ends_out])[first]
        per = np.diff(rows)
        offsets = np.concatenate([[0], np.cumsum(per + 1)])
        out = np.full(total + len(per), end_id, dtype=np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(per)), per)] = ids
        return out, offsets


_LOADED: dict[tuple, Pieces] = {}


def pieces(path: str, byte_level: bool) -> Pieces:
    """One per worker process and tokenizer."""
    if (path, byte_level) not in _LOADED:
        _LOADED[path, byte_level] = Pieces(path, byte_level)
    return _LOADED[path, byte_level]


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One per worker process and tokenizer."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def chunks(texts: list[str], size: int = 1 << 20) -> Iterator[slice]:
    """Slices of the list with about size characters each."""
    lo = n = 0
    for i, x in enumerate(texts):
        n += len(x)
        if n >= size:
            yield slice(lo, i + 1)
            lo, n = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
