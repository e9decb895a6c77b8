"""Semiglobal alignment of a short sequence in a reference: affine gaps, BLOSUM62 over base letters.

A sequence that stands in the reference as it is needs no tables. In a short reference all
placements are scored. In a long one, blocks of the reference at multiples of BLOCK are an
index that all of the sequence's words of that length probe; around the diagonals of hits,
BAND bases to either side are scored. Without a hit the whole reference is scored in
overlapping stretches. So memory follows the stretch and not the reference.
"""

from __future__ import annotations

import numpy as np

GAP_OPEN, GAP_EXTEND = -5, -1
#: Longest reference, or stretch of it, that is scored at once; length of an index block; bases around a diagonal.
STRETCH, BLOCK, BAND = 65_536, 12, 70
#: The rows and columns of the public BLOSUM62 matrix for the letters A, C, G, T and N.
LETTERS = "ACGTN"
SCORES = np.array([[4, 0, 0, 0, -2], [0, 9, -3, -1, -3], [0, -3, 6, -2, 0], [0, -1, -2, 5, 0], [-2, -3, 0, 0, 6]], dtype=np.int32)
_CODE = np.full(256, 4, dtype=np.int8)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_NEVER = np.int32(-(10**8))


class ReferenceIndex:
    """A reference sequence to align against: its letters as numbers, and if it is long the numbers of its blocks, sorted."""

    def __init__(self, sequence: str, stretch: int = STRETCH) -> None:
        self.letters, self.stretch = _CODE[np.frombuffer(sequence.encode(), dtype=np.uint8)], stretch
        self.raw = self.letters.tobytes()
        self.blocks = self.places = None
        if len(self.letters) > stretch:
            own = self._words(self.letters[: len(self.letters) // BLOCK * BLOCK].reshape(-1, BLOCK))
            self.places = np.argsort(own, kind="stable")
            self.blocks = own[self.places]

    @staticmethod
    def _words(rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.int64) * 5 ** np.arange(BLOCK, dtype=np.int64)).sum(axis=1)

    def align(self, query: str) -> tuple[int, str]:
        """(start, CIGAR with = X I D) of the best placement of the whole query; reference ends are free.

        A gap of n costs 5 + n. On ties the alignment that ends first in the reference wins, and
        a match is preferred to an insertion, that to a deletion.
        """
        q = _CODE[np.frombuffer(query.encode(), dtype=np.uint8)]
        if not len(q):
            return 0, ""
        at = self.raw.find(q.tobytes())
        if at >= 0:  # every letter scores most against itself
            return at, f"{len(q)}="
        best = None
        for lo, hi in self._stretches(q):
            score, end, start, cigar = self._scored(q, lo, hi)
            if best is None or (score, -end) > (best[0], -best[1]):
                best = (score, end, start, cigar)
        return best[2], best[3]

    def _stretches(self, q: np.ndarray) -> list[tuple[int, int]]:
        n, m = len(self.letters), len(q)
        if n <= self.stretch:
            return [(0, n)]
        if m >= BLOCK:
            words = self._words(np.lib.stride_tricks.sliding_window_view(q, BLOCK))
            a, b = np.searchsorted(self.blocks, words), np.searchsorted(self.blocks, words, side="right")
            lows = sorted({int(p) * BLOCK - i - BAND for i in range(len(words)) for p in self.places[a[i] : b[i]]})
            out: list[tuple[int, int]] = []
            for low in lows:  # diagonals near each other are one stretch
                lo, hi = max(0, low), min(n, low + m + 2 * BAND)
                if out and lo <= out[-1][1] and hi - out[-1][0] <= self.stretch:
                    out[-1] = (out[-1][0], max(hi, out[-1][1]))
                else:
                    out.append((lo, hi))
            if out:
                return out
        over = m + 9 * m  # no alignment of m letters is longer: deletions would cost more than all matches give
        return [(lo, min(n, lo + self.stretch + over)) for lo in range(0, n, self.stretch)]

    def _scored(self, q: np.ndarray, lo: int, hi: int) -> tuple[int, int, int, str]:
        """(score, end, start, CIGAR) of the best placement within lo .. hi of the reference.

        Each row of the three score tables is computed at once; deletions along a row are a
        running maximum.
        """
        r = self.letters[lo:hi]
        m, n = len(q), len(r)
        steps = np.arange(n + 1, dtype=np.int32)
        best = np.zeros(n + 1, dtype=np.int32)
        ins = np.full(n + 1, _NEVER, dtype=np.int32)
        move = np.zeros((m + 1, n + 1), dtype=np.uint8)  # 0 diagonal, 1 insertion, 2 deletion; +4 insertion opened, +8 deletion opened
        for i in range(1, m + 1):
            opened, longer = best + GAP_OPEN + GAP_EXTEND, ins + GAP_EXTEND
            ins = np.maximum(opened, longer)
            diag = np.full(n + 1, _NEVER, dtype=np.int32)
            diag[1:] = best[:-1] + SCORES[q[i - 1]][r]
            top = np.maximum(diag, ins)
            # deletion ending at j, from the best earlier cell: a running maximum of top - extend * place
            run = np.maximum.accumulate(top + GAP_OPEN - GAP_EXTEND * steps)
            gone = np.full(n + 1, _NEVER, dtype=np.int32)
            gone[1:] = run[:-1] + GAP_EXTEND * steps[1:]
            new = np.maximum(top, gone)
            move[i] = np.where(diag == new, 0, np.where(ins == new, 1, 2)) + 4 * (opened >= longer)
            move[i, 1:] += 8 * (gone[1:] == top[:-1] + GAP_OPEN + GAP_EXTEND).astype(np.uint8)
            best = new
        i, j = m, int(best.argmax())
        score, end = int(best[j]), lo + j
        out: list[tuple[str, int]] = []
        state = int(move[i, j]) & 3

        def put(c: str) -> None:
            if out and out[-1][0] == c:
                out[-1] = (c, out[-1][1] + 1)
            else:
                out.append((c, 1))

        while i > 0:
            if state == 0:
                put("=" if q[i - 1] == r[j - 1] else "X")
                i, j = i - 1, j - 1
                state = int(move[i, j]) & 3
            elif state == 1:
                opened = int(move[i, j]) & 4
                put("I")
                i -= 1
                state = int(move[i, j]) & 3 if opened else 1
            else:
                opened = int(move[i, j]) & 8
                put("D")
                j -= 1
                state = (int(move[i, j]) & 3) if opened else 2
        return score, end, lo + j, "".join(f"{n}{c}" for c, n in reversed(out))
