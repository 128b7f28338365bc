"""Which pairs of two lists of normalised texts are alike in sequence: all pairs, in numpy, by ever dearer upper bounds.

Texts are alike by Ratcliff and Obershelp's ratio, twice the matching characters over both lengths. Pairs whose counts of letters differ
by too much go first, then those with too many different runs or too short a common subsequence; what is left is compared. Nothing at the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from tidelane.functions.documents import common_characters

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Letters are first counted together in these groups, of about one frequency each.
GROUPS = ["e", "t", "a", "o", "i", "n", "s", "r", " ", "lhd", "cumf", "pgwybvkxjqz0123456789"]
#: Bits of a word of positions: sums of that many powers of two are exact as doubles, and leave room for a carry.
BITS = 52
#: Characters that are counted or compared at once, or one text's.
CHARACTERS = 2_000_000
#: Pairs that are looked at together, and the longest text (of a) that is compared in numpy and not by Python's integers.
PAIRS, LONGEST = 65536, 1000
#: Pairs whose subsequences are found at once, and so few that Python's integers are quicker.
LOT, FEW = 16384, 48


class Counted:
    """Texts with their lengths, letters as numbers, and counts of letters and of groups of letters."""

    def __init__(self, said: list[pa.Array]):
        self.said = pa.concat_arrays([x.cast(pa.large_string()) for x in said])
        at = np.frombuffer(self.said.buffers()[1], np.int64)[self.said.offset :][: len(self.said) + 1]
        number = np.zeros(256, np.uint8)
        number[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
        self.codes = number[np.frombuffer(self.said.buffers()[2], np.uint8)[at[0] : at[-1]]]
        self.at, self.n = at[:-1] - at[0], np.diff(at)
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        kinds, lots = len(LETTERS), np.flatnonzero(np.diff(self.at // CHARACTERS)) + 1
        counts = []
        for rows in np.split(np.arange(len(self.n)), lots):
            of, _, code = self.characters(rows)
            counts.append(np.bincount(of * kinds + code, minlength=len(rows) * kinds).reshape(-1, kinds).T.astype(np.int32))
        self.letters = np.concatenate(counts, 1)
        self.groups = np.array([self.letters[[LETTERS.index(x) for x in g]].sum(0) for g in GROUPS], np.int32)

    def characters(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts of rows, one after another: place in rows, place in the text, and letter."""
        n = self.n[rows]
        of = np.repeat(np.arange(len(rows)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return of, place, self.codes[self.at[rows][of] + place]

    def runs(self, q: int, bits: int) -> np.ndarray:
        """A row for each text, with a bit for each hash of its runs of q characters, of 2**bits hashes; kept."""
        if (q, bits) not in self.kept:
            out, lot = [], max(1, 8 * CHARACTERS >> bits)
            for first in range(0, len(self.n), lot):
                rows = np.arange(first, min(first + lot, len(self.n)))
                of, place, code = self.characters(rows)
                run = np.zeros(max(0, len(code) - q + 1), np.uint64)
                for k in range(q):
                    run = run * np.uint64(len(LETTERS)) + code[k : len(run) + k]
                whole = np.flatnonzero(place[: len(run)] + q <= self.n[rows][of[: len(run)]])
                met = np.zeros((len(rows), 1 << bits), bool)
                met[of[whole], (run[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)] = True
                out.append(np.packbits(met, axis=1).view(np.uint64))
            self.kept[q, bits] = np.concatenate(out)
        return self.kept[q, bits]


def near_counts(a: Counted, b: Counted, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b): the pairs whose letters can match often enough, some tens of thousands at a time."""
    kind = np.int16 if max(a.n.max(), b.n.max()) < 16000 else np.int32
    x, y = a.groups.astype(kind), b.groups.astype(kind)
    spare = lambda t: np.ceil((1 - threshold) * t.n + 1e-9).astype(kind)
    spare_a, spare_b = spare(a), spare(b)
    step, found, n = max(1, PAIRS // len(a.n)), [], 0
    for first in range(0, len(b.n), step):
        some = slice(first, first + step)
        over = -(spare_a[None, :] + spare_b[some, None])
        for k in range(len(GROUPS)):
            over += np.abs(x[k][None, :] - y[k][some, None])
        j, i = np.nonzero(over <= 0)
        for lot in range(0, len(i), PAIRS):
            p, q = i[lot : lot + PAIRS], j[lot : lot + PAIRS] + first
            apart = sum(np.abs(c[p] - d[q]) for c, d in zip(a.letters, b.letters))
            met = apart <= (1 - threshold) * (a.n[p] + b.n[q]) + 1e-9
            found.append((p[met], q[met]))
            n += met.sum()
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*found)))
            found, n = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


def run_length(threshold: float) -> int:
    """Of runs of q characters an inserted or deleted one makes or ends 2 q - 1 at most: the q at which a pair may differ in some 0.56 of its runs; 1 where there is none."""
    return int((0.56 / max(1 - threshold, 0.02) + 1) / 2)


def near_runs(a: Counted, i: np.ndarray, b: Counted, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have sets of runs near enough."""
    q = run_length(threshold)
    bits = max(6, int(8 * max(a.n.max(), b.n.max())).bit_length())
    x, y = a.runs(q, bits), b.runs(q, bits)
    met, lot = [], max(1, CHARACTERS >> bits - 6)
    for first in range(0, len(i), lot):
        p, o = i[first : first + lot], j[first : first + lot]
        apart = np.bitwise_count(x[p] ^ y[o]).sum(1, dtype=np.int64)
        met.append(apart <= (2 * q - 1) * (1 - threshold) * (a.n[p] + b.n[o]) + 1e-9)
    return np.concatenate(met)


def common_lengths(a: Counted, i: np.ndarray, b: Counted, j: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """common_characters of each pair of rows, all pairs at once: a bit for each character of a, in words of BITS.

    Pairs that can't reach half of `least` are given up on the way, with 0: when r characters of b are left, the beginning of b has to match what is before the last r of a,
    and can't match more than that and r in all, wherever the rest begins.
    """
    least = np.zeros(len(i)) if least is None else least
    rows, of_a = np.unique(i, return_inverse=True)
    words, kinds = -(-int(a.n[rows].max()) // BITS), len(LETTERS) + 1  # and one that no text has, for the ends of shorter ones
    row, place, code = a.characters(rows)
    size = len(rows) * kinds
    at = np.bincount(place // BITS * size + row * kinds + code, 2.0 ** (place % BITS), words * size).astype(np.uint64).reshape(words, size)
    rows, of_b = np.unique(j, return_inverse=True)
    letters = np.full((int(b.n[rows].max()), len(rows)), kinds - 1)
    row, place, code = b.characters(rows)
    letters[place, row] = code
    at_a, pairs, out = of_a * kinds, np.arange(len(i)), np.zeros(len(i), np.int64)
    one, top = np.uint64(1), np.uint64(BITS)
    every = (one << top) - one
    left = np.full((words, len(j)), every)
    met, total, carry = np.empty((3, len(j)), np.uint64)
    for done, letter in enumerate(letters, 1):
        step = letter.take(of_b)
        step += at_a
        carry[:] = 0
        for word, now in zip(at, left):
            np.take(word, step, out=met, mode="clip")
            met &= now
            np.add(now, met, out=total)
            total += carry
            np.right_shift(total, top, out=carry)
            now -= met
            total &= every
            now |= total
        if done % max(8, len(letters) // 10) == 0:
            rest = np.maximum(b.n[j[pairs]] - done, 0)
            before = a.n[i[pairs]] - rest
            first = [(one << np.clip(before - k * BITS, 0, BITS).astype(np.uint64)) - one for k in range(words)]
            most = rest + sum(np.bitwise_count(f & ~now).astype(np.int64) for f, now in zip(first, left))
            hope = 2 * most >= least[pairs]
            if hope.mean() < 0.8:
                pairs, of_b, at_a, left = pairs[hope], of_b[hope], at_a[hope], left[:, hope]
                met, total, carry = np.empty((3, len(pairs)), np.uint64)
                if not len(pairs):
                    break
    out[pairs] = words * BITS - np.bitwise_count(left).sum(0, dtype=np.int64)
    return out


def alike(a: Counted, b: Counted, threshold: float) -> Iterator[tuple[str, str, float]]:
    """(text of a, text of b, ratio): the pairs of different texts whose ratio reaches the threshold."""
    match = SequenceMatcher(None)
    for i, j in near_counts(a, b, threshold):
        if len(i) and run_length(threshold) > 1:
            met = near_runs(a, i, b, j, threshold)
            i, j = i[met], j[met]
        if not len(i):
            continue
        long = np.maximum(a.n[i] > LONGEST, b.n[j] > LONGEST)
        least = threshold * (a.n[i] + b.n[j]) - 1e-9
        words = np.where(long, 0, -(-b.n[j] // BITS))
        order = np.lexsort((j, words))  # few texts of b at a time; those of a should have about one length
        kept, last = [], None
        for lot in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
            for some in np.split(lot, range(LOT, len(lot), LOT)):
                if words[some[0]] and len(some) >= FEW:
                    common = common_lengths(b, j[some], a, i[some], least[some])
                else:
                    common = np.array([common_characters(a.said[p].as_py(), b.said[q].as_py()) for p, q in zip(i[some], j[some])])
                kept.append(some[2 * common >= least[some]])
        for k in sorted(np.concatenate(kept), key=lambda k: j[k]):
            x, y = a.said[i[k]].as_py(), b.said[j[k]].as_py()
            if x != y:
                if j[k] != last:  # what SequenceMatcher learns of its second text is kept
                    match.set_seq2(y)
                    last = j[k]
                match.set_seq1(x)
                if (ratio := match.ratio()) >= threshold:
                    yield x, y, ratio


def banded(threshold: float):
    """For mapInArrow over rows (band, mine, said) by band, in each first those of b (not mine): the pairs of each band that are alike, as (a, b, similarity).

    Of a band the texts of b are held, and those of a pass by.
    """

    def pairs(a: list[pa.Array], b: Counted) -> Iterator[pa.RecordBatch]:
        if found := list(alike(Counted(a), b, threshold)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.string(), pa.float64()))], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, others, b, a = None, [], None, []
        for batch in batches:
            band, mine = batch["band"].to_numpy(), batch["mine"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(band) != 0) | np.diff(mine)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(band)]):
                if band[start] != last:
                    if a:
                        yield from pairs(a, b)
                    last, others, b, a = band[start], [], None, []
                said = batch["said"].slice(start, end - start)
                if not mine[start]:
                    others.append(said)
                elif others:
                    b = b or Counted(others)
                    a.append(said)
                    if sum(x.nbytes for x in a) >= CHARACTERS:
                        yield from pairs(a, b)
                        a = []
        if a:
            yield from pairs(a, b)

    return run
