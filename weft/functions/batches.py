"""String similarities of many pairs at once, in Arrow batches.

The strings of a batch become rows of letter numbers, the places of every letter
in a string the bits of 64-bit words; a step of the comparison is then one
operation on the words of all pairs.  The results are those of the comparison
of two strings that they stand for, to the last bit.  Null on either side: null.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words in a table of letter places; a batch that needs more is halved.
PLACES = 1 << 22
ONE = np.uint64(1)


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of each string, code points of all in a row)."""
    s = strings.cast(pa.string())
    at = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1] if len(s) else np.zeros(1, np.int32)
    data = np.frombuffer(s.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    if not len(data) or data.max() < 128:
        return np.diff(at).astype(np.int64), data
    return pc.utf8_length(s).to_numpy().astype(np.int64), np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


class Side:
    """The distinct strings of one side: of each pair the string (at), of each string its letters (grid, 0 behind the end) and length (size)."""

    def __init__(self, at: np.ndarray, size: np.ndarray, letters: np.ndarray, kinds: int):
        self.at, self.size = at, size
        self.grid = np.zeros((len(size), max(4, int(size.max(initial=0)))), np.uint8 if kinds <= 256 else np.int32)
        start = np.cumsum(size) - size
        self.grid[np.repeat(np.arange(len(size)), size), np.arange(len(letters)) - np.repeat(start, size)] = letters

    def places(self, kinds: int) -> list[np.ndarray]:
        """The 64-bit words of the places of letter c in string d, at d * kinds + c."""
        d, width = self.grid.shape
        out = [np.zeros(d * kinds, np.uint64) for _ in range((width + 63) // 64)]
        row = np.arange(d) * kinds
        for j in range(width):
            out[j // 64][row + self.grid[:, j]] |= ONE << np.uint64(j % 64)
        for w in out:
            w[row] = 0
        return out


def _sides(a: pa.Array, b: pa.Array) -> tuple[Side, Side, int]:
    """Both sides with letters numbered alike from 1, and how many numbers there are."""
    ids, sizes, codes = [], [], []
    for x in (a, b):
        x = x.dictionary_encode()
        ids.append(x.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        n, c = _letters(x.dictionary)
        sizes.append(n)
        codes.append(c)
    known = np.zeros(max(int(c.max(initial=0)) for c in codes) + 1, np.int32)
    for c in codes:
        known[c] = 1
    number = np.cumsum(known, dtype=np.int32)
    kinds = int(number[-1]) + 1
    return *(Side(i, n, number[c], kinds) for i, n, c in zip(ids, sizes, codes)), kinds


def batched(values: Callable[[Side, Side, int], np.ndarray]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """A function of two sides as one of two string arrays."""

    def apply(a: pa.Array, b: pa.Array) -> pa.Array:
        known = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
        if not known.all():
            out = np.zeros(len(a))
            out[known] = apply(a.filter(pa.array(known)), b.filter(pa.array(known))).to_numpy(zero_copy_only=False)
            return pa.array(out, pa.float64(), mask=~known)
        if not len(a):
            return pa.array([], pa.float64())
        s, t, kinds = _sides(a, b)
        if len(a) > 1 and len(t.size) * kinds * ((t.grid.shape[1] + 63) // 64) > PLACES:
            h = len(a) // 2
            return pa.concat_arrays([apply(a[:h], b[:h]), apply(a[h:], b[h:])])
        return pa.array(values(s, t, kinds), pa.float64())

    return apply


def _jaro_winkler(s: Side, t: Side, kinds: int, scale: float = 0.1) -> np.ndarray:
    """metrics.jaro_winkler_value of every pair."""
    place = t.places(kinds)
    words = (t.size[t.at] + 63) // 64
    out = np.zeros(len(s.at))
    for w in range(1, len(place) + 1):
        # Pairs with the longest first string come first, so that a step works on the beginning of the arrays.
        some = np.flatnonzero(words == w)
        some = some[np.argsort(-s.size[s.at[some]], kind="stable")]
        if len(some):
            out[some] = _jaro_winkler_of(s, t, s.at[some], t.at[some], place[:w], kinds, scale)
    return out


def _jaro_winkler_of(s: Side, t: Side, at_s: np.ndarray, at_t: np.ndarray, place: list[np.ndarray], kinds: int, scale: float) -> np.ndarray:
    n, m = s.size[at_s], t.size[at_t]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    mine, theirs = s.grid[at_s, : max(4, int(n[0]))], t.grid[at_t, : max(4, int(m.max()))]
    letters, row = np.ascontiguousarray(mine.T), at_t * kinds
    used = [np.zeros(len(n), np.uint64) for _ in place]
    window = [(ONE << np.clip(reach + 1 - 64 * w, 0, 64).astype(np.uint64)) - ONE for w in range(len(place))]
    taken = np.zeros(mine.T.shape, bool)
    open_ = np.searchsorted(-n, -np.arange(int(n[0])))  # pairs with more than i letters
    grows = int(reach.max())
    for i, k in enumerate(open_):
        at, hit = row[:k] + letters[i, :k], taken[i, :k]
        for w in range(len(place)):
            c = place[w].take(at)
            c &= window[w][:k]
            u = used[w][:k]
            c &= ~u
            if w:
                c[hit] = 0
            # The lowest bit.
            c &= np.negative(c)
            u |= c
            hit |= c != 0
        for w in range(len(place) - 1, -1, -1):
            x = window[w][:k]
            low = window[w - 1][:k] >> np.uint64(63) if w else i < reach[:k] if i < grows else None
            x <<= ONE
            if low is not None:
                x |= low
    taken = np.ascontiguousarray(taken.T)
    common = np.bitwise_count(np.stack(used)).sum(0, dtype=np.int64)
    spots = np.unpackbits(np.stack(used, 1).view(np.uint8), axis=1, bitorder="little")[:, : theirs.shape[1]].view(bool)
    other = np.concatenate([[0], np.cumsum(mine[taken] != theirs[spots])])
    ends = np.cumsum(common)
    swaps = (other[ends] - other[ends - common]) // 2
    k = np.maximum(common, 1)
    j = np.where(common == 0, 0.0, (common / np.maximum(n, 1) + common / np.maximum(m, 1) + (k - swaps) / k) / 3)
    same = (mine[:, :4] == theirs[:, :4]) & (mine[:, :4] > 0)
    return np.minimum(1.0, j + np.cumprod(same, axis=1).sum(1) * scale * (1 - j))


def _ratio(s: Side, t: Side, kinds: int) -> np.ndarray:
    """difflib's ratio (Ratcliff-Obershelp) of every pair.

    The longest common block (of equal ones the first in a, then in b) is taken
    and the parts before and behind it are compared in turn, parts of about one
    length together.
    """
    n, m = s.size[s.at], t.size[t.at]
    both = np.zeros(len(n), np.int64)
    place = t.places(kinds)[0]
    pair = np.flatnonzero((n > 0) & (m > 0))
    row, start = t.at * kinds, s.at * s.grid.shape[1]
    todo = [(pair, np.zeros(len(pair), np.int64), n[pair], np.zeros(len(pair), np.int64), m[pair])]
    while todo:
        parts = [np.concatenate(x) for x in zip(*todo)]
        todo = []
        size = parts[2] - parts[1]
        low = 0
        for most in (1, 2, 3, 4, 6, 8, 11, 16, 24, 40, 1 << 30):
            some = np.flatnonzero((size > low) & (size <= most))
            low = most
            if len(some):
                pair, a0, a1, b0, b1 = (x[some] for x in parts)
                k, ea, eb = _longest(place, row[pair], s.grid.ravel(), start[pair] + a0, a1 - a0, b0, b1)
                hit = np.flatnonzero(k)
                pair, a0, a1, b0, b1, k, ea, eb = (x[hit] for x in (pair, a0, a1, b0, b1, k, a0 + ea, eb))
                both += np.bincount(pair, k, len(both)).astype(np.int64)
                before, behind = np.flatnonzero((ea - k > a0) & (eb - k > b0)), np.flatnonzero((ea < a1) & (eb < b1))
                todo.append(tuple(x[before] for x in (pair, a0, ea - k, b0, eb - k)))
                todo.append(tuple(x[behind] for x in (pair, ea, a1, eb, b1)))
    return np.where(n + m == 0, 1.0, 2.0 * both / np.maximum(n + m, 1))


def _longest(place: np.ndarray, row: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of the longest common block of parts (0: none), and its ends in the part of a and in b.

    Blocks of k + 1 letters are those of k that go on, so that the longest are the last left.
    """
    inside = ((ONE << (b1 - b0).astype(np.uint64)) - ONE) << b0.astype(np.uint64)
    first = np.zeros((int(size.max()), len(row)), np.uint64)
    for i in range(len(first)):
        x = flat.take(start + i, mode="clip")
        x[size <= i] = 0
        np.bitwise_and(place.take(row + x), inside, out=first[i])
    k, ea, eb = (np.zeros(len(row), np.int64) for _ in range(3))
    left, now, done = np.arange(len(row)), first, 0
    while len(now):
        alive = np.flatnonzero(np.bitwise_or.reduce(now, 0))
        if not len(alive):
            break
        done += 1
        if len(alive) < len(left):
            left, now, first = left[alive], now[:, alive], first[:, alive]
        i = (now != 0).argmax(0)
        bits = now[i, np.arange(len(left))]
        # A block's first place is the number of bits below the lowest; rows begin at the block's last letter, the done-th or later.
        k[left], ea[left], eb[left] = done, i + done, np.bitwise_count((bits & np.negative(bits)) - ONE) + 1
        first = first[1:]
        now = first & (now[:-1] << ONE)
    return k, ea, eb


jaro_winkler_values = batched(_jaro_winkler)


def difflib_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """difflib's ratio of every pair; pairs whose second string is longer than a word has bits, one at a time."""
    long = pc.fill_null(pc.greater(pc.utf8_length(b), 64), False).to_numpy(zero_copy_only=False)
    if not long.any():
        return _short_ratios(a, b)
    out = np.full(len(a), np.nan)
    known = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    out[~long] = _short_ratios(a.filter(pa.array(~long)), b.filter(pa.array(~long))).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(long & known):
        out[i] = SequenceMatcher(None, a[int(i)].as_py(), b[int(i)].as_py()).ratio()
    return pa.array(out, pa.float64(), mask=~known)


_short_ratios = batched(_ratio)
