"""Suffix order by difference cover, on arrays: sort sampled triples, recurse on their names, merge the rest."""

from __future__ import annotations

import numpy as np


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below 2 ** bits) in order, and the places they came from; equal keys in any order."""
    low = max(1, len(key)).bit_length()
    if bits + low <= 63:  # key and place in one integer: sorting values is much cheaper than sorting places
        both = (key << low) | np.arange(len(key))
        both.sort()
        return both >> low, both & ((1 << low) - 1)
    by = np.argsort(key)
    return key[by], by


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names from 1, in lexicographic order of the triples; and how many there are."""
    bits = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))).bit_length()
    if 3 * bits <= 63:
        key, bits = (a.astype(np.int64) << (2 * bits)) | (b.astype(np.int64) << bits) | c, 3 * bits
    else:  # name the pairs first, so that the key still fits
        key = (a.astype(np.int64) << 31) | b
        key, bits = (np.unique(key, return_inverse=True)[1].astype(np.int64) << 31) | c, 63
    key, by = _sorted(key, bits)
    new = np.empty(len(key), np.int32)
    new[:1] = 1
    np.not_equal(key[1:], key[:-1], out=new[1:], casting="unsafe")
    name = np.cumsum(new, dtype=np.int32)
    out = np.empty(len(key), np.int32)
    out[by] = name
    return out, int(name[-1]) if len(name) else 0


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of s (symbols from 1): a permutation that agrees with the order of their first `depth` symbols at least.

    Difference cover {1, 2} modulo 3. Sampled triples are named; the names' own suffixes are ranked to a third of the depth;
    the remaining suffixes follow from one symbol and a sampled rank and are merged in. Suffixes that agree in their first
    `depth` symbols come out in no particular order, but next to each other.
    """
    n = len(s)
    if n == 0:
        return np.empty(0, np.int32)
    p = np.zeros(n + 6, np.int32)
    p[:n] = s
    if depth <= 3:
        names, many = _names(p[:n], p[1 : n + 1], p[2 : n + 2])
        rank = np.empty(n, np.int32)
        rank[_sorted(names.astype(np.int64), many.bit_length())[1]] = np.arange(n, dtype=np.int32)
        return rank
    phantom = n % 3 == 1  # the empty suffix at n then belongs to the sample
    zeros, ones, twos = -(-n // 3), -(-(n - 1) // 3) + phantom, -(-max(0, n - 2) // 3)
    every = lambda x, i, many: x[i : i + 3 * many : 3]
    names, many = _names(*(np.concatenate([every(p, 1 + i, ones), every(p, 2 + i, twos)]) for i in range(3)))
    if many < len(names):
        text = np.zeros(len(names) + 1, np.int32)  # a zero parts the two halves
        text[:ones], text[ones + 1 :] = names[:ones], names[ones:]
        inner = suffix_ranks(text, -(-depth // 3))
        names = np.concatenate([inner[:ones], inner[ones + 1 :]]) + 1
    r = np.zeros(n + 6, np.int64)
    every(r, 1, ones)[:], every(r, 2, twos)[:] = names[:ones], names[ones:]
    # ranks differ and are at most one more than there are, so a place for each puts the sample in order without sorting it
    place = np.full(len(names) + 2, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    if phantom:
        place[names[ones - 1]] = -1
    sample = place[place >= 0]  # numbers of the ones, then of the twos
    del names, place
    wide, lo = int(r.max()).bit_length(), int(p.max()).bit_length()
    first = sample < ones
    by_one, by_two = sample[first], sample[~first] - ones
    pair = lambda i, many: (every(p, i, many).astype(np.int64) << wide) | every(r, i + 1, many)
    key, by_zero = _sorted(pair(0, zeros), lo + wide)
    below = np.searchsorted(pair(1, ones)[by_one], key)
    if 2 * lo + wide <= 63:
        triple = lambda i, many: (every(p, i, many).astype(np.int64) << (lo + wide)) | pair(i + 1, many)
        below += np.searchsorted(triple(2, twos)[by_two], triple(0, zeros)[by_zero])
    else:  # name the second part (symbol and rank), then compare with the first symbol
        both = np.unique(np.concatenate([pair(3, twos)[by_two], pair(1, zeros)[by_zero]]), return_inverse=True)[1].astype(np.int64)
        key = (np.concatenate([every(p, 2, twos)[by_two], every(p, 0, zeros)[by_zero]]).astype(np.int64) << 32) | both
        below += np.searchsorted(key[:twos], key[twos:])
    at = np.maximum.accumulate(below) + np.arange(zeros)
    rest = np.ones(n, bool)
    rest[at] = False
    rank, placed, sampled = np.empty(n, np.int32), np.empty(zeros, np.int32), np.empty(ones + twos, np.int32)
    placed[by_zero], sampled[sample] = at, np.flatnonzero(rest)
    rank[::3], rank[1::3], rank[2::3] = placed, sampled[: ones - phantom], sampled[ones:]
    return rank


def _words(s: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """At each position as many symbols (from it on, `most` at most) as fit one integer; and how many these are."""
    bits = max(1, int(s.max(initial=0)).bit_length())
    per = max(1, min(most, 63 // bits))
    out = np.zeros(len(s), np.int64)
    for step in range(per):
        out <<= bits
        out[: len(s) - step] |= s[step:]
    return out, per


def equal_windows(s: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class numbers of the windows s[i:i+length] for i in starts (each wholly inside s): equal numbers, equal windows.

    Sorts the suffixes, then compares the first `length` symbols of neighbours.
    """
    if len(starts) == 0:
        return np.empty(0, np.int64)
    rank = suffix_ranks(s, length)
    window = np.full(len(s), -1, np.int64)  # of each place in the order: the window that starts there
    window[rank[starts]] = np.arange(len(starts))
    by = window[window >= 0]
    del rank, window
    i, j = starts[by[:-1]], starts[by[1:]]
    live = np.arange(len(i))
    word, per = _words(s, length)
    for step in [*range(0, length - per, per), length - per]:
        keep = word[i + step] == word[j + step]
        if not keep.all():
            live, i, j = live[keep], i[keep], j[keep]
        if not len(live):
            break
    new = np.ones(len(starts), np.int64)
    new[live + 1] = 0
    out = np.empty(len(starts), np.int64)
    out[by] = np.cumsum(new) - 1
    return out
