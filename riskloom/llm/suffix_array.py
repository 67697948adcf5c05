"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

NARROW = 600


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S); the sentinel counts as such."""
    d = np.diff(t)
    at = np.where(d != 0, np.arange(len(d)), len(d))
    follow = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(d[follow] > 0, True) if len(d) else np.ones(len(t), bool)


def _runs(keys: np.ndarray) -> np.ndarray:
    """The rank of each of sorted ``keys`` among its equals."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _induce_narrow(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, wide: int) -> np.ndarray:
    """From leftmost-smaller suffixes in order to all suffixes, bucket by bucket: for small alphabets."""
    many = np.bincount(t, minlength=wide)
    end = np.cumsum(many)
    start = end - many
    sa = np.full(len(t), -1, np.int64)
    by = np.argsort(t[seeds], kind="stable")
    sorted_seeds, lots = seeds[by], np.searchsorted(t[seeds][by], np.arange(wide + 1))
    head = start.copy()
    for c in np.flatnonzero(many).tolist():
        at = start[c]
        while True:
            upto = head[c]
            wave = sa[at:upto] if at < upto else sorted_seeds[lots[c] : lots[c + 1]]
            last, at = at >= upto, upto
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            if len(before):
                keys = t[before]
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                sa[head[keys] + _runs(keys)] = before[order]
                head += np.bincount(keys, minlength=wide)
            if last:
                break
    tail = end.copy()
    for c in np.flatnonzero(many)[::-1].tolist():
        at = end[c]
        while True:
            upto = tail[c]
            wave = (sa[upto:at] if at > upto else sa[start[c] : head[c]])[::-1]
            last, at = at <= upto, upto
            before = wave[wave > 0] - 1
            before = before[s[before]]
            if len(before):
                keys = t[before]
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                sa[tail[keys] - 1 - _runs(keys)] = before[order]
                tail -= np.bincount(keys, minlength=wide)
            if last:
                break
    sa[0] = len(t) - 1
    return sa


def _induce_wide(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, wide: int) -> np.ndarray:
    """The same, suffix by suffix: for large alphabets."""
    many = np.bincount(t, minlength=wide)
    end = np.cumsum(many)
    text, small, sa = t.tolist(), s.tolist(), [0] * len(t)
    tail = end.tolist()
    for i in seeds[::-1].tolist():
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = (end - many).tolist()
    for i in range(len(sa)):
        if (j := sa[i]) > 0 and not small[j - 1]:
            c = text[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = end.tolist()
    for i in range(len(sa) - 1, -1, -1):
        if (j := sa[i]) > 0 and small[j - 1]:
            c = text[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    sa[0] = len(sa) - 1
    return np.array(sa)


def suffix_array(t: np.ndarray, wide: int) -> np.ndarray:
    """Of ``t``, whole numbers under ``wide`` whose last, and only it, is 0.

    Suffixes are classified; the leftmost smaller ones are sorted by their substrings (one induction), named, and
    sorted by the array of the names' string; a second induction sorts the rest. Linear work.
    """
    t = t.astype(np.int64)
    if len(t) == 1:
        return np.zeros(1, np.int64)
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    induce = _induce_narrow if wide <= NARROW else _induce_wide
    first = induce(t, s, lms, wide)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = place[first]
    order = order[order >= 0]
    # neighbours in order have one name if their substrings, to the next leftmost smaller suffix, are the same
    size = np.append(np.diff(lms), 0)
    same = size[order[1:]] == size[order[:-1]]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        a, b = lms[order[left]] + k, lms[order[left + 1]] + k
        equal = t[a] == t[b]
        same[left[~equal]] = False
        left = left[equal & (size[order[left]] > k)]
        k += 1
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    many = int(names.max()) + 1
    if many < len(lms):
        order = suffix_array(names, many)
    return induce(t, s, lms[order], wide)


def common_prefixes(t: np.ndarray, sa: np.ndarray, stretches: list[tuple[int, int]], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places of ``stretches`` (begin, end), in text order: each suffix's predecessor in the array, and the
    length they share, ``cap`` at most. From one place to the next the length falls by one at most."""
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text, out = t.astype("<u2").tobytes(), np.zeros(len(t), np.int32)
    for begin, end in stretches:
        shared = 0
        for i, j in zip(range(begin, end), before[begin:end].tolist(), strict=True):
            if j < 0:
                shared = 0
                continue
            while shared < cap:
                a, b = text[2 * (i + shared) : 2 * (i + cap)][:64], text[2 * (j + shared) : 2 * (j + cap)][:64]
                if a == b and len(a) == 64:
                    shared += 32
                    continue
                x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
                shared += min(len(a), len(b)) // 2 if not x else min(((x & -x).bit_length() - 1) // 16, min(len(a), len(b)) // 2)
                break
            out[i] = shared = min(shared, cap)
            shared = max(shared - 1, 0)
    return before, out
