"""Suffix order and neighbour matches of a text of small integers, with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling. text: integers from 0; a suffix that ends is smaller."""
    n = len(text)
    top = int(text.max()) + 2 if n else 1
    key, width, limit = text.astype(np.int64) + 1, 1, 2**62
    span = top
    while span <= limit // top and width < n:  # as many units as fit go into the first key
        more = np.zeros(n, np.int64)
        more[:-width] = text[width:].astype(np.int64) + 1
        key = key * top + more
        span *= top
        width += 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    step = np.zeros(n, np.int64)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=step[1:].view(np.int64), casting="unsafe") if n > 1 else None
    names = np.cumsum(step)
    rank[order] = names
    while n and names[-1] < n - 1:
        # Only suffixes whose rank is shared are sorted again.
        size = np.bincount(names)
        open_at = np.flatnonzero(size[names] > 1)
        some = order[open_at]
        behind = np.zeros(len(some), np.int64)
        inside = some + width < n
        behind[inside] = rank[some[inside] + width] + 1
        group = names[open_at]
        again = np.argsort(group * (n + 1) + behind, kind="stable")
        order[open_at] = some[again]
        behind, group = behind[again], group[again]
        change = np.zeros(n, np.int64)
        change[np.flatnonzero(np.diff(names)) + 1] = 1
        new = np.flatnonzero((behind[1:] != behind[:-1]) & (group[1:] == group[:-1])) + 1
        change[open_at[new]] = 1
        names = np.cumsum(change)
        rank[order] = names
        width *= 2
    return order


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: int, together: int = 1 << 16) -> np.ndarray:
    """For pairs of places, the number of equal units from there on, counted up to `most` at least where it is reached."""
    if len(left) > together:  # so that what is compared at a time stays small
        parts = range(0, len(left), together)
        return np.concatenate([common_prefixes(text, left[a : a + together], right[a : a + together], most, together) for a in parts])
    n = len(text)
    out = np.zeros(len(left), np.int64)
    live = np.arange(len(left))
    step = 16
    padded = np.concatenate([text, np.arange(-1, -step - 1, -1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, step)
    while len(live):
        a, b = left[live] + out[live], right[live] + out[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        if not len(live):
            break
        differs = windows[a] != windows[b]
        some = differs.any(axis=1)
        got = np.where(some, differs.argmax(axis=1), step)
        out[live] += got
        live = live[~some & (out[live] < most)]
    return out
