"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes, both down to a given depth."""
from __future__ import annotations

import numpy as np

STRIPS = 16384


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the text ordered by their next `depth` bytes, and each position's rank; equal stretches share one.

    The first pass sorts by eight bytes at once. Each further pass doubles the sorted depth: a suffix of an unsettled
    group is placed by the rank of the suffix that begins where its sorted part ends; settled suffixes are not touched.
    The text counts as followed by zero bytes. Only `starts` are returned in the order, but all positions are ranked.
    """
    n = len(text)
    padded = np.zeros(n + depth + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k:n + k]
    order = np.argsort(key, kind="stable")
    lead = np.ones(n, bool)
    lead[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + depth, np.int64)
    first = np.maximum.accumulate(np.where(lead, np.arange(1, n + 1), 0))
    rank[order] = first
    sorted_to = 8
    while sorted_to < depth:
        step = min(sorted_to, depth - sorted_to)
        # Places in the order that share their rank with a neighbour.
        open_places = np.ones(n + 1, bool)
        open_places[:n] = lead
        open_places = np.flatnonzero(~(open_places[:-1] & open_places[1:]))
        if not len(open_places):
            break
        members = order[open_places]
        pair = first[open_places] << 32 | rank[members + step]
        by_pair = np.argsort(pair, kind="stable")
        members, pair = members[by_pair], pair[by_pair]
        order[open_places] = members
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        lead[open_places] = new
        first = np.maximum.accumulate(np.where(lead, np.arange(1, n + 1), 0))
        rank[members] = first[open_places]
        sorted_to += step
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]], rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each entry of the order, how many bytes its suffix shares with the one before, `depth` at most.

    Kasai's rule: in text order, a suffix shares with its neighbour at least one byte less than the suffix one place
    earlier shared with its own. As the order only goes down to `depth`, this is relied on where the neighbour has
    moved along by as many places, and counting begins anew elsewhere. The text is cut into strips that advance side
    by side.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.zeros(len(text) + depth + 1, np.uint8)
    padded[:len(text)] = text
    in_text = np.argsort(order[1:], kind="stable") + 1
    here, before = order[in_text], order[in_text - 1]
    strip = -(-len(here) // STRIPS)
    shared = np.zeros(STRIPS, np.int64)
    for t in range(strip):
        at = np.arange(t, len(here), strip)
        a, b = here[at], before[at]
        if t:
            gap = a - here[at - 1]
            h = np.where(before[at - 1] + gap == b, np.maximum(shared[:len(at)] - gap, 0), 0)
        else:
            h = np.zeros(len(at), np.int64)
        active = np.flatnonzero(h < depth)
        while len(active):
            same = padded[a[active] + h[active]] == padded[b[active] + h[active]]
            active = active[same]
            h[active] += 1
            active = active[h[active] < depth]
        shared[:len(at)] = h
        out[in_text[at]] = h
    return out
