"""Suffix arrays by linear grouping, and repeated windows of aligned pieces found with them."""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s (positive integers, none much above its length) and the empty one, which comes first.

    First all suffixes are grouped by their Lyndon prefix: groups go from the greatest down; every suffix of a group
    finds its previous smaller suffix over pointers, and those so found move behind the rest of their own group, apart
    by how often they were found. Then the groups' orders are filled in ascending order, following the same pointers.
    Nothing is sorted or renamed again: letters are counted, a group's positions stay ascending (its suffixes find
    theirs in ascending order), and how often is told apart by counting too, so the work is linear.
    """
    n = len(s)
    text = [*s, 0]
    counts = [0] * (max(text) + 1)
    for c in text:
        counts[c] += 1
    begins, at = [0] * len(counts), 0
    for c, k in enumerate(counts):
        begins[c] = at
        at += k
    group = [begins[c] for c in text]
    size, first_of = [0] * (n + 1), [0] * (n + 1)  # by a group's first place; the first place by the last one
    held: list[list[int]] = [[] for _ in range(n + 1)]  # positions, also such as have left the group since
    for i, g in enumerate(group):
        held[g].append(i)
    for c, k in enumerate(counts):
        if k:
            size[begins[c]] = k
            first_of[begins[c] + k - 1] = begins[c]
    before = [-1] * (n + 1)
    end = n
    while end > 0:  # the empty suffix is the first group by itself, so group[-1], its own, is below all others
        g = first_of[end]
        end = g - 1
        found: list[int] = []
        for i in held[g]:
            if group[i] == g:
                p = i - 1
                while group[p] >= g:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    found.append(p)
        if len(found) == 1:  # most groups: nothing to count
            moves = [found]
        elif len(found) == 2:
            p, q = found
            moves = [[p]] if p == q else [found] if group[p] == group[q] else [[p], [q]]
        else:
            by: dict[int, dict[int, list[int]]] = {}
            for p, times in Counter(found).items():
                by.setdefault(times, {}).setdefault(group[p], []).append(p)
            moves = [moved for times in range(max(by, default=0), 0, -1) for moved in by.get(times, {}).values()]
        for moved in moves:
            # groups are looked up anew: of one old group, those found more often have already left
            h = group[moved[0]]
            left = size[h] - len(moved)
            if not left:
                continue  # the whole group was found as often
            new = h + left
            size[h], size[new] = left, len(moved)
            first_of[new - 1], first_of[new + len(moved) - 1] = h, new
            held[new] = moved
            for p in moved:
                group[p] = new

    fill = list(range(n + 1))
    out, done = [0] * (n + 1), bytearray(n + 1)
    out[0] = n
    done[n] = 1
    fill[group[n]] += 1
    for at in range(n + 1):
        p = out[at] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[fill[g]] = p
            fill[g] += 1
            done[p] = 1
            p = before[p]
    return out


def names_of(values: np.ndarray) -> np.ndarray:
    """Ranks from 0 of 64-bit letters among the different ones, by four passes of counting sort."""
    order = np.arange(len(values))
    for shift in (0, 16, 32, 48):
        digit = ((values >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16-bit numbers
    ranks = np.zeros(len(values), np.int64)
    ranks[order[1:]] = np.cumsum(values[order[1:]] != values[order[:-1]])
    return ranks


#: Pieces are laid out in rows of bytes with their anchors in one column; 8 bytes are one letter of the suffix array.
ANCHOR_COLUMN, ROW, LETTER = 72, 184, 8


def repeated_windows(contexts: list[bytes], left: np.ndarray, windows: np.ndarray, rank: np.ndarray, length: int = 100) -> np.ndarray:
    """Which windows of `length` bytes of the pieces also stand in a piece of lower rank; bool, pieces x 72.

    Piece p is contexts[p]; its anchor stands left[p] bytes after its start, and its windows[p] windows begin at its
    bytes 0, 1, ... Equal windows have equal places relative to the anchor, so pieces are compared as aligned there:
    the suffixes that begin at every eighth byte are sorted, and windows between are told apart by the bytes before.
    """
    count = len(contexts)
    rows = np.zeros((count, ROW), np.uint8)
    begin = ANCHOR_COLUMN - left
    sizes = windows - 1 + length
    at = np.arange(sizes.sum()) + np.repeat(begin + np.arange(count) * ROW - (np.cumsum(sizes) - sizes), sizes)
    rows.reshape(-1)[at] = np.frombuffer(b"".join(contexts), np.uint8)
    letters = rows.view(">u8").astype(np.uint64)
    ends = begin + windows - 1 + length
    first, last = -(-begin // LETTER), -(-ends // LETTER)
    dup = np.zeros((count, 72), bool)
    per = last - first + 1
    offsets = np.concatenate([[0], np.cumsum(per)])
    piece = np.repeat(np.arange(count), per)
    column = np.arange(offsets[-1]) - offsets[piece] + first[piece]
    divider = column == last[piece]
    values = letters[piece, np.minimum(column, letters.shape[1] - 1)]
    names = names_of(values[~divider]) + 2
    s = np.ones(len(values), np.int64)
    s[~divider] = names
    sa = np.array(suffix_array(s.tolist())[1:])
    sa = sa[~divider[sa]]
    p, j = piece[sa], column[sa]
    # common prefixes of neighbours, in bytes, as far as a window reaches
    reach = -(-length // LETTER) + 1
    wide = np.concatenate([letters, np.zeros((count, reach), np.uint64)], axis=1)
    ahead = wide[p[:, None], j[:, None] + np.arange(reach)]
    differ = ahead[1:] ^ ahead[:-1]
    same = differ == 0
    whole = np.where(same.all(axis=1), reach, np.argmin(same, axis=1))
    x = differ[np.arange(len(differ)), np.minimum(whole, reach - 1)]
    common = whole * LETTER + np.where(whole < reach, sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8)), 0)
    for d in range(LETTER):
        start = j * LETTER - d
        ok = (start >= begin[p]) & (start < begin[p] + windows[p])
        if not ok.any():
            continue
        run = np.concatenate([[0], np.cumsum(common < length - d)])[ok]
        head = (wide[p, np.maximum(j - 1, 0)] & np.uint64((1 << (8 * d)) - 1))[ok]
        q, w = p[ok], (start - begin[p])[ok]
        order = np.lexsort((rank[q], head, run))
        again = (run[order][1:] == run[order][:-1]) & (head[order][1:] == head[order][:-1])
        at = order[1:][again]
        dup[q[at], w[at]] = True
    return dup
