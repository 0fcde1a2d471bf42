"""Linear-time suffix sorting by grouping (Baier 2016).

Phase 1 refines suffixes into groups that share their Lyndon prefix: groups
are taken in descending order, each member finds the previous suffix of a
lower group, and the suffixes found are split off upwards, those with more
members pointing at them higher. Phase 2 walks the suffix array from its
smallest entry; the suffix before an entry and the chain of its previous
smaller suffixes are the next ones of their groups. No renaming, no recursion.

``suffix_array`` sorts one text. ``suffix_arrays`` takes many texts side by
side: in each step every text handles its own highest group (its own next
entry in phase 2), as array operations over all texts. Texts much longer
than the others would step almost alone and are sorted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from strata.llm.textops import ragged

STEP_COST = 20  # a step of all texts costs about as much as these many characters in a text alone


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (small integers) in ascending order;
    a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    size = [0] * (max(text) + 1)
    for c in text:
        size[c] += 1
    start, total = [], 0
    for c in size:
        start.append(total)
        total += c
    group = [start[c] for c in text]          # a group is named by the place of its first member
    end = {s: s + c for s, c in zip(start, size) if c}
    place, sa, free = [0] * n, [0] * n, list(start)
    for i, c in enumerate(text):
        place[i] = free[c]
        sa[free[c]] = i
        free[c] += 1

    before: list[int] = [-2] * n              # previous suffix of a lower group, -2 while unknown
    top = n
    while top:
        low = group[sa[top - 1]]
        pointing: dict[int, int] = {}
        for i in sa[low:top]:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j] if before[j] != -2 else j - 1
            before[i] = j
            if j >= 0:
                pointing[j] = pointing.get(j, 0) + 1
        if pointing:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, count in pointing.items():
                by_count.setdefault(count, {}).setdefault(group[j], []).append(j)
            for count in sorted(by_count, reverse=True):
                for g, members in by_count[count].items():
                    stop = end[g]
                    first = stop - len(members)
                    if first == g:
                        continue              # all that is left of the group
                    at = stop
                    for j in members:         # swap to the end of the group
                        at -= 1
                        p, other = place[j], sa[at]
                        sa[p], sa[at] = other, j
                        place[other], place[j] = p, at
                        group[j] = first
                    end[g], end[first] = first, stop
        top = low

    placed = [False] * n
    free_at = {g: g for g in end}
    out = [0] * n
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = group[j]
            out[free_at[g]] = j
            free_at[g] += 1
            j = before[j]
    return out


def suffix_arrays(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts ``data[off[k]: off[k + 1]]`` (small
    integers), one after another; starts count from the text's own."""
    out = np.zeros(len(data), np.int64)
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    # the longest texts alone, as many as make the whole cheapest
    ahead = np.append(0, np.cumsum(size[order]))
    alone = int(np.argmin(ahead + STEP_COST * np.append(size[order], 0)))
    for k in order[:alone].tolist():
        out[off[k]: off[k + 1]] = suffix_array(data[off[k]: off[k + 1]].tolist())
    rest = order[alone:][size[order[alone:]] > 0]
    if len(rest):
        from_, n = off[rest], size[rest]
        at = ragged(from_, n)
        out[at] = _side_by_side(data[at].astype(np.int64), n)
    return out


def _side_by_side(chars: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``suffix_arrays`` of texts that lie one after another, none empty. Before
    each text stands a guard, a place of no group."""
    base = np.cumsum(size + 1) - size
    n = int(base[-1] + size[-1])
    spots = ragged(base, size)
    label = np.repeat(np.arange(len(size)), size) * (int(chars.max()) + 1) + chars
    order = np.argsort(label, kind="stable")
    label = label[order]
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    count = np.diff(np.append(first, len(label)))
    sa, place, group, end = (np.full(n, -1) for _ in range(4))
    sa[spots] = spots[order]
    place[spots[order]] = spots
    group[spots[order]] = np.repeat(spots[first], count)
    end[spots[first]] = spots[first] + count
    before = np.arange(n) - 1                 # previous suffix of a lower group, the one before while unknown
    moved = np.zeros(n, bool)

    top, floor = base + size, base
    while len(top):
        low = group[sa[top - 1]]
        members = top - low
        one = members == 1
        if one.all():
            many, i, bound = None, sa[low], low
        else:
            many = np.repeat(~one, members)
            i, bound = sa[ragged(low, members)], np.repeat(low, members)
        step, least = i, bound
        while len(step):                      # each jump takes what the one it lands on has found
            j = before[step]
            go = group[j] >= least
            step, least = step[go], least[go]
            before[step] = before[j[go]]
        j = before[i]
        pointed = group[j] >= 0
        alone = j[pointed if many is None else pointed & ~many]
        g = group[alone]                      # one for each text: swap to the end of the group
        at = end[g] - 1
        go = at > g
        alone, g, at = alone[go], g[go], at[go]
        p, other = place[alone], sa[at]
        sa[p], place[other] = other, p
        sa[at], place[alone] = alone, at
        group[alone], end[at], end[g] = at, at + 1, at
        if many is not None:
            _split(j[pointed & many], sa, place, group, end, moved)
        top = low
        go = top > floor
        if not go.all():
            top, floor = top[go], floor[go]

    placed = np.zeros(n, bool)
    placed[base - 1] = True
    free, out = np.arange(n), np.zeros(n, np.int64)
    k, stop = base - 1, base + size
    j = stop - 1
    while len(j):
        go = np.flatnonzero(~placed[j])
        at = j[go]
        placed[at] = True
        g = group[at]
        f = free[g]
        out[f] = at
        free[g] = f + 1
        j[go] = before[at]
        go = np.flatnonzero(placed[j])
        k[go] += 1
        on = k < stop
        if not on.all():
            j, k, stop = j[on], k[on], stop[on]
            go = np.flatnonzero(placed[j])
        j[go] = out[k[go]] - 1
    return out[spots] - np.repeat(base, size)


def _split(j: np.ndarray, sa: np.ndarray, place: np.ndarray, group: np.ndarray, end: np.ndarray, moved: np.ndarray) -> None:
    """Split the suffixes ``j`` off the ends of their groups, those named more often higher."""
    if not len(j):
        return
    j = np.sort(j)
    first = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
    count = np.diff(np.append(first, len(j)))
    j = j[first]
    g = group[j]
    order = np.lexsort((count, g))
    j, g, count = j[order], g[order], count[order]
    new = np.append(True, g[1:] != g[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(j)))
    begin = end[g[first]] - number
    to = ragged(begin, number)
    # what stays leaves the end of its group for the places of what comes there
    moved[j] = True
    here, p = sa[to], place[j]
    stay, left = here[~moved[here]], p[p < np.repeat(begin, number)]
    moved[j] = False
    sa[left], place[stay] = stay, left
    sa[to], place[j] = j, to
    new[1:] |= count[1:] != count[:-1]
    name = np.flatnonzero(new)
    number = np.diff(np.append(name, len(j)))
    end[g[first]] = begin
    end[to[name]] = to[name] + number
    group[j] = np.repeat(to[name], number)
