"""Suffix sorting by linear grouping (two phases, no recursion, no renaming).

Phase 1 puts suffixes into groups of equal Lyndon prefix. Groups are taken in descending
order; each of a group's suffixes gets its previous-smaller pointer (the nearest suffix
before it that is in a lower group), and the suffixes pointed at leave their groups for new
ones just above, those with more pointers higher. Phase 2 goes through the order from the
smallest suffix on and writes, along previous-smaller pointers, each suffix to the next
free place of its group.
"""

from __future__ import annotations


def suffix_array(text) -> list[int]:
    """Start positions of the suffixes of a sequence of small non-negative integers (bytes), sorted."""
    n = len(text)
    if n == 0:
        return []
    s = [c + 1 for c in text]
    s.append(0)  # smaller than all
    n += 1
    width = max(s) + 1
    count = [0] * width
    for c in s:
        count[c] += 1
    first = [0] * width
    at = 0
    for c in range(width):
        first[c] = at
        at += count[c]
    # order: suffixes by group; group[i]: first place of i's group; size by first place
    place = first[:]
    order, where, group = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        order[place[c]] = i
        where[i] = place[c]
        group[i] = first[c]
        place[c] += 1
    size = [0] * n
    for c in range(width):
        if count[c]:
            size[first[c]] = count[c]
    prev = [-1] * n
    pointers = [0] * n
    top = n
    while top > 0:
        g = group[order[top - 1]]
        members = order[g:top]
        members.sort()
        found = []
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                if not pointers[j]:
                    found.append(j)
                pointers[j] += 1
        if found:
            if len(found) > 1:
                found.sort(key=pointers.__getitem__, reverse=True)
            k, m = 0, len(found)
            while k < m:
                times, leaving = pointers[found[k]], {}
                while k < m and pointers[found[k]] == times:
                    j = found[k]
                    leaving.setdefault(group[j], []).append(j)
                    k += 1
                for old, own in leaving.items():
                    rest = size[old] - len(own)
                    if rest == 0:
                        continue  # the whole group moves, so nothing does
                    at = old + rest
                    size[old], size[at] = rest, len(own)
                    # the leaving ones to the end of the old group's places
                    end = at + len(own)
                    for j in own:
                        end -= 1
                        w, other = where[j], order[end]
                        order[w], order[end] = other, j
                        where[other], where[j] = w, end
                        group[j] = at
            for j in found:
                pointers[j] = 0
        top = g
    free = list(range(n))  # next free place by group
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out[1:]
