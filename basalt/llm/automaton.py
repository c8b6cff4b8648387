"""Suffix automata over sequences of words."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """Of several sequences, each with a weight: how often it occurs. States are numbers; 0 is the start."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.counted = False

    def add(self, sequence: Iterable[Hashable], weight: int = 1) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        self.counted, last = False, 0
        for w in sequence:
            q = nexts[last].get(w)
            if q is not None:
                # A prefix that is there already, from another sequence or from within this one.
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, q, w)
                count[last] += weight
                continue
            new = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w: Hashable) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def occurrences(self) -> list[int]:
        """By state, how often its sequences occur in all that was added, weights counted."""
        if not self.counted:
            link, count = self.link, self.count
            for v in np.argsort(-np.array(self.length), kind="stable").tolist():
                if link[v] > 0:
                    count[link[v]] += count[v]
            self.counted = True
        return self.count

    def windows(self, sequence: Sequence[Hashable], size: int) -> list[int]:
        """How often each window of `size` words of the sequence occurs here, by streaming the sequence: the length
        matched so far, held to `size`, and its state."""
        count, nexts, link, length = self.occurrences(), self.next, self.link, self.length
        v = matched = 0
        out = []
        for i, w in enumerate(sequence):
            if matched == size:
                matched -= 1
                if link[v] >= 0 and length[link[v]] >= matched:
                    v = link[v]
            while v and w not in nexts[v]:
                v = link[v]
                matched = length[v]
            if w in nexts[v]:
                v = nexts[v][w]
                matched += 1
            if i >= size - 1:
                out.append(count[v] if matched == size else 0)
        return out


def covered(hits: Sequence[int], size: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) of words covered by windows that begin where hits is true."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.asarray(hits)).tolist():
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + size)
        else:
            out.append((i, i + size))
    return out
