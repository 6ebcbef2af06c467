"""A generalised suffix automaton over any hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """States of all substrings of the sequences added.

    first_end[s] is where, in the order of adding, the first occurrence of state s ends: the value
    that ``add`` was given for that symbol.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.first_end: list[int] = [-1]

    def _clone(self, of: int, length: int) -> int:
        new = len(self.link)
        self.next.append(self.next[of].copy())
        self.link.append(self.link[of])
        self.length.append(length)
        self.first_end.append(self.first_end[of])
        return new

    def add(self, symbols: Iterable, at: int = 0) -> None:
        """Add a sequence whose symbols stand at ``at``, ``at`` + 1, ..."""
        nxt, link, length, first = self.next, self.link, self.length, self.first_end
        last = 0
        for i, c in enumerate(symbols, at):
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = self._clone(q, length[last] + 1)
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(link)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(i)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = self._clone(q, length[p] + 1)
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur

    def walk(self, symbols: Iterable) -> int:
        state = 0
        for c in symbols:
            state = self.next[state][c]
        return state

    def suffix_path(self, state: int) -> Iterator[int]:
        while state > 0:
            yield state
            state = self.link[state]

    def statistics(self, symbols: Iterable, least: int) -> Iterator[tuple[int, int]]:
        """(i, first end) of each position i where the last ``least`` symbols occur in what was added."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for i, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            if size >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    size = length[state]
                yield i, self.first_end[state]
