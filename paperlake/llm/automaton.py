"""Suffix automaton of a shard of token sequences, and matching statistics of sequences streamed through it."""

from __future__ import annotations


class SuffixAutomaton:
    """Built online from sequences; ``count[v]`` is how many places of the shard the state's strings end at.

    ``weights`` tells how often each sequence stands in the corpus.
    """

    def __init__(self, sequences, weights=None):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        for i, sequence in enumerate(sequences):
            self._add(sequence, 1 if weights is None else weights[i])
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            self.count[self.link[v]] += self.count[v]

    def _add(self, sequence, weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0  # a fresh start makes it a generalised automaton: nothing crosses sequences
        for t in sequence:
            have = nxt[last].get(t)
            if have is not None and length[have] == length[last] + 1:
                last = have
                count[last] += weight
                continue
            if have is not None:
                last = self._clone(last, have, t)
                count[last] += weight
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p >= 0 and t not in nxt[p]:
                nxt[p][t] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][t]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, t)
            last = new

    def _clone(self, p: int, q: int, t) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = copy
            p = link[p]
        return copy

    def repeats(self, sequence, least: int) -> list[tuple[int, int]]:
        """Maximal (start, end) spans of a sequence of the shard that are covered by strings with two places or more.

        Matching statistics: after each token the state of the longest suffix that ends at two places of the shard.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        spans: list[list[int]] = []
        v = matched = 0
        for i, t in enumerate(sequence, 1):
            while v and t not in nxt[v]:
                v = link[v]
                matched = length[v]
            if t in nxt[v]:
                v = nxt[v][t]
                matched += 1
            else:
                v = matched = 0
            while v and count[v] < 2:
                v = link[v]
                matched = length[v]
            if matched >= least:
                a = i - matched
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = i
                    if a < spans[-1][0]:
                        spans[-1][0] = a
                else:
                    spans.append([a, i])
        return [(a, b) for a, b in spans]
