"""A generalised suffix automaton of token sequences, in arrays, shared by the operators on passages and on repeats."""

from __future__ import annotations

from array import array


class TokenAutomaton:
    """Generalised suffix automaton of runs of token numbers, in arrays: of each state its length, suffix link and first move;
    the few further moves of branching states are in one table."""

    def __init__(self, runs: list[list[int]]):
        size = 2 * sum(map(len, runs)) + 2
        length, link, token, target = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        twice = bytearray(size)  # copied states, and states that a run reaches again, stand for repeats
        more: dict[int, dict[int, int]] = {}
        ends: list[array] = []
        n = 1

        def split(p: int, t: int, q: int) -> int:
            nonlocal n
            clone, n = n, n + 1
            length[clone], link[clone], token[clone], target[clone], twice[clone] = length[p] + 1, link[q], token[q], target[q], 1
            if q in more:
                more[clone] = dict(more[q])
            while p >= 0:
                if token[p] == t:
                    if target[p] != q:
                        break
                    target[p] = clone
                elif p in more and more[p].get(t) == q:
                    more[p][t] = clone
                else:
                    break
                p = link[p]
            link[q] = clone
            return clone

        for run in runs:
            last, at = 0, array("i")
            for t in run:
                q = target[last] if token[last] == t else more[last].get(t, -1) if last in more else -1
                if q >= 0:  # an earlier run holds this passage
                    last = q if length[q] == length[last] + 1 else split(last, t, q)
                    twice[last] = 1
                else:
                    new, n = n, n + 1
                    length[new] = length[last] + 1
                    p = last
                    while p >= 0:
                        if token[p] == t:
                            q = target[p]
                            break
                        if p in more:
                            if (q := more[p].get(t, -1)) >= 0:
                                break
                            more[p][t] = new
                        elif token[p] < 0:
                            token[p], target[p] = t, new
                        else:
                            more[p] = {t: new}
                        p = link[p]
                    link[new] = 0 if p < 0 else q if length[q] == length[p] + 1 else split(p, t, q)
                    last = new
                at.append(last)
            ends.append(at)
        for up in link[1:n]:
            twice[up] = 1
        # cut to size
        self.length, self.link, self.token, self.target = length[:n], link[:n], token[:n], target[:n]
        self.twice, self.more, self.ends = twice[:n], more, ends

    def move(self, state: int, t: int) -> int:
        """The state behind a token, or -1."""
        if self.token[state] == t:
            return self.target[state]
        return self.more[state].get(t, -1) if state in self.more else -1
