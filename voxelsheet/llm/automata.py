"""Probabilistic automata by state merging.

Strings of symbols become a prefix tree with counts. Going through it from the
root, a state is merged with the first earlier one whose outgoing frequencies
agree with its own within a Hoeffding bound, and so on for the states both
lead to; otherwise it becomes a state of its own.
"""

from __future__ import annotations

import math
from collections import deque


class Automaton:
    """States with counts of visits, stops and symbols; state 0 is the start."""

    def __init__(self) -> None:
        self.visits: list[int] = [0]
        self.stops: list[int] = [0]
        self.steps: list[dict[str, list[int]]] = [{}]  # symbol: [state, count]

    @classmethod
    def prefix_tree(cls, strings: list[str]) -> Automaton:
        tree = cls()
        for string in strings:
            state = 0
            tree.visits[0] += 1
            for symbol in string:
                if symbol not in tree.steps[state]:
                    tree.steps[state][symbol] = [len(tree.visits), 0]
                    tree.visits.append(0)
                    tree.stops.append(0)
                    tree.steps.append({})
                step = tree.steps[state][symbol]
                step[1] += 1
                state = step[0]
                tree.visits[state] += 1
            tree.stops[state] += 1
        return tree

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Do the frequencies of both states, and of all pairs they lead to, agree?"""
        open_pairs = [(a, b)]
        seen = set()
        while open_pairs:
            a, b = open_pairs.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n1, n2 = self.visits[a], self.visits[b]
            if not n1 or not n2:
                continue
            if self._differ(self.stops[a], n1, self.stops[b], n2, bound):
                return False
            for symbol in self.steps[a].keys() | self.steps[b].keys():
                s1, s2 = self.steps[a].get(symbol), self.steps[b].get(symbol)
                if self._differ(s1[1] if s1 else 0, n1, s2[1] if s2 else 0, n2, bound):
                    return False
                if s1 and s2:
                    open_pairs.append((s1[0], s2[0]))
        return True

    def merge(self, kept: int, gone: int, parent: tuple[int, str]) -> None:
        """Lead ``parent``'s step to ``kept`` and fold the tree below ``gone`` into it."""
        self.steps[parent[0]][parent[1]][0] = kept
        todo = [(kept, gone)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.visits[a] += self.visits[b]
            self.stops[a] += self.stops[b]
            for symbol, (state, count) in self.steps[b].items():
                if symbol in self.steps[a]:
                    step = self.steps[a][symbol]
                    step[1] += count
                    todo.append((step[0], state))
                else:
                    self.steps[a][symbol] = [state, count]

    def log_chance(self, string: str, floor: float = 1e-4) -> float:
        """Log probability of the string; a step or stop never seen costs ``floor``."""
        total, state = 0.0, 0
        for symbol in string:
            step = self.steps[state].get(symbol) if state is not None else None
            if step is None:
                total += math.log(floor)
                state = None if state is None else 0
            else:
                total += math.log(max(step[1] / self.visits[state], floor))
                state = step[0]
        stop = self.stops[state] / self.visits[state] if state is not None and self.visits[state] else 0.0
        return total + math.log(max(stop, floor))


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    """Merge the prefix tree of the strings; ``alpha`` is the error allowed in calling states different."""
    tree = Automaton.prefix_tree(strings)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    own = [0]
    edge = deque((0, symbol) for symbol in sorted(tree.steps[0]))
    while edge:
        parent, symbol = edge.popleft()
        state = tree.steps[parent][symbol][0]
        if state in own:
            continue
        kept = next((s for s in own if tree.compatible(s, state, bound)), None)
        if kept is None:
            own.append(state)
            edge.extend((state, s) for s in sorted(tree.steps[state]))
        else:
            tree.merge(kept, state, (parent, symbol))
            known = set(own)
            edge = deque((s, c) for s in own for c in sorted(tree.steps[s]) if tree.steps[s][c][0] not in known)
    return tree
