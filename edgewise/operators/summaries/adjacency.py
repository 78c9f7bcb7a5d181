"""Adjacency lists with a depth-bounded search."""

from __future__ import annotations


class AdjacencyGraph:
    def __init__(self) -> None:
        self.near: dict = {}

    def add_edge(self, a, b) -> None:
        self.near.setdefault(a, set()).add(b)
        self.near.setdefault(b, set()).add(a)

    def reset(self) -> None:
        self.near.clear()

    def within(self, a, b, k: int) -> bool:
        """Whether ``b`` is at most ``k`` steps from ``a``; False for a vertex never seen."""
        if a not in self.near:
            return False
        seen, layer = {a}, [a]
        if a == b:
            return True
        for _ in range(k):
            layer = [y for x in layer for y in self.near[x] if y not in seen and not seen.add(y)]
            if b in seen:
                return True
        return False

    def edges(self) -> list[tuple]:
        return sorted({(min(a, b), max(a, b)) for a in self.near for b in self.near[a]})
