"""A graph of few short cycles that answers quickly whether two vertices are at most k steps apart."""

from __future__ import annotations

from edgewise.operators.summaries.adjacency import AdjacencyGraph


class SpannerGraph(AdjacencyGraph):
    """Adjacency lists with an index of the pairs that are two steps apart.

    A vertex of fewer than ``HEAVY`` neighbours enters the pairs of its neighbours into ``two``; one of more is listed as ``heavy`` at
    each of its neighbours instead. Whether two vertices have a common neighbour is then one lookup and a walk over few
    heavy ones, however large a hub is. At most ``HEAVY`` / 2 pairs an edge are held.
    """

    HEAVY = 32

    def __init__(self) -> None:
        super().__init__()
        self.two: dict = {}
        self.heavy: dict = {}

    def reset(self) -> None:
        super().reset()
        self.two.clear()
        self.heavy.clear()

    def add_edge(self, a, b) -> None:
        if b in self.near.get(a, ()):
            return
        for mid, end in ((a, b), (b, a)) if a != b else ((a, b),):
            near = self.near.setdefault(mid, set())
            if len(near) < self.HEAVY:
                for other in near:
                    self.two.setdefault(other, set()).add(end)
                    self.two.setdefault(end, set()).add(other)
            near.add(end)
            if len(near) == self.HEAVY + 1:
                for other in near:
                    self.heavy.setdefault(other, set()).add(mid)
            elif len(near) > self.HEAVY:
                self.heavy.setdefault(end, set()).add(mid)

    def _share(self, a, b) -> bool:
        """Whether a vertex is next to both."""
        if b in self.two.get(a, ()):
            return True
        p, q = self.heavy.get(a), self.heavy.get(b)
        return bool(p and q and not p.isdisjoint(q))

    def within(self, a, b, k: int) -> bool:
        if k != 3:
            return super().within(a, b, k)
        p, q = self.near.get(a), self.near.get(b)
        if p is None:
            return False
        if a == b:
            return True
        if q is None:
            return False
        if b in p:
            return True
        if len(q) < len(p):
            a, b, p = b, a, q
        # A walk of three steps leaves by the end with fewer neighbours.
        return self._share(a, b) or any(self._share(x, b) for x in p)
