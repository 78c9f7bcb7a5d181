"""Union-find, plain and with parity."""

from __future__ import annotations

from collections.abc import Hashable


class DisjointSet:
    """Disjoint sets with path halving and union by size."""

    def __init__(self) -> None:
        self.parent: dict = {}
        self.size: dict = {}

    def make_set(self, x: Hashable) -> None:
        if x not in self.parent:
            self.parent[x], self.size[x] = x, 1

    def find(self, x: Hashable):
        """The root of ``x``, or None if it was never added."""
        parent = self.parent
        if x not in parent:
            return None
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: Hashable, b: Hashable) -> bool:
        """Join the sets of two elements, adding them if need be; whether that changed anything."""
        self.make_set(a)
        self.make_set(b)
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size.pop(b)
        return True

    def merge(self, other: DisjointSet) -> None:
        for x in other.parent:
            self.union(x, other.find(x))

    def groups(self) -> dict:
        """Members by their smallest member."""
        by_root: dict = {}
        for x in self.parent:
            by_root.setdefault(self.find(x), []).append(x)
        return {min(members): sorted(members) for members in by_root.values()}

    def __len__(self) -> int:
        return len(self.parent)

    def __str__(self) -> str:
        return str(self.groups())


class SignedComponents:
    """Two-colouring: union-find over (vertex, side), so an odd cycle, a loop included, ties both sides of a vertex."""

    def __init__(self) -> None:
        self.sides = DisjointSet()
        self.failed = False

    def add(self, a: Hashable, b: Hashable) -> bool:
        """Put the ends of an edge on opposite sides; False once that is impossible."""
        self.sides.union((a, True), (b, False))
        self.sides.union((a, False), (b, True))
        self.failed |= self.sides.find((a, True)) == self.sides.find((a, False))
        return not self.failed

    def merge(self, other: SignedComponents) -> None:
        self.sides.merge(other.sides)
        self.failed |= other.failed or any(self.sides.find((v, True)) == self.sides.find((v, False)) for v, side in other.sides.parent if side)

    def components(self) -> dict:
        """Component (smallest vertex) to vertex to sign; the smallest has sign True. Empty if there is no colouring."""
        if self.failed:
            return {}
        out: dict = {}
        for members in self.sides.groups().values():
            low = min(v for v, _ in members)
            if (low, True) in members:
                out[low] = {v: side for v, side in members}
        return out
