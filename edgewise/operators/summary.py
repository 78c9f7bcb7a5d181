"""Summary aggregation: partial summaries inside tasks, merged per window or over the whole stream.

A summary is a plain Python object of any kind made by ``initial``: ``update`` adds an edge, ``merge`` takes
in another one, ``rows`` turns it into output tuples of ``schema``. What moves between tasks are the partial
summaries themselves, serialized, so a summary need not be a graph: counts and sketches are as good.
The same summary runs on a batch and on a stream.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.operators.forests import forest_components
from edgewise.operators.snapshot import window_end
from edgewise.operators.summaries.adjacency import AdjacencyGraph
from edgewise.operators.summaries.disjoint_set import DisjointSet, SignedComponents
from edgewise.session import materialize

PARTIAL = "w long, part int, state binary"


def as_frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Tuples as a frame that keeps Nones beside integers."""
    return pd.DataFrame(rows, columns=[part.strip().split()[0] for part in schema.split(",")], dtype=object)


@dataclass(frozen=True)
class Summary:
    """``update`` is called as (state, source, target, value); edges with a null end are ignored.

    ``merge_window``: tumbling windows of event time; None treats the whole input as one window, and on a stream
    each micro-batch. ``transient`` gives a result for each window alone; else each window's result holds all before it.
    ``degree`` > 1 merges partial summaries in a tree of that many at a time. Results do not depend on it.
    ``spread`` takes (edges, degree) and gives the rows of a batch without windows, for summaries whose state is as large as the
    graph: partial summaries are then merged over the cluster, not in one task.
    """

    initial: Callable[[], object]
    update: Callable[[object, object, object, object], object]
    merge: Callable[[object, object], object]
    rows: Callable[[object], list[tuple]]
    schema: str
    merge_window: str | None = None
    transient: bool = False
    degree: int = 0
    spread: Callable[[DataFrame, int], DataFrame] | None = None

    def fold(self, state: object, sources: list, targets: list, values: list) -> None:
        for a, b, v in zip(sources, targets, values, strict=True):
            self.update(state, a, b, v)

    def edges_of(self, stream) -> DataFrame:
        """(w, src, dst, value) of the edges with both ends; null values stay None in Python."""
        w = window_end(F.window("ts", self.merge_window)) if self.merge_window else F.lit(0).cast("long")
        value = F.col("value") if "value" in stream.edges.columns else F.lit(None).cast("long")
        times = ["ts"] if self.merge_window and stream.edges.isStreaming else []
        return stream.edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(w.alias("w"), "src", "dst", value.alias("value"), *times)

    def _partial(self, edges: DataFrame) -> DataFrame:
        """The partial summary of each window and partition."""

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            part = 0
            for frame in frames:
                part = int(frame["part"].iat[0]) if len(frame) else part
                frame["value"] = frame["value"].astype(object).where(frame["value"].notna(), None)
                for w, own in frame.groupby("w", sort=False):
                    if w not in held:
                        held[w] = self.initial()
                    self.fold(held[w], own["src"].tolist(), own["dst"].tolist(), own["value"].tolist())
            yield as_frame([(w, part, cloudpickle.dumps(state)) for w, state in held.items()], PARTIAL)

        return edges.withColumn("part", F.spark_partition_id()).mapInPandas(fold, PARTIAL)

    def _combined(self, partial: DataFrame) -> DataFrame:
        """Partial summaries merged by window and part, one at a time."""

        def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state = None, None
            for frame in frames:
                for w, part, blob in zip(frame["w"].tolist(), frame["part"].tolist(), frame["state"], strict=True):
                    if (w, part) != key:
                        if key is not None:
                            yield as_frame([(*key, cloudpickle.dumps(state))], PARTIAL)
                        key, state = (w, part), self.initial()
                    self.merge(state, pickle.loads(blob))
            if key is not None:
                yield as_frame([(*key, cloudpickle.dumps(state))], PARTIAL)

        return partial.repartition("w", "part").sortWithinPartitions("w", "part").mapInPandas(combine, PARTIAL)

    def run(self, stream) -> DataFrame:
        """Rows of ``schema`` with window_end (null without windows)."""
        if stream.edges.isStreaming:
            from edgewise.streaming.processors import run_summary

            return run_summary(self, stream)
        if self.spread and not self.merge_window:
            return self.spread(stream.edges, self.degree).withColumn("window_end", F.lit(None).cast("long"))
        partial = self._partial(self.edges_of(stream))
        if self.degree > 1:
            partial = materialize(partial)
            width = (partial.agg(F.max("part")).first()[0] or 0) + 1
            while width > self.degree:
                partial = self._combined(partial.withColumn("part", F.floor(F.col("part") / self.degree).cast("int")))
                width = -(-width // self.degree)

        def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, state = None, self.initial()
            result = lambda: as_frame([(*r, at) for r in self.rows(state)], f"{self.schema}, window_end long")
            for frame in frames:
                for w, blob in zip(frame["w"].tolist(), frame["state"], strict=True):
                    if at is not None and w != at:
                        yield result()
                        if self.transient:
                            state = self.initial()
                    at = w
                    self.merge(state, pickle.loads(blob))
            if at is not None:
                yield result()

        # Windows on their own are merged apart; a running result needs them in order, one after the other.
        placed = partial.repartition("w") if self.transient else partial.repartition(1)
        merged = placed.sortWithinPartitions("w", "part").mapInPandas(finish, f"{self.schema}, window_end long")
        return merged if self.merge_window else merged.withColumn("window_end", F.lit(None).cast("long"))


def components_summary(merge_window: str | None = None, transient: bool = False, degree: int = 0) -> Summary:
    """(id, component): weakly connected components; a component is named by its smallest vertex."""
    return Summary(
        DisjointSet, lambda s, a, b, v: s.union(a, b), lambda s, o: s.merge(o),
        lambda s: [(x, low) for low, members in s.groups().items() for x in members], "id long, component long",
        merge_window, transient, degree, lambda edges, degree: forest_components(edges, degree=degree)[0].select("id", "component"),
    )


def bipartite_summary(merge_window: str | None = None, transient: bool = False, degree: int = 0) -> Summary:
    """(bipartite, component, id, sign): the two-colouring, or one row (false, null, null, null)."""

    def rows(s: SignedComponents) -> list[tuple]:
        if s.failed:
            return [(False, None, None, None)]
        return [(True, c, v, sign) for c, members in s.components().items() for v, sign in members.items()]

    def spread(edges: DataFrame, degree: int) -> DataFrame:
        sides, failed = forest_components(edges, signed=True, degree=degree)
        if failed:
            return edges.sparkSession.createDataFrame([(False, None, None, None)], "bipartite boolean, component long, id long, sign boolean")
        return sides.select(F.lit(True).alias("bipartite"), "component", "id", (F.col("minus") == 0).alias("sign"))

    return Summary(
        SignedComponents, lambda s, a, b, v: s.add(a, b), lambda s, o: s.merge(o), rows,
        "bipartite boolean, component long, id long, sign boolean", merge_window, transient, degree, spread,
    )


class VertexTotals:
    """Number and sum of the values of the edges that leave each vertex, and the largest value."""

    def __init__(self) -> None:
        self.by_vertex: dict = {}

    def add(self, vertex, n: int, total, most) -> None:
        had = self.by_vertex.get(vertex)
        self.by_vertex[vertex] = (n, total, most) if had is None else (had[0] + n, had[1] + total, max(had[2], most))

    def merge(self, other: VertexTotals) -> None:
        for vertex, own in other.by_vertex.items():
            self.add(vertex, *own)


def totals_summary(merge_window: str | None = None, transient: bool = False, degree: int = 0) -> Summary:
    """(id, edges, total, most) over the values of outgoing edges; edges without a value are ignored."""
    return Summary(
        VertexTotals, lambda s, a, b, v: v is not None and s.add(a, 1, v, v), lambda s, o: s.merge(o),
        lambda s: [(x, *own) for x, own in s.by_vertex.items()], "id long, edges long, total long, most long",
        merge_window, transient, degree,
    )


class TriangleCounter(AdjacencyGraph):
    """The triangles among the edges seen; loops and repeats count nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.triangles = 0

    def add(self, a, b) -> None:
        if a != b and b not in self.near.get(a, ()):
            self.triangles += len(self.near.get(a, set()) & self.near.get(b, set()))
            self.add_edge(a, b)

    def merge(self, other: TriangleCounter) -> None:
        for a, b in other.edges():
            self.add(a, b)


def triangles_summary(merge_window: str | None = None, transient: bool = True, degree: int = 0) -> Summary:
    """(triangles) of each window, or of all before its end; the window form that runs on streams too."""
    return Summary(
        TriangleCounter, lambda s, a, b, v: s.add(a, b), lambda s, o: s.merge(o), lambda s: [(s.triangles,)], "triangles long", merge_window, transient, degree,
    )
