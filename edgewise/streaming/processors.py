"""Stateful operators on streams of edges, for transformWithState on the RocksDB state store.

Within a micro-batch the rows of a key are taken in the order of ``seq``; across micro-batches, files
must arrive in that order. Algorithms that depend on the order of all edges use one key, as a
running summary has to; edges are thinned to partial summaries before they get there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from edgewise.operators.edge_stream import EdgeStream
from edgewise.operators.summaries.adjacency import AdjacencyGraph
from edgewise.operators.summary import Summary, bipartite_summary, components_summary

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State store settings that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ordered(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r["seq"])


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithState(processor, schema, "Append", "None")


class RunningCount(StatefulProcessor):
    """(id, degree) for each event of a vertex."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        for _ in _ordered(rows):
            n += 1
            yield Row(id=key[0], degree=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """(n) whenever a vertex is new, for the single key of the whole stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        for _ in rows:
            n += 1
            yield Row(n=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


class DegreeChange(StatefulProcessor):
    """From (id, op, seq) to (degree, change, seq): the degree that gains a vertex, then the one that loses it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.degree = handle.getValueState("degree", "d long")

    def handleInputRows(self, key, rows, timerValues):
        d = self.degree.get()[0] if self.degree.exists() else 0
        for r in _ordered(rows):
            old, d = d, max(0, d + r["op"])
            if d == old:
                continue
            if d > 0:
                yield Row(degree=d, change=1, seq=r["seq"] * 2)
            if old > 0:
                yield Row(degree=old, change=-1, seq=r["seq"] * 2 + 1)
        self.degree.update((d,))

    def close(self) -> None:
        pass


class DegreeCount(StatefulProcessor):
    """(degree, vertices, seq) for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        for r in _ordered(rows):
            n += r["change"]
            yield Row(degree=key[0], vertices=n, seq=r["seq"])
        self.count.update((n,))

    def close(self) -> None:
        pass


def _rows_of(summary: Summary, state: object, end: int | None) -> Iterator[Row]:
    names = [part.strip().split()[0] for part in summary.schema.split(",")]
    for r in summary.rows(state):
        yield Row(**dict(zip(names, r, strict=True)), window_end=end)


class SummaryBatches(StatefulProcessor):
    """The whole summary after each micro-batch, from the serialized partial summaries of its tasks."""

    def __init__(self, summary: Summary):
        self.summary = summary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        known = self.state.exists() and not self.summary.transient
        state = pickle.loads(self.state.get()[0]) if known else self.summary.initial()
        for r in rows:
            self.summary.merge(state, pickle.loads(r["state"]))
        self.state.update((cloudpickle.dumps(state),))
        yield from _rows_of(self.summary, state, None)

    def close(self) -> None:
        pass


class SummaryWindows(StatefulProcessor):
    """The summary of each window of event time once the watermark has passed it; with all before it unless it is transient."""

    def __init__(self, summary: Summary):
        self.summary = summary

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "w long", "state binary")
        self.total = handle.getValueState("total", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict = {}
        for r in rows:
            w = r["w"]
            if w not in fresh:
                fresh[w] = pickle.loads(self.open.getValue((w,))[0]) if self.open.containsKey((w,)) else self.summary.initial()
                self.handle.registerTimer(w + 1)
            self.summary.update(fresh[w], r["src"], r["dst"], r["value"])
        for w, state in fresh.items():
            self.open.updateValue((w,), (cloudpickle.dumps(state),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        w = expiredTimerInfo.getExpiryTimeInMs() - 1
        if not self.open.containsKey((w,)):
            return
        state = pickle.loads(self.open.getValue((w,))[0])
        self.open.removeKey((w,))
        if not self.summary.transient:
            total = pickle.loads(self.total.get()[0]) if self.total.exists() else self.summary.initial()
            self.summary.merge(total, state)
            self.total.update((cloudpickle.dumps(total),))
            state = total
        yield from _rows_of(self.summary, state, w)

    def close(self) -> None:
        pass


class VertexFold(StatefulProcessor):
    """For each row of a key the output of a function that may change the key's state, any Python object."""

    def __init__(self, initial, step, names: list[str], changes_only: bool):
        self.initial, self.step, self.names, self.changes_only = initial, step, names, changes_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        state, last = pickle.loads(self.state.get()[0]) if self.state.exists() else (self.initial(), None)
        for r in _ordered(rows):
            state, out = self.step(state, r["id"], r["value"])
            if not (self.changes_only and out == last):
                yield Row(**dict(zip(self.names, out, strict=True)))
            last = out
        self.state.update((cloudpickle.dumps((state, last)),))

    def close(self) -> None:
        pass


class Neighborhood(StatefulProcessor):
    """(src, dst, neighbors) after each edge of a vertex; the state is the set of its neighbours."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getMapState("near", "id long", "one int")

    def handleInputRows(self, key, rows, timerValues):
        near = {k[0] for k in self.near.keys()}
        for r in _ordered(rows):
            if r["dst"] not in near:
                near.add(r["dst"])
                self.near.updateValue((r["dst"],), (1,))
            yield Row(src=key[0], dst=r["dst"], neighbors=sorted(near))

    def close(self) -> None:
        pass


class Matching(StatefulProcessor):
    """Weighted matching events (event, src, dst, value); the state has an entry for each matched vertex."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getMapState("at", "id long", "src long, dst long, value long")

    def handleInputRows(self, key, rows, timerValues):
        for r in _ordered(rows):
            edge = (r["src"], r["dst"], r["value"])
            against = list(dict.fromkeys(tuple(self.at.getValue((v,))) for v in edge[:2] if self.at.containsKey((v,))))
            if edge[2] > 2 * sum(e[2] for e in against):
                for e in against:
                    for v in set(e[:2]):
                        self.at.removeKey((v,))
                    yield Row(event="REMOVE", src=e[0], dst=e[1], value=e[2])
                for v in set(edge[:2]):
                    self.at.updateValue((v,), edge)
                yield Row(event="ADD", src=edge[0], dst=edge[1], value=edge[2])

    def close(self) -> None:
        pass


class SpannerEdges(StatefulProcessor):
    """Edges that a greedy k-spanner keeps; the state is the spanner."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "src long, dst long", "one int")

    def handleInputRows(self, key, rows, timerValues):
        graph = AdjacencyGraph()
        for a, b in self.kept.keys():
            graph.add_edge(a, b)
        for r in _ordered(rows):
            if not graph.within(r["src"], r["dst"], self.k):
                graph.add_edge(r["src"], r["dst"])
                self.kept.updateValue((r["src"], r["dst"]), (1,))
                yield Row(src=r["src"], dst=r["dst"])

    def close(self) -> None:
        pass


class TriangleSampler(StatefulProcessor):
    """A shard of reservoir samplers: (shard, edges, beta) whenever beta, the samplers that hold a closed triangle, changes.

    A sampler takes edge i with chance 1/i by a seeded hash of (seed, sampler, i), so reruns agree.
    """

    def __init__(self, vertices: int, per_shard: int, seed: int):
        self.vertices, self.per_shard, self.seed = vertices, per_shard, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, beta long")
        self.held = handle.getMapState("held", "sampler int", "a long, b long, c long, first boolean, second boolean")

    def handleInputRows(self, key, rows, timerValues):
        import random

        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        held = {k[0]: list(v) for k, v in self.held.iterator()}
        touched = set()
        for r in _ordered(rows):
            n += 1
            ends = {r["src"], r["dst"]}
            for s in range(self.per_shard):
                rng = random.Random(f"{self.seed}:{key[0]}:{s}:{n}")
                if rng.random() * n < 1:
                    c = rng.randrange(self.vertices)
                    while c in ends and self.vertices > 2:
                        c = rng.randrange(self.vertices)
                    held[s] = [r["src"], r["dst"], c, False, False]
                    touched.add(s)
                elif s in held:
                    a, b, c, first, second = held[s]
                    if ends == {a, c} and not first:
                        held[s][3] = True
                        touched.add(s)
                    elif ends == {b, c} and not second:
                        held[s][4] = True
                        touched.add(s)
            beta = sum(1 for h in held.values() if h[3] and h[4])
            if beta != last:
                last = beta
                yield Row(shard=key[0], edges=n, beta=beta)
        for s in touched:
            self.held.updateValue((s,), tuple(held[s]))
        self.seen.update((n, last))

    def close(self) -> None:
        pass


class IncidenceRouter(StatefulProcessor):
    """Holds the coins and samples of all samplers, and forwards to their shards only new samples and edges that touch one.

    Keeping edge i with chance 1/i means that the sample drawn at i is next replaced at floor(i / u) + 1 for a
    uniform u, so a sampler costs nothing between its draws. u comes from the seed, the sampler and i.
    """

    def __init__(self, vertices: int, samplers: int, shards: int, seed: int):
        self.vertices, self.samplers, self.shards, self.seed = vertices, samplers, shards, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        import heapq
        import random

        known = self.state.exists()
        n, due, held, near = pickle.loads(self.state.get()[0]) if known else (0, [(1, s) for s in range(self.samplers)], {}, {})
        for r in _ordered(rows):
            n += 1
            a, b = r["src"], r["dst"]
            fresh = set()
            while due[0][0] == n:
                s = due[0][1]
                rng = random.Random(f"{self.seed}:{s}:{n}")
                heapq.heapreplace(due, (int(n / (1 - rng.random())) + 1, s))
                c = rng.randrange(self.vertices)
                while c in (a, b) and self.vertices > 2:
                    c = rng.randrange(self.vertices)
                for v in held.get(s, ()):
                    near[v].discard(s)
                held[s] = {a, b}
                for v in (a, b):
                    near.setdefault(v, set()).add(s)
                fresh.add(s)
                yield Row(shard=s % self.shards, sampler=s, a=a, b=b, c=c, seq=n)
            for s in (near.get(a, set()) | near.get(b, set())) - fresh:
                yield Row(shard=s % self.shards, sampler=s, a=a, b=b, c=None, seq=n)
        self.state.update((cloudpickle.dumps((n, due, held, near)),))

    def close(self) -> None:
        pass


class HeldSamples(StatefulProcessor):
    """A shard of samplers behind the router: (shard, edges, beta) whenever beta changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "sampler int", "a long, b long, c long, first boolean, second boolean")
        self.last = handle.getValueState("last", "beta long")

    def handleInputRows(self, key, rows, timerValues):
        beta = self.last.get()[0] if self.last.exists() else 0
        for r in _ordered(rows):
            s = (r["sampler"],)
            old = list(self.held.getValue(s)) if self.held.containsKey(s) else [None, None, None, False, False]
            if r["c"] is not None:
                new = [r["a"], r["b"], r["c"], False, False]
            else:
                a, b, c, first, second = old
                ends = {r["a"], r["b"]}
                new = [a, b, c, first or ends == {a, c}, second or ends == {b, c}]
            if new != old:
                self.held.updateValue(s, tuple(new))
            change = (new[3] and new[4]) - (old[3] and old[4])
            if change:
                beta += change
                yield Row(shard=key[0], edges=r["seq"], beta=beta)
        self.last.update((beta,))

    def close(self) -> None:
        pass


class EstimateOnChange(StatefulProcessor):
    """(edges, beta, estimate) over all shards, whenever the estimate changes."""

    def __init__(self, vertices: int, samplers: int):
        self.vertices, self.samplers = vertices, samplers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.betas = handle.getMapState("betas", "shard int", "beta long")
        self.last = handle.getValueState("last", "edges long, estimate long")

    def handleInputRows(self, key, rows, timerValues):
        edges, last = self.last.get() if self.last.exists() else (0, None)
        betas = {k[0]: v[0] for k, v in self.betas.iterator()}
        for r in sorted(rows, key=lambda r: r["edges"]):
            betas[r["shard"]] = r["beta"]
            self.betas.updateValue((r["shard"],), (r["beta"],))
            edges = max(edges, r["edges"])
            estimate = int(sum(betas.values()) / self.samplers * edges * (self.vertices - 2))
            if estimate != last:
                last = estimate
                yield Row(edges=edges, beta=sum(betas.values()), estimate=estimate)
        self.last.update((edges, last))

    def close(self) -> None:
        pass


class TriangleTrace(StatefulProcessor):
    """(id, triangles) of each vertex of a new triangle, and the count over the graph as id -1, at the triangle's last edge."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state binary")

    def handleInputRows(self, key, rows, timerValues):
        near, counts = pickle.loads(self.state.get()[0]) if self.state.exists() else ({}, {})
        for r in _ordered(rows):
            a, b = r["src"], r["dst"]
            if a == b or b in near.get(a, ()):
                continue
            third = near.get(a, set()) & near.get(b, set())
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            for v, more in [*((c, 1) for c in third), *((v, len(third)) for v in (a, b, -1) if third)]:
                counts[v] = counts.get(v, 0) + more
                yield Row(id=v, triangles=counts[v], seq=r["seq"])
        self.state.update((cloudpickle.dumps((near, counts)),))

    def close(self) -> None:
        pass


# --- operators on streams --------------------------------------------------------------------------


def degrees(stream: EdgeStream, sources: bool = True, targets: bool = True) -> DataFrame:
    """Running degree for each event."""
    return _run(stream._ends(sources, targets).select("id", "seq"), ["id"], RunningCount(), "id long, degree long")


def number_of_vertices(stream: EdgeStream) -> DataFrame:
    fresh = stream._ends().select("id").dropDuplicates(["id"]).withColumn("all", F.lit(0))
    return _run(fresh, ["all"], FirstSeen(), "n long")


def number_of_edges(stream: EdgeStream) -> DataFrame:
    return _run(stream.edges.select(F.lit(0).alias("all")), ["all"], FirstSeen(), "n long")


def degree_distribution(events: DataFrame) -> DataFrame:
    """(degree, vertices, seq) trace of additions and deletions (src, dst, op, seq)."""
    ends = events.select(F.posexplode(F.array("src", "dst")).alias("o", "id"), "op", "seq").select("id", "op", (F.col("seq") * 2 + F.col("o")).alias("seq"))
    changes = _run(ends, ["id"], DegreeChange(), "degree long, change int, seq long")
    return _run(changes, ["degree"], DegreeCount(), "degree long, vertices long, seq long")


def run_summary(summary: Summary, stream: EdgeStream) -> DataFrame:
    """A summary on a stream: by windows of event time, or after each micro-batch if it has none.

    Windows on their own are kept apart by key; a running result needs all of them under one.
    """
    schema = f"{summary.schema}, window_end long"
    edges = summary.edges_of(stream)
    if summary.merge_window is None:
        partial = summary._partial(edges).withColumn("all", F.lit(0))
        return _run(partial, ["all"], SummaryBatches(summary), schema)
    key = F.col("w") if summary.transient else F.lit(0).cast("long")
    return edges.withColumn("key", key).groupBy("key").transformWithState(SummaryWindows(summary), schema, "Append", "EventTime")


def components(stream: EdgeStream) -> DataFrame:
    """The whole summary (id, component) after each micro-batch; partitions send their own summaries, not edges."""
    return run_summary(components_summary(), stream).drop("window_end")


def bipartite_sides(stream: EdgeStream) -> DataFrame:
    """(bipartite, component, id, sign) after each micro-batch."""
    return run_summary(bipartite_summary(), stream).drop("window_end")


def fold_vertices(stream: EdgeStream, edge_mapper, initial, step, schema: str, changes_only: bool = False, whole: bool = False) -> DataFrame:
    """``EdgeStream.fold_vertices`` on a stream."""
    rows = stream._mapped(edge_mapper).withColumn("key", F.lit(0).cast("long") if whole else F.col("id"))
    names = [part.strip().split()[0] for part in schema.split(",")]
    return _run(rows, ["key"], VertexFold(initial, step, names, changes_only), schema)


def neighborhood(stream: EdgeStream, directed: bool = False) -> DataFrame:
    """(src, dst, neighbors) after each edge."""
    df = (stream if directed else stream.undirected()).edges
    return _run(df.select("src", "dst", "seq"), ["src"], Neighborhood(), "src long, dst long, neighbors array<long>")


def matching(stream: EdgeStream) -> DataFrame:
    rows = stream.edges.select("src", "dst", "value", "seq", F.lit(0).alias("all"))
    return _run(rows, ["all"], Matching(), "event string, src long, dst long, value long")


def spanner(stream: EdgeStream, k: int = 3) -> DataFrame:
    return _run(stream.edges.select("src", "dst", "seq", F.lit(0).alias("all")), ["all"], SpannerEdges(k), "src long, dst long")


def triangle_betas(stream: EdgeStream, vertices: int, shards: int = 4, per_shard: int = 64, seed: int = 0xDEADBEEF) -> DataFrame:
    """(shard, edges, beta); an estimate is sum of the latest betas / samplers * edges * (vertices - 2)."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    return _run(stream.edges.select(every, "src", "dst", "seq"), ["shard"], TriangleSampler(vertices, per_shard, seed), "shard int, edges long, beta long")


def triangle_betas_incidence(stream: EdgeStream, vertices: int, shards: int = 4, per_shard: int = 64, seed: int = 0xDEADBEEF) -> DataFrame:
    """(shard, edges, beta) as ``triangle_betas``, but a shard sees only new samples and edges that touch one."""
    routed = _run(
        stream.edges.select(F.lit(0).alias("all"), "src", "dst", "seq"), ["all"], IncidenceRouter(vertices, shards * per_shard, shards, seed),
        "shard int, sampler int, a long, b long, c long, seq long",
    )
    return _run(routed, ["shard"], HeldSamples(), "shard int, edges long, beta long")


def triangle_estimates(stream: EdgeStream, vertices: int, shards: int = 4, per_shard: int = 64, seed: int = 0xDEADBEEF, incident_only: bool = False) -> DataFrame:
    """(edges, beta, estimate) whenever the estimate changes."""
    betas = (triangle_betas_incidence if incident_only else triangle_betas)(stream, vertices, shards, per_shard, seed)
    return _run(betas.withColumn("all", F.lit(0)), ["all"], EstimateOnChange(vertices, shards * per_shard), "edges long, beta long, estimate long")


def triangle_trace(stream: EdgeStream) -> DataFrame:
    """(id, triangles, seq) running counts; the state of one task is the graph."""
    return _run(stream.edges.select("src", "dst", "seq", F.lit(0).alias("all")), ["all"], TriangleTrace(), "id long, triangles long, seq long")
