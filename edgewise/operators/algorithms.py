"""Graph algorithms over edge DataFrames: components, two-colouring, triangles, degrees, spanner, matching, estimators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.ordered import fold_in_order
from edgewise.functions.running import running
from edgewise.operators.components import connected_components
from edgewise.operators.edge_stream import EdgeStream
from edgewise.operators.forests import forest_components
from edgewise.operators.summaries.spanner import SpannerGraph
from edgewise.session import materialize, stored

#: Edges that can close a triangle are sent to every task up to this number.
CLOSING_ROWS = 300_000

# --- components ------------------------------------------------------------------------------------


def components(stream: EdgeStream) -> DataFrame:
    """(id, component) by repeated contraction, in DataFrame operations only; partial minima combine before each shuffle."""
    return connected_components(stream.edges)


components_iterative = components


def windowed_components(stream: EdgeStream, size: str) -> DataFrame:
    """(window_end, id, component) of each tumbling window alone."""
    end = (F.unix_millis(F.window("ts", size)["end"]) - 1).alias("w")
    rows = stream.edges.select(end, "src", "dst")
    parts = rows.select(F.struct("w", F.col("src").alias("id")).alias("src"), F.struct("w", F.col("dst").alias("id")).alias("dst"))
    found = connected_components(parts)
    return found.select(F.col("id.w").alias("window_end"), F.col("id.id").alias("id"), F.col("component.id").alias("component"))


# --- bipartiteness ---------------------------------------------------------------------------------


def bipartite_sides(stream: EdgeStream) -> DataFrame:
    """(id, component, sign, conflict): sign is true on the side of the smallest vertex, null where an odd closed walk leaves no two-colouring."""
    sides, _ = forest_components(stream.edges, signed=True)
    return sides.select("id", "component", F.when(~F.col("conflict"), F.col("minus") == 0).alias("sign"), "conflict")


def bipartite_check(stream: EdgeStream) -> DataFrame:
    """One row (bipartite, conflicts): whether the graph has a two-colouring, and how many vertices lie in components without one."""
    sides = bipartite_sides(stream)
    return sides.agg(F.coalesce(~F.bool_or("conflict"), F.lit(True)).alias("bipartite"), F.count_if("conflict").alias("conflicts"))


# --- triangles -------------------------------------------------------------------------------------


def canonical_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """Distinct (a, b) with a < b, loops dropped, within ``keep`` columns."""
    rows = edges.select(*keep, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return rows.filter("a < b").distinct()


def triangles(edges: DataFrame, *keep: str) -> DataFrame:
    """Every triangle once (x, y, z) from canonical edges (keep, a, b).

    Edges point from the end of smaller degree to the larger, so a vertex spans at most about the root
    of twice the edges' number squared of wedges, however large a hub is.
    """
    out = _upward(edges, *keep).select(*keep, "x", "y")
    wedges = out.join(out.select(*keep, "x", F.col("y").alias("z")), [*keep, "x"]).filter(F.col("y") < F.col("z"))
    closing = edges.select(*keep, F.col("a").alias("y"), F.col("b").alias("z"))
    return wedges.join(closing, [*keep, "y", "z"]).select(*keep, "x", "y", "z")


def _upward(edges: DataFrame, *keep: str) -> DataFrame:
    """``edges`` (keep, a, b and others) with x, y for a, b: x the end of smaller degree."""
    ends = edges.select(*keep, F.explode(F.array("a", "b")).alias("v")).groupBy(*keep, "v").agg(F.count(F.lit(1)).alias("d"))
    known = edges.join(ends.select(*keep, F.col("v").alias("a"), F.col("d").alias("da")), [*keep, "a"])
    known = known.join(ends.select(*keep, F.col("v").alias("b"), F.col("d").alias("db")), [*keep, "b"])
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    low, high = F.when(up, F.col("a")).otherwise(F.col("b")), F.when(up, F.col("b")).otherwise(F.col("a"))
    rest = [c for c in edges.columns if c not in (*keep, "a", "b")]
    return known.select(*keep, low.alias("x"), high.alias("y"), *rest)


def exact_triangles(stream: EdgeStream) -> DataFrame:
    """(id, triangles): by vertex of a triangle, and over the graph as id -1."""
    found = triangles(canonical_edges(stream.edges))
    return found.select(F.explode(F.array("x", "y", "z", F.lit(-1).cast("long"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def _dated_triangles(stream: EdgeStream) -> tuple[DataFrame, bool]:
    """(third, a, b, seq) of each triangle at its last edge a - b, from the first edge of each pair; and whether edges share a seq.

    Wedges stay where their lowest vertex is. Only edges between two upper ends can close one; if these are few they are sent to
    the wedges, so that wedges, many more than edges, are not shuffled.
    """
    first = stream.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "seq").filter("a < b").groupBy("a", "b").agg(F.min("seq").alias("seq"))
    first = stored(first)
    tied = not first.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    out = stored(_upward(first))
    tops = out.select("y").distinct()
    closing = first.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("seq").alias("s3"))
    closing = stored(closing.join(tops, "y", "left_semi").join(tops.withColumnRenamed("y", "z"), "z", "left_semi"))
    lower = out.select("x", "y", F.col("seq").alias("s1"))
    wedges = lower.join(out.select("x", F.col("y").alias("z"), F.col("seq").alias("s2")), "x").filter("y < z")
    found = wedges.join(F.broadcast(closing) if closing.count() <= CLOSING_ROWS else closing, ["y", "z"])
    seq = F.greatest("s1", "s2", "s3")
    last = lambda third, a, b: F.struct(F.col(third).alias("third"), F.col(a).alias("a"), F.col(b).alias("b"))
    end = F.when(F.col("s1") == seq, last("z", "x", "y")).when(F.col("s2") == seq, last("y", "x", "z")).otherwise(last("x", "y", "z"))
    return found.select(seq.alias("seq"), end.alias("e")).select("e.third", "e.a", "e.b", "seq"), tied


def triangle_trace(stream: EdgeStream, whole: bool = True, local: bool = True) -> DataFrame:
    """(id, triangles, seq): running counts, each triangle at its last edge; ``whole`` for the global count as id -1, ``local`` for those by vertex."""
    found, tied = _dated_triangles(stream)
    one = F.lit(1).cast("long")
    parts = []
    if whole:
        counted = found.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.select(F.lit(-1).cast("long").alias("id"), "seq", "n"))
    if local:  # the ends of a last edge take all its triangles at once; the third vertex has one of them
        ends = found.groupBy("seq", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        parts += [found.select(F.col("third").alias("id"), "seq", one.alias("n")), ends.select(F.explode(F.array("a", "b")).alias("id"), "seq", "n")]
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    if tied:
        each = each.groupBy("id", "seq").agg(F.sum("n").alias("n"))
    each = stored(each)
    if not local:
        return running(each, "seq", F.col("n"), name="triangles").select("id", "triangles", "seq")
    return running(each, "seq", F.col("n"), name="triangles", by=("id",)).select("id", "triangles", "seq")


def window_triangles(stream: EdgeStream, size: str) -> DataFrame:
    """(triangles, window_end) for every window with edges, those without a triangle too."""
    rows = stream.edges.select((F.unix_millis(F.window("ts", size)["end"]) - 1).alias("window_end"), "src", "dst")
    found = triangles(canonical_edges(rows, "window_end"), "window_end").groupBy("window_end").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("window_end").distinct().join(found, "window_end", "left").select(F.coalesce("n", F.lit(0)).alias("triangles"), "window_end")


# --- degree distribution ---------------------------------------------------------------------------


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, vertices) after all additions and deletions (src, dst, op); for streams that never delete more than they added."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "op")
    return ends.groupBy("id").agg(F.sum("op").alias("degree")).filter("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def degree_changes(edges: DataFrame) -> DataFrame:
    """(degree, change, seq): for each end of each event the degree that gains a vertex, then the one that loses it.

    A degree never falls below zero, and deletions at an unknown vertex do nothing, so the order of a vertex's events matters.
    """
    ends = edges.select(F.posexplode(F.array("src", "dst")).alias("o", "id"), "op", "seq").select("id", "op", (F.col("seq") * 2 + F.col("o")).alias("at"))

    # Clamping at zero: running sum minus its running minimum below zero.
    summed = materialize(running(ends, "at", F.col("op"), name="sum", by=("id",)))
    lowest = running(summed, "at", F.col("sum"), "min", "low", before="low_before", by=("id",))
    zero = F.lit(0)
    new = F.col("sum") - F.least(zero, F.col("low"))
    old = F.col("sum") - F.col("op") - F.least(zero, F.coalesce("low_before", zero))
    moved = lowest.select("at", new.alias("new"), old.alias("old")).filter("new != old")
    gains = F.when(F.col("new") > 0, F.struct(F.col("new").alias("degree"), F.lit(1).alias("change"), (F.col("at") * 2).alias("seq")))
    losses = F.when(F.col("old") > 0, F.struct(F.col("old").alias("degree"), F.lit(-1).alias("change"), (F.col("at") * 2 + 1).alias("seq")))
    return moved.select(F.explode(F.array_compact(F.array(gains, losses))).alias("e")).select("e.*")


def degree_distribution_trace(edges: DataFrame) -> DataFrame:
    """(degree, vertices, seq): the number of vertices of a degree each time it changes."""
    changes = materialize(degree_changes(edges))
    return running(changes, "seq", F.col("change"), name="vertices", by=("degree",)).select("degree", "vertices", "seq")


# --- order-dependent algorithms --------------------------------------------------------------------


def spanner(stream: EdgeStream, k: int = 3) -> DataFrame:
    """(src, dst): greedy k-spanner in arrival order; an edge stays if its ends were more than k steps apart.

    Each decision needs all before it, so one task does the fold. Edges that repeat, which never stay, go first. For k = 3 a
    decision is a few lookups a neighbour of the lesser end (see ``SpannerGraph``).
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = SpannerGraph()
        for frame in frames:
            kept = []
            for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
                if not graph.within(a, b, k):
                    graph.add_edge(a, b)
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["src", "dst"]).astype("int64")

    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    first = stream.edges.filter("src != dst").groupBy(*pair).agg(F.min(F.struct("seq", "src", "dst")).alias("e")).select("e.*")
    return fold_in_order(first, "seq", fold, "src long, dst long")


def matching_events(stream: EdgeStream) -> DataFrame:
    """(at, event, src, dst, value) in order: an edge enters if it weighs more than twice what it collides with.

    A matching has one edge a vertex, so collisions are two lookups; the fold is sequential.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_end: dict = {}
        at = 0
        for frame in frames:
            out = []
            for a, b, w in zip(frame["src"].tolist(), frame["dst"].tolist(), frame["value"].tolist(), strict=True):
                against = list(dict.fromkeys(by_end[v] for v in (a, b) if v in by_end))
                if w > 2 * sum(e[2] for e in against):
                    for e in against:
                        by_end.pop(e[0], None)
                        by_end.pop(e[1], None)
                        out.append(("REMOVE", *e))
                    by_end[a] = by_end[b] = (a, b, w)
                    out.append(("ADD", a, b, w))
            events = pd.DataFrame(out, columns=["event", "src", "dst", "value"])
            yield events.assign(at=range(at, at + len(events)))[["at", "event", "src", "dst", "value"]]
            at += len(events)

    return fold_in_order(stream.edges.select("src", "dst", "value", "seq"), "seq", fold, "at long, event string, src long, dst long, value long")


def weighted_matching(stream: EdgeStream) -> DataFrame:
    """(src, dst, value) of the final matching."""
    events = matching_events(stream).withColumn("n", F.when(F.col("event") == "ADD", 1).otherwise(-1))
    return events.groupBy("src", "dst", "value").agg(F.sum("n").alias("n")).filter("n > 0").drop("n")


# --- triangle estimators ---------------------------------------------------------------------------


def _uniform(seed: int, what: str) -> Column:
    """A number in (0, 1) that depends on the seed, what is drawn, and the sampler."""
    key = F.concat(F.lit(f"{seed}:{what}:"), F.col("sampler").cast("string"))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _estimate(stream: EdgeStream, vertices: int | None, samples: int, seed: int, incident_only: bool) -> DataFrame:
    """Reservoir sampling keeps edge i with chance 1/i, so a sampler's last edge is uniform: it is drawn directly.

    A sampler then holds its edge (a, b), a random third vertex c, and sees beta = 1 if both (a, c)
    and (b, c) arrive later. Samplers join edges by key, so no edge is sent to every sampler.
    The third vertex is drawn by its rank among the graph's ids. ``vertices`` beyond the graph's own
    number count as vertices without edges; by default there are none.
    """
    spark = stream.context
    ranked = materialize(running(stream.edges.select("src", "dst", "seq"), "seq", F.lit(1), name="place"))
    m = ranked.count()
    ids = ranked.select(F.explode(F.array("src", "dst")).alias("id")).filter("id IS NOT NULL").distinct()
    ids = materialize(running(ids, "id", F.lit(1), name="rank").select("id", (F.col("rank") - 1).alias("rank")))
    vertices = max(vertices or 0, ids.count())
    samplers = spark.range(samples).withColumnRenamed("id", "sampler")
    drawn = samplers.select("sampler", (F.floor(_uniform(seed, "edge") * m) + 1).alias("place"), F.floor(_uniform(seed, "vertex") * (vertices - 2)).cast("long").alias("skip"))
    held = drawn.join(ranked.select("place", F.col("src").alias("a"), F.col("dst").alias("b")), "place")
    held = held.join(ids.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ids.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
    c = F.col("skip") + F.when(F.col("skip") >= low, 1).otherwise(0)
    c = c + F.when(c >= high, 1).otherwise(0)  # any vertex but the two
    held = held.withColumn("rank", c).join(ids.withColumnRenamed("id", "c"), "rank")
    later = ranked.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), "place").filter("p < q").groupBy("p", "q").agg(F.max("place").alias("last"))
    if incident_only:
        ends = held.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        near = later.join(ends.withColumnRenamed("v", "p"), "p", "left_semi").unionByName(later.join(ends.withColumnRenamed("v", "q"), "q", "left_semi").select("p", "q", "last"))
        later = near.distinct()
    sides = held.select("sampler", "place", F.explode(F.array(F.struct(F.least("a", "c").alias("p"), F.greatest("a", "c").alias("q")), F.struct(F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q")))).alias("e"))
    seen = sides.select("sampler", "place", "e.p", "e.q").join(later, ["p", "q"]).filter("last > place").groupBy("sampler").agg(F.count(F.lit(1)).alias("n"))
    beta = seen.agg(F.count_if(F.col("n") == 2).alias("beta"))
    estimate = (F.col("beta") / samples * m * (vertices - 2)).cast("long")
    return beta.select(F.lit(m).cast("long").alias("edges"), "beta", estimate.alias("estimate"))


def triangle_estimate_broadcast(stream: EdgeStream, vertices: int | None = None, samples: int = 10_000, seed: int = 0xDEADBEEF) -> DataFrame:
    """One row (edges, beta, estimate) of the sampling estimator in which every sampler sees every edge."""
    return _estimate(stream, vertices, samples, seed, False)


def triangle_estimate_incidence(stream: EdgeStream, vertices: int | None = None, samples: int = 10_000, seed: int = 0xDEADBEEF) -> DataFrame:
    """As the broadcast estimator, but only edges incident to a sampled edge go on to the samplers."""
    return _estimate(stream, vertices, samples, seed, True)
