"""Registered queries: every graph operator on the graphs that the relational tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.operators import algorithms as A
from edgewise.operators.edge_stream import EdgeStream
from edgewise.operators.summary import bipartite_summary, components_summary, totals_summary, triangles_summary
from edgewise.session import shared_dir
from edgewise.sources import edges as S

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def events(spark, sf_dir) -> EdgeStream:
    return EdgeStream(S.events_graph(spark, sf_dir))


def parts(spark, sf_dir) -> EdgeStream:
    return EdgeStream(S.orders_parts_graph(spark, sf_dir))


def rows(stream: EdgeStream) -> DataFrame:
    return stream.edges.select("src", "dst", "value", "seq")


# --- transformations


@query
def edges(spark, sf_dir):
    return rows(events(spark, sf_dir))


@query
def map_edges(spark, sf_dir):
    return rows(events(spark, sf_dir).map_edges(lambda s, d, v: v * 2 + s - d))


@query
def filter_edges(spark, sf_dir):
    return rows(events(spark, sf_dir).filter_edges(lambda s, d, v: v > 5000))


@query
def filter_vertices(spark, sf_dir):
    return rows(events(spark, sf_dir).filter_vertices(lambda v: v > 50))


@query
def reverse(spark, sf_dir):
    return rows(events(spark, sf_dir).reverse())


@query
def undirected(spark, sf_dir):
    return rows(events(spark, sf_dir).undirected())


@query
def distinct_edges(spark, sf_dir):
    return rows(events(spark, sf_dir).distinct())


@query
def union(spark, sf_dir):
    g = events(spark, sf_dir)
    return rows(g.filter_edges(lambda s, d, v: v > 5000).union(g.filter_edges(lambda s, d, v: v > 8000)))


# --- properties


@query
def vertices(spark, sf_dir):
    return events(spark, sf_dir).vertices()


@query
def num_vertices(spark, sf_dir):
    return events(spark, sf_dir).number_of_vertices()


@query
def num_vertices_trace(spark, sf_dir):
    return events(spark, sf_dir).number_of_vertices(trace=True)


@query
def num_edges(spark, sf_dir):
    return events(spark, sf_dir).number_of_edges()


@query
def num_edges_trace(spark, sf_dir):
    return events(spark, sf_dir).number_of_edges(trace=True)


@query
def degrees(spark, sf_dir):
    return events(spark, sf_dir).degrees()


@query
def degrees_trace(spark, sf_dir):
    return events(spark, sf_dir).degrees(trace=True)


@query
def in_degrees(spark, sf_dir):
    return events(spark, sf_dir).in_degrees()


@query
def in_degrees_trace(spark, sf_dir):
    return events(spark, sf_dir).in_degrees(trace=True)


@query
def out_degrees(spark, sf_dir):
    return events(spark, sf_dir).out_degrees()


@query
def out_degrees_trace(spark, sf_dir):
    return events(spark, sf_dir).out_degrees(trace=True)


@query
def neighborhood(spark, sf_dir):
    return events(spark, sf_dir).build_neighborhood().select("id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@query
def neighborhood_trace(spark, sf_dir):
    trace = events(spark, sf_dir).build_neighborhood(directed=True, trace=True)
    return trace.select("src", "dst", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


# --- aggregation


@query
def aggregate_vertices(spark, sf_dir):
    mapper = lambda s, d, v: F.array(F.struct(s.alias("id"), v.alias("value")), F.struct(d.alias("id"), (-v).alias("value")))
    return events(spark, sf_dir).aggregate_vertices(mapper, F.sum)


@query
def global_aggregate_updates(spark, sf_dir):
    return events(spark, sf_dir).global_aggregate(lambda s, d, v: v, "max", updates=True)


def _counted(state, vertex, value):
    """Number of values of a vertex so far and the largest of them."""
    n, most = (state or (0, None))[0] + 1, value if state is None or value > state[1] else state[1]
    return (n, most), (vertex, n, most)


@query
def fold_vertices(spark, sf_dir):
    mapper = lambda s, d, v: F.array(F.struct(s.alias("id"), v.alias("value")), F.struct(d.alias("id"), v.alias("value")))
    return events(spark, sf_dir).fold_vertices(mapper, lambda: None, _counted, "id long, n long, most long")


@query
def global_fold_updates(spark, sf_dir):
    """The number of vertices that have been seen, whenever it changes."""

    def step(state, vertex, value):
        state.add(vertex)
        return state, (len(state),)

    mapper = lambda s, d, v: F.array(F.struct(s.alias("id"), v.alias("value")), F.struct(d.alias("id"), v.alias("value")))
    return events(spark, sf_dir).fold_vertices(mapper, set, step, "n long", changes_only=True, whole=True)


@query
def map_edges_python(spark, sf_dir):
    return rows(events(spark, sf_dir).map_edges(lambda s, d, v: v * 2 + s - d, "long").filter_edges(lambda s, d, v: v % 3 == 0, python=True))


# --- sources and sinks: edges go out as text and come back


def _written(spark, df, sep="\t"):
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    S.write_text(df, path, sep)
    return path


@query
def source_tab(spark, sf_dir):
    path = _written(spark, events(spark, sf_dir).edges.select("src", "dst"))
    return S.read_tab_separated(spark, path).select("src", "dst")


@query
def source_white_space(spark, sf_dir):
    path = _written(spark, events(spark, sf_dir).edges.select("src", "dst"), " ")
    return S.read_white_space(spark, path).select("src", "dst")


@query
def source_timestamped(spark, sf_dir):
    path = _written(spark, events(spark, sf_dir).edges.select("src", "dst", F.unix_millis("ts").alias("ms")), " ")
    return S.read_timestamped(spark, path).select("src", "dst", F.unix_millis("ts").alias("ms"))


@query
def source_event_list(spark, sf_dir):
    sign = F.when(F.col("op") == 1, "+").otherwise("-").alias("sign")
    path = _written(spark, S.turnstile_graph(spark, sf_dir).select("src", "dst", sign), " ")
    return S.read_event_list(spark, path).select("src", "dst", "op")


@query
def source_commented(spark, sf_dir):
    first = F.when(F.col("value") > 5000, "%").otherwise(F.col("src").cast("string")).alias("src")
    path = _written(spark, events(spark, sf_dir).edges.select(first, "dst"), " ")
    return S.read_commented(spark, path).select("src", "dst")


@query
def source_ratings(spark, sf_dir):
    path = _written(spark, events(spark, sf_dir).edges.select("src", "dst", (F.col("value") % 50 / 10).alias("rating")))
    return S.read_ratings(spark, path).select("src", "dst", "value")


@query
def sink_csv(spark, sf_dir):
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    S.write_csv(events(spark, sf_dir).edges.select("src", "dst", "value"), path)
    return spark.read.schema("src long, dst long, value long").csv(path)


@query
def generated_ring(spark, sf_dir):
    return S.generate(spark, "ring", 1000).select("src", "dst", "seq")


@query
def generated_windows(spark, sf_dir):
    return S.generate(spark, "windows", 100).select("src", "dst", F.unix_millis("ts").alias("ms"), "seq")


# --- windows


def _fold(direction):
    def run(spark, sf_dir):
        g = events(spark, sf_dir).slice("1 day", direction)
        return g.fold_neighbors(F.lit(0).cast("long"), lambda acc, v, n, value: acc + value + n)

    return run


def _reduce(direction):
    return lambda spark, sf_dir: events(spark, sf_dir).slice("1 day", direction).reduce_on_edges("sum")


def _apply(direction):
    def apply(v, near):
        total = F.aggregate(near, F.lit(0).cast("long"), lambda acc, e: acc + e["value"])
        return F.array(F.struct(v.alias("id"), F.when(total > 10_000, "big").otherwise("small").alias("size")))

    return lambda spark, sf_dir: events(spark, sf_dir).slice("1 day", direction).apply_on_neighbors(apply)


for way in ("out", "in", "all"):
    QUERIES |= {f"slice_fold_{way}": _fold(way), f"slice_reduce_{way}": _reduce(way), f"slice_apply_{way}": _apply(way)}


@query
def last_value_window(spark, sf_dir):
    return events(spark, sf_dir).slice("1 day").last_values()


# --- triangles, degrees


@query
def window_triangles(spark, sf_dir):
    return A.window_triangles(events(spark, sf_dir), "1 day")


@query
def window_triangles_summary(spark, sf_dir):
    return events(spark, sf_dir).aggregate(triangles_summary("1 day"))


@query
def exact_triangles(spark, sf_dir):
    return A.exact_triangles(events(spark, sf_dir)).filter("id = -1").select("triangles")


@query
def exact_triangles_local(spark, sf_dir):
    return A.exact_triangles(events(spark, sf_dir)).filter("id >= 0")


@query
def triangle_trace(spark, sf_dir):
    return A.triangle_trace(events(spark, sf_dir), local=False).select("seq", "triangles")


@query
def triangle_trace_local(spark, sf_dir):
    return A.triangle_trace(events(spark, sf_dir), whole=False)


@query
def degree_distribution(spark, sf_dir):
    return A.degree_distribution(S.turnstile_graph(spark, sf_dir))


@query
def degree_distribution_trace(spark, sf_dir):
    return A.degree_distribution_trace(S.turnstile_graph(spark, sf_dir)).select("degree", "vertices")


@query
def degree_distribution_underflow(spark, sf_dir):
    """More deletions than additions: degrees stop at zero, deletions there do nothing."""
    op = F.when(F.col("seq") % 5 < 3, 1).otherwise(-1)
    thinned = events(spark, sf_dir).edges.select("src", "dst", op.alias("op"), "seq")
    return A.degree_distribution_trace(thinned.withColumn("dst", F.col("dst") % 7)).select("degree", "vertices")


# --- summaries and library algorithms


@query
def connected_components(spark, sf_dir):
    return A.components(parts(spark, sf_dir))


@query
def connected_components_tree(spark, sf_dir):
    return parts(spark, sf_dir).aggregate(components_summary(degree=2)).drop("window_end")


@query
def connected_components_iterative(spark, sf_dir):
    return A.components_iterative(parts(spark, sf_dir))


@query
def windowed_components(spark, sf_dir):
    return A.windowed_components(events(spark, sf_dir), "1 day")


@query
def cumulative_components(spark, sf_dir):
    return events(spark, sf_dir).aggregate(components_summary("10 days")).groupBy("window_end").agg(
        F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("vertices")
    )


@query
def summary_values(spark, sf_dir):
    return events(spark, sf_dir).aggregate(totals_summary("10 days", degree=2))


@query
def summary_values_transient(spark, sf_dir):
    return events(spark, sf_dir).aggregate(totals_summary("10 days", transient=True))


@query
def bipartite_windows(spark, sf_dir):
    found = events(spark, sf_dir).aggregate(bipartite_summary("1 day", transient=True))
    return found.groupBy("window_end").agg(F.first("bipartite").alias("bipartite"), F.count("id").alias("vertices"))


@query
def bipartite_check(spark, sf_dir):
    return A.bipartite_check(events(spark, sf_dir))


@query
def bipartite_sides(spark, sf_dir):
    return A.bipartite_sides(parts(spark, sf_dir)).select("id", "component", "sign")


@query
def bipartite_summary_sides(spark, sf_dir):
    return parts(spark, sf_dir).aggregate(bipartite_summary()).select("id", "component", "sign")


@query
def bipartite_dense(spark, sf_dir):
    return A.bipartite_check(EdgeStream(S.suppliers_parts_graph(spark, sf_dir)))


@query
def spanner(spark, sf_dir):
    return A.spanner(events(spark, sf_dir), 3)


@query
def weighted_matching(spark, sf_dir):
    return A.weighted_matching(events(spark, sf_dir))


@query
def matching_events(spark, sf_dir):
    return A.matching_events(events(spark, sf_dir))


@query
def triangle_estimate_broadcast(spark, sf_dir):
    return A.triangle_estimate_broadcast(events(spark, sf_dir).distinct())


@query
def triangle_estimate_incidence(spark, sf_dir):
    return A.triangle_estimate_incidence(events(spark, sf_dir).distinct())
