"""Streaming twins: results do not depend on how the input is cut into files, and survive a restart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edgewise.operators.edge_stream import EdgeStream
from edgewise.sources import edges as S
from edgewise.streaming import processors as P
from tests.test_algorithms import DEGREES, EVENTS
from tests.test_operators import SAMPLE

SCHEMA = "src long, dst long, value long, ts timestamp, seq long"


def files(spark, folder, rows, cuts):
    """Write rows as parquet files, one a cut, in order."""
    df = S.from_rows(spark, rows)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        df.filter((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/part{k}")
    return f"{folder}/*"


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, df, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    q = df.writeStream.format("parquet").option("checkpointLocation", out + "-cp").trigger(availableNow=True).outputMode(mode).start(out)
    q.awaitTermination(240)
    return spark.read.parquet(out).collect()


@pytest.mark.parametrize("cuts", [[], [3, 5]])
def test_degrees_and_counts(spark, tmp_path, cuts):
    path = files(spark, str(tmp_path / "in"), SAMPLE, cuts)
    g = EdgeStream(read(spark, path))
    got = sorted((r.id, r.degree) for r in collected(spark, P.degrees(g), tmp_path, "degrees"))
    assert got == sorted((r.id, r.degree) for r in EdgeStream(S.from_rows(spark, SAMPLE)).degrees(trace=True).collect())
    assert sorted(r.n for r in collected(spark, P.number_of_edges(g), tmp_path, "edges")) == list(range(1, 8))
    assert sorted(r.n for r in collected(spark, P.number_of_vertices(g), tmp_path, "vertices")) == list(range(1, 6))


def test_stateless_and_distinct(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), SAMPLE + SAMPLE, [7])
    g = EdgeStream(read(spark, path))
    rows = collected(spark, g.distinct().filter_vertices(lambda v: v > 1).undirected().edges, tmp_path, "out")
    assert sorted((r.src, r.dst) for r in rows) == sorted([(2, 3), (3, 4), (3, 5), (4, 5), (3, 2), (4, 3), (5, 3), (5, 4)])


def test_degree_distribution(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), EVENTS, [2, 4])
    events = read(spark, path).withColumnRenamed("value", "op")
    got = collected(spark, P.degree_distribution(events), tmp_path, "out")
    assert sorted((r.degree, r.vertices) for r in got) == sorted(DEGREES)


def test_components_survive_a_restart(spark, tmp_path):
    rows = [(1, 2), (3, 4), (6, 7), (2, 3), (8, 9)]
    folder = str(tmp_path / "in")
    df = S.from_rows(spark, rows)
    df.filter("seq < 3").coalesce(1).write.parquet(f"{folder}/part0")
    g = lambda: EdgeStream(read(spark, f"{folder}/*"))
    collected(spark, P.components(g()), tmp_path, "out")
    df.filter("seq >= 3").coalesce(1).write.parquet(f"{folder}/part1")
    got = {}
    for r in collected(spark, P.components(g()), tmp_path, "out"):
        got[r.id] = min(r.component, got.get(r.id, r.component))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 8, 9: 8}


def test_matching_spanner_and_samplers(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), SAMPLE, [4])
    g = EdgeStream(read(spark, path))
    got = sorted((r.event, r.src, r.dst) for r in collected(spark, P.matching(g), tmp_path, "matching"))
    assert got == [("ADD", 1, 2), ("ADD", 3, 4), ("ADD", 5, 1), ("REMOVE", 1, 2)]
    assert {(r.src, r.dst) for r in collected(spark, P.spanner(g, 3), tmp_path, "spanner")} == {(1, 2), (1, 3), (3, 4), (3, 5)}
    assert all(r.beta >= 0 for r in collected(spark, P.triangle_betas(g, 6, 2, 32), tmp_path, "betas"))


def test_windows(spark, tmp_path):
    rows = [(a, b, v, 100 * i) for i, (a, b, v) in enumerate(SAMPLE)] + [(9, 9, 0, 100_000)]
    path = files(spark, str(tmp_path / "in"), rows, [4, 7])
    g = EdgeStream(read(spark, path), ts=F.col("ts"))
    got = collected(spark, g.slice("1 second").reduce_on_edges("sum"), tmp_path, "out")
    assert sorted((r.id, r.value) for r in got if r.window_end == 999) == [(1, 25), (2, 23), (3, 69), (4, 45), (5, 51)]
    with pytest.raises(ValueError):
        g.slice("1 second").apply_on_neighbors(lambda v, near: [], "id long")


def test_summary_of_values(spark, tmp_path):
    from edgewise.operators.summary import totals_summary

    path = files(spark, str(tmp_path / "in"), [*SAMPLE, (3, 9, None)], [2, 6])
    g = EdgeStream(S.from_rows(spark, [*SAMPLE, (3, 9, None)]))
    want = [(1, 2, 25, 13), (2, 1, 23, 23), (3, 2, 69, 35), (4, 1, 45, 45), (5, 1, 51, 51)]
    for degree in (0, 2):
        assert sorted((r.id, r.edges, r.total, r.most) for r in g.aggregate(totals_summary(degree=degree)).collect()) == want
    latest = {}
    for r in collected(spark, EdgeStream(read(spark, path)).aggregate(totals_summary()), tmp_path, "out"):
        latest[r.id] = max((r.edges, r.total, r.most), latest.get(r.id, (0, 0, 0)))
    assert sorted((k, *v) for k, v in latest.items()) == want


@pytest.mark.parametrize("transient", [False, True])
def test_summary_windows(spark, tmp_path, transient):
    """Components by merge windows of event time, each with all before it or alone; the last window stays open."""
    from edgewise.operators.summary import components_summary

    rows = [(1, 2, None, 100), (1, 3, None, 400), (2, 3, None, 1100), (1, 5, None, 1500), (6, 7, None, 2200), (8, 9, None, 2300), (0, 0, None, 9_000), (0, 0, None, 90_000)]
    path = files(spark, str(tmp_path / "in"), rows, [3, 7])
    summary = components_summary("1 second", transient=transient)
    got = {(r.window_end, r.id, r.component) for r in collected(spark, EdgeStream(read(spark, path), ts=F.col("ts")).aggregate(summary), tmp_path, "out")}
    batch = {(r.window_end, r.id, r.component) for r in EdgeStream(S.from_rows(spark, rows)).aggregate(summary).collect()}
    assert got == {x for x in batch if x[0] < 60_000} and {x[0] for x in got} == {999, 1999, 2999, 9999}


def test_bipartite_summary_on_a_stream(spark, tmp_path):
    from tests.test_algorithms import BIPARTITE, ODD

    for name, rows, want in (("yes", BIPARTITE, {True}), ("no", ODD, {True, False})):
        path = files(spark, str(tmp_path / name), rows, [2])
        got = collected(spark, P.bipartite_sides(EdgeStream(read(spark, path))), tmp_path, f"out-{name}")
        assert {r.bipartite for r in got} == want
    signs = {}
    path = files(spark, str(tmp_path / "signs"), BIPARTITE, [])
    for r in collected(spark, P.bipartite_sides(EdgeStream(read(spark, path))), tmp_path, "out-signs"):
        signs[r.id] = (r.component, r.sign)
    assert signs == {1: (1, True), 2: (1, False), 3: (1, False), 4: (1, False), 5: (1, True), 7: (1, True), 9: (1, True)}


def test_folds_and_neighborhoods(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), SAMPLE, [3])
    g, batch = EdgeStream(read(spark, path)), EdgeStream(S.from_rows(spark, SAMPLE))
    ends = lambda s, d, v: F.array(F.struct(s.alias("id"), v.alias("value")), F.struct(d.alias("id"), v.alias("value")))

    def longest(state, vertex, value):
        state = max(state, value)
        return state, (vertex, state)

    for whole in (False, True):
        fold = lambda s, w=whole: s.fold_vertices(ends, int, longest, "id long, most long", whole=w)
        got = sorted(tuple(r) for r in collected(spark, fold(g), tmp_path, f"fold{whole}"))
        assert got == sorted(tuple(r) for r in fold(batch).collect())
    assert (3, 51) not in got and (1, 51) in got
    trace = sorted((r.src, r.dst, r.neighbors) for r in collected(spark, P.neighborhood(g), tmp_path, "near"))
    assert trace == sorted((r.src, r.dst, r.neighbors) for r in batch.build_neighborhood(trace=True).collect())


def test_global_aggregate_and_triangle_trace(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), SAMPLE, [2, 5])
    g, batch = EdgeStream(read(spark, path)), EdgeStream(S.from_rows(spark, SAMPLE))
    for k, (kind, updates) in enumerate((("max", True), ("sum", False), ("min", True))):
        run = lambda s, kind=kind, updates=updates: s.global_aggregate(lambda a, b, v: b, kind, updates=updates)
        assert sorted(r.value for r in collected(spark, run(g), tmp_path, f"agg{k}")) == sorted(r.value for r in run(batch).collect())
    from edgewise.operators import algorithms as A

    got, want = {}, {}
    for r in collected(spark, P.triangle_trace(g), tmp_path, "trace"):
        got[r.id, r.seq] = max(r.triangles, got.get((r.id, r.seq), 0))
    for r in A.triangle_trace(batch).collect():
        want[r.id, r.seq] = r.triangles
    assert got == want and max(n for (v, _), n in want.items() if v == -1) == 3


def test_window_triangles(spark, tmp_path):
    from edgewise.operators.summary import triangles_summary
    from tests.test_algorithms import TIMED

    rows = [(a, b, None, ms) for a, b, ms in TIMED]
    want = {(2, 399), (3, 799), (2, 1199)}
    assert {(r.triangles, r.window_end) for r in EdgeStream(S.from_rows(spark, rows)).aggregate(triangles_summary("400 milliseconds", degree=2)).collect()} == want
    path = files(spark, str(tmp_path / "in"), [*rows, (1, 1, None, 9_000), (1, 1, None, 9_100)], [7, 19, 20])
    got = collected(spark, EdgeStream(read(spark, path), ts=F.col("ts")).aggregate(triangles_summary("400 milliseconds")), tmp_path, "out")
    assert {(r.triangles, r.window_end) for r in got if r.window_end < 2000} == want


@pytest.mark.parametrize("incident_only", [False, True])
def test_estimates_are_emitted_on_change(spark, tmp_path, incident_only):
    """Each vertex with the next two: n triangles. The latest estimate is near, and no two in a row are equal."""
    n = 24
    rows = [(k, k + d) for k in range(n) for d in (1, 2)]
    path = files(spark, str(tmp_path / "in"), rows, [20])
    g = EdgeStream(read(spark, path))
    got = collected(spark, P.triangle_estimates(g, n + 2, 2, 600, seed=3, incident_only=incident_only), tmp_path, "out")
    last = max(got, key=lambda r: (r.edges, r.estimate))
    assert 0.5 * n < last.estimate < 1.6 * n and len({(r.edges, r.beta) for r in got}) > 1
    if incident_only:
        routed = P._run(g.edges.select(F.lit(0).alias("all"), "src", "dst", "seq"), ["all"], P.IncidenceRouter(n + 2, 1200, 2, 3), "shard int, sampler int, a long, b long, c long, seq long")
        sent = collected(spark, routed, tmp_path, "routed")
        assert len(sent) < 0.5 * len(rows) * 1200
        samples = {}
        for r in sorted(sent, key=lambda r: r.seq):
            if r.c is not None:
                samples[r.sampler] = r.seq
        share = sum(seq > len(rows) // 2 for seq in samples.values()) / 1200  # a sampler's last edge is uniform
        assert len(samples) == 1200 and 0.44 < share < 0.56
