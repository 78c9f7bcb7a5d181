"""Graph algorithms on the fixtures, and on random graphs against plain Python."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from edgewise.operators import algorithms as A
from edgewise.operators.components import connected_components
from edgewise.operators.edge_stream import EdgeStream
from edgewise.operators.forests import _forest, forest_components
from edgewise.operators.summaries.adjacency import AdjacencyGraph
from edgewise.operators.summaries.disjoint_set import DisjointSet, SignedComponents
from edgewise.operators.summaries.spanner import SpannerGraph
from edgewise.operators.summary import bipartite_summary, components_summary
from edgewise.session import settings
from edgewise.sources import edges as S

SIX = [(1, 2), (1, 3), (2, 3), (1, 5), (6, 7), (8, 9)]
BIPARTITE = [(1, 2), (1, 3), (1, 4), (4, 5), (4, 7), (4, 9)]
ODD = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 7), (4, 1)]
TIMED = [(1, 2, 100), (1, 3, 150), (3, 2, 200), (2, 4, 250), (3, 4, 300), (3, 5, 350), (4, 5, 400), (4, 6, 450), (6, 5, 500), (5, 7, 550), (6, 7, 600), (8, 6, 650), (7, 8, 700), (7, 9, 750), (8, 9, 800), (10, 8, 850), (9, 10, 900), (9, 11, 950), (10, 11, 1000)]


def stream(spark, rows):
    return EdgeStream(S.from_rows(spark, rows))


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 100)) for _ in range(m)]


def plain_components(rows):
    sets = DisjointSet()
    for a, b, *_ in rows:
        sets.union(a, b)
    return {x: low for low, members in sets.groups().items() for x in members}


@pytest.mark.parametrize("rows", [SIX, [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], random_edges(1, 60, 45), [(3, 3)]])
def test_components(spark, rows):
    g, want = stream(spark, rows), plain_components(rows)
    assert pairs(A.components(g), "id", "component") == want
    assert pairs(A.components_iterative(g), "id", "component") == want
    assert pairs(g.aggregate(components_summary(degree=2)), "id", "component") == want


def test_components_of_nothing(spark):
    assert A.components_iterative(EdgeStream(spark.createDataFrame([], "src long, dst long"))).count() == 0
    named = connected_components(spark.createDataFrame([("b", "a"), ("c", None)], "src string, dst string"))
    assert pairs(named, "id", "component") == {"a": "a", "b": "a"}


def test_generated_components(spark):
    found = pairs(A.components(EdgeStream(S.generate(spark, "components"))), "id", "component")
    assert sorted(list(found.values()).count(c) for c in (1, 2)) == [51, 51]


def test_windowed_and_cumulative_components(spark):
    rows = [(1, 2, None, 100), (2, 3, None, 1100), (5, 6, None, 1200)]
    g = EdgeStream(S.from_rows(spark, rows))
    alone = {(r.window_end, r.id, r.component) for r in A.windowed_components(g, "1 second").collect()}
    assert alone == {(999, 1, 1), (999, 2, 1), (1999, 2, 2), (1999, 3, 2), (1999, 5, 5), (1999, 6, 5)}
    transient = {(r.window_end, r.id, r.component) for r in g.aggregate(components_summary("1 second", transient=True)).collect()}
    assert transient == alone
    total = {(r.window_end, r.id, r.component) for r in g.aggregate(components_summary("1 second")).collect()}
    assert total == {(999, 1, 1), (999, 2, 1), (1999, 1, 1), (1999, 2, 1), (1999, 3, 1), (1999, 5, 5), (1999, 6, 5)}


def test_bipartite(spark):
    g = stream(spark, BIPARTITE)
    assert A.bipartite_check(g).first().bipartite is True
    want = {1: True, 2: False, 3: False, 4: False, 5: True, 7: True, 9: True}
    assert pairs(A.bipartite_sides(g), "id", "sign") == want
    assert pairs(g.aggregate(bipartite_summary()), "id", "sign") == want


@pytest.mark.parametrize("rows", [ODD, [(2, 3), (1, 2), (1, 3)], [(1, 2), (2, 3), (1, 2), (1, 3)], [(1, 1)]])
def test_not_bipartite(spark, rows):
    g = stream(spark, rows)
    assert A.bipartite_check(g).first().bipartite is False
    assert [r.bipartite for r in g.aggregate(bipartite_summary()).collect()] == [False]


def plain_triangles(rows):
    have = {(min(a, b), max(a, b)) for a, b, *_ in rows if a != b}
    ids = sorted({v for e in have for v in e})
    return [t for t in itertools.combinations(ids, 3) if all(e in have for e in itertools.combinations(t, 2))]


@pytest.mark.parametrize("rows", [[(1, 2), (2, 3), (2, 6), (5, 6), (1, 4), (5, 3), (3, 4), (3, 6), (1, 3)], random_edges(2, 20, 90)])
def test_exact_triangles(spark, rows):
    want = {}
    for t in plain_triangles(rows):
        for v in (*t, -1):
            want[v] = want.get(v, 0) + 1
    g = stream(spark, rows)
    assert pairs(A.exact_triangles(g), "id", "triangles") == want
    assert max(r.triangles for r in A.triangle_trace(g).filter("id = -1").collect()) == want[-1]


def test_window_triangles(spark):
    g = EdgeStream(S.from_rows(spark, [(a, b, None, ms) for a, b, ms in TIMED]))
    assert {(r.triangles, r.window_end) for r in A.window_triangles(g, "400 milliseconds").collect()} == {(2, 399), (3, 799), (2, 1199)}
    made = EdgeStream(S.generate(spark, "windows", 10))
    assert {(r.triangles, r.window_end) for r in A.window_triangles(made, "300 milliseconds").collect()} == {(1, 299), (2, 599), (2, 899), (1, 1199)}


DEGREES = [(1, 1), (1, 2), (2, 1), (1, 1), (1, 2), (2, 2), (1, 1), (1, 2), (1, 3), (2, 1), (1, 2), (1, 3), (2, 2), (1, 2), (1, 3), (2, 1), (1, 2)]
EVENTS = [(1, 2, 1), (2, 3, 1), (1, 4, 1), (2, 3, -1), (3, 4, 1), (1, 2, -1)]


@pytest.mark.parametrize(("events", "want"), [(EVENTS, DEGREES), ([*EVENTS, (2, 3, -1)], [*DEGREES, (1, 1)])])
def test_degree_distribution(spark, events, want):
    df = S.from_rows(spark, events).withColumnRenamed("value", "op")
    assert sorted((r.degree, r.vertices) for r in A.degree_distribution_trace(df).collect()) == sorted(want)
    if events is EVENTS:
        assert pairs(A.degree_distribution(df), "degree", "vertices") == {1: 2, 2: 1}


def test_spanner(spark):
    rows = [(1, 4), (4, 7), (7, 8), (4, 8), (4, 5), (5, 6), (2, 3), (3, 4), (3, 6), (8, 9), (6, 8), (5, 9)]
    got = {(r.src, r.dst) for r in A.spanner(stream(spark, rows), 3).collect()}
    assert got == {(1, 4), (4, 7), (7, 8), (4, 5), (5, 6), (2, 3), (3, 4), (8, 9), (6, 8)}
    many = random_edges(3, 25, 120)
    kept = AdjacencyGraph()
    for r in A.spanner(stream(spark, many), 3).collect():
        kept.add_edge(r.src, r.dst)
    assert all(kept.within(a, b, 3) for a, b, _ in many if a != b)


def test_matching(spark):
    rows = [(1, 2, 12), (1, 3, 13), (2, 3, 23), (3, 4, 34), (3, 5, 35), (4, 5, 45), (5, 1, 51)]
    got = [(r.event, r.src, r.dst, r.value) for r in A.matching_events(stream(spark, rows)).orderBy("at").collect()]
    assert got == [("ADD", 1, 2, 12), ("ADD", 3, 4, 34), ("REMOVE", 1, 2, 12), ("ADD", 5, 1, 51)]
    final = A.weighted_matching(stream(spark, random_edges(4, 30, 200))).collect()
    ends = [v for r in final for v in {r.src, r.dst}]
    assert final and len(ends) == len(set(ends))


@pytest.mark.parametrize("estimate", [A.triangle_estimate_broadcast, A.triangle_estimate_incidence])
def test_estimators(spark, estimate):
    g = EdgeStream(S.generate(spark, "near", 60))
    got = estimate(g, 62, 40_000, seed=5).first()
    assert got.edges == 120
    assert 0.5 * 60 < got.estimate < 1.6 * 60
    assert estimate(g, 62, 40_000, seed=5).first() == got


@pytest.mark.parametrize("estimate", [A.triangle_estimate_broadcast, A.triangle_estimate_incidence])
def test_estimators_take_the_vertices_of_the_graph(spark, estimate):
    near = S.generate(spark, "near", 60)
    far = EdgeStream(near.withColumns({"src": F.col("src") * 1000, "dst": F.col("dst") * 1000}))
    got = estimate(far, samples=40_000, seed=5).first()
    assert 0.5 * 60 < got.estimate < 1.6 * 60
    assert got == estimate(EdgeStream(near), samples=40_000, seed=5).first()


def test_registered_estimators(spark, tmp_path):
    from edgewise.plans.queries import QUERIES

    n = 300  # two fans from 1000 and 1001 over further ids
    rows = [(i, 0, f'{{"k": {1000 + v}}}', 1.0, "2024-01-01") for v in range(2, n) for i in (1000, 1001)] + [(1000, 1, '{"k": 1001}', 1.0, "2024-01-01")]
    rows = [(rows[-1][0], 0, *rows[-1][2:]), *[(u, k, *rest) for k, (u, _, *rest) in enumerate(rows[:-1], 1)]]
    spark.createDataFrame(rows, "user_id long, event_id long, props string, value double, ts string").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("triangle_estimate_broadcast", "triangle_estimate_incidence"):
        assert QUERIES[name](spark, str(tmp_path)).first().estimate > 0.5 * (n - 2)


def test_disjoint_set():
    a, b = DisjointSet(), DisjointSet()
    for i in range(8):
        a.union(i, i + 2)
        b.union(i, i + 100)
    assert len(a) == 10 and sorted(a.groups()) == [0, 1]
    assert a.find(999) is None
    a.merge(b)
    assert len(a) == 18 and sorted(a.groups()) == [0, 1]


def test_signed_components_merge():
    a, b = SignedComponents(), SignedComponents()
    assert a.add(1, 2) and a.add(2, 3)
    assert b.add(1, 2) and b.add(1, 3)
    a.merge(b)
    assert a.failed and a.components() == {}


def test_bounded_search():
    g = AdjacencyGraph()
    for a, b in [(1, 4), (4, 5), (5, 6), (4, 7), (7, 8)]:
        g.add_edge(a, b)
    assert g.within(5, 7, 3) and not g.within(6, 8, 3) and g.within(6, 8, 4) and not g.within(99, 1, 3)
    g.reset()
    assert not g.within(1, 4, 3)


def test_running_by_key_cuts_a_hub(spark, monkeypatch):
    """A key with most rows runs in several ranges of the order, with the results of one window."""
    from edgewise.functions import running as R

    rng = random.Random(5)
    rows = [(seq, None if seq % 50 == 0 else 0 if seq % 10 else seq % 7, rng.randrange(-5, 9)) for seq in rng.sample(range(4000), 1200)]
    df = spark.createDataFrame(rows, "seq long, key long, v long")
    for kind, combine in (("sum", sum), ("max", max), ("min", min)):
        got = {r.seq: (r.now, r.was) for r in R.running(df, "seq", F.col("v"), kind, "now", before="was", by=("key",)).collect()}
        for key in {k for _, k, _ in rows}:
            own = sorted((seq, v) for seq, k, v in rows if k == key)
            for i, (seq, _) in enumerate(own):
                before = [v for _, v in own[:i]]
                assert got[seq] == (combine([v for _, v in own[: i + 1]]), combine(before) if before or kind == "sum" else None)
    assert R.with_bucket(df, "seq", keyed=True).select("bucket").distinct().count() == 8


def test_deletions_below_zero(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(6), rng.randrange(6), rng.choice([1, -1, -1])) for _ in range(300)]
    degree, counts, want = {}, {}, []
    for a, b, op in rows:
        for v in (a, b):
            old = degree.get(v, 0)
            new = degree[v] = max(0, old + op)
            if new == old:
                continue
            if new > 0:
                counts[new] = counts.get(new, 0) + 1
                want.append((new, counts[new]))
            if old > 0:
                counts[old] -= 1
                want.append((old, counts[old]))
    df = S.from_rows(spark, rows).withColumnRenamed("value", "op")
    assert [(r.degree, r.vertices) for r in A.degree_distribution_trace(df).orderBy("seq").collect()] == want


def test_local_triangle_trace(spark):
    rows = random_edges(8, 15, 80)
    got = {}
    for r in A.triangle_trace(stream(spark, rows)).collect():
        got.setdefault(r.id, {})[r.seq] = r.triangles
    for end in range(len(rows)):
        now = {}
        for t in plain_triangles(rows[: end + 1]):
            for v in (*t, -1):
                now[v] = now.get(v, 0) + 1
        assert {v: max(n for s, n in trace.items() if s <= end) for v, trace in got.items() if min(trace) <= end} == now


def test_running_max_over_buckets(spark):
    from edgewise.functions.running import running

    values = [5, 3, 9, 1, 9, 12, 2]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, v long")
    got = [r.m for r in running(df, "seq", F.col("v"), "max", "m").orderBy("seq").collect()]
    assert got == [5, 5, 9, 9, 9, 12, 12]


def plain_sides(rows):
    """Vertex to (smallest vertex of its component, sign or None), by walks over the plain graph."""
    near = {}
    for a, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for low in sorted(near):
        if low in out:
            continue
        sign, layer, odd = {low: True}, [low], False
        for x in layer:
            for y in near[x]:
                odd |= sign.get(y) == sign[x]
                if y not in sign:
                    sign[y] = not sign[x]
                    layer.append(y)
        out |= {v: (low, None if odd else s) for v, s in sign.items()}
    return out


EVEN = [(a, 1000 + b, v) for a, b, v in random_edges(11, 150, 140)]


@pytest.mark.parametrize(("rows", "degree"), [(EVEN, 2), ([*EVEN, (1000, 1001), (0, 1000), (0, 1001), (5, 5)], 0), ([(i + 1, i) for i in range(90)], 2)])
def test_forests_in_chunks(spark, rows, degree):
    """Chunks of seven edges, so that every component has rows of many forests; no step gathers the graph in one task."""
    edges, want = stream(spark, rows).edges, plain_sides(rows)
    found, odd = forest_components(edges, signed=True, degree=degree, chunk=7)
    got = {r.id: (r.component, None if r.conflict else r.minus == 0) for r in found.collect()}
    assert got == want and odd == any(s is None for _, s in want.values())
    plain, _ = forest_components(edges, degree=degree, chunk=7)
    assert {r.id: r.component for r in plain.collect()} == {v: c for v, (c, _) in want.items()}


@pytest.mark.parametrize("summary", [bipartite_summary(), components_summary(degree=2)])
def test_summaries_of_a_graph_are_merged_over_the_cluster(spark, summary):
    found = stream(spark, EVEN).aggregate(summary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobinPartitioning(1)" not in plan and "REPARTITION_BY_NUM" not in plan
    assert {r.id: r.component for r in found.collect()} == {v: c for v, (c, _) in plain_sides(EVEN).items()}


def test_forest_rows_grow_with_the_edges(spark):
    """Copies of a dense graph, their edges mixed: eight times the copies leave about eight times the rows, and the same answer."""

    def copies(n):
        rows = [(100 * i + a, 100 * i + 50 + b) for i in range(n) for a in range(10) for b in range(10)]
        random.Random(n).shuffle(rows)
        return stream(spark, rows).edges

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "50"}):  # a chunk is at least a batch
        few, many = (_forest(copies(n), True, 0, 200).count() for n in (10, 80))
        sides, odd = forest_components(copies(80), signed=True, chunk=200)
        got = {(r.id, r.component, r.minus) for r in sides.collect()}
    assert few >= 200 and many <= 10 * few
    assert got == {(100 * i + 50 * s + a, 100 * i, s) for i in range(80) for s in (0, 1) for a in range(10)} and not odd


def test_components_of_names_by_forests(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", None), ("d", "b")], "src string, dst string")
    found, odd = forest_components(edges, signed=True)
    assert {(r.id, r.component, r.minus) for r in found.collect()} == {("a", "a", 0), ("b", "a", 1), ("d", "a", 0)} and not odd
    assert forest_components(spark.createDataFrame([], "src long, dst long"))[0].count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 32])
def test_spanner_graph_decides_as_plain_search(monkeypatch, heavy):
    monkeypatch.setattr(SpannerGraph, "HEAVY", heavy)
    for n, targets in ((40, 40), (200, 12)):
        plain, fast, rng = AdjacencyGraph(), SpannerGraph(), random.Random(n)
        for _ in range(1500):
            a, b = rng.randrange(n), rng.randrange(targets)
            near = plain.within(a, b, 3)
            assert fast.within(a, b, 3) == near
            if not near:
                plain.add_edge(a, b)
                fast.add_edge(a, b)
        assert plain.edges() == fast.edges()


def test_spanner_decisions_do_not_walk_hubs():
    graph, leaves = SpannerGraph(), 20_000
    for leaf in range(2, leaves):
        graph.add_edge(leaf, leaf % 2)
    graph.add_edge(leaves, 0)
    graph.add_edge(leaves, 1)
    began = time.process_time()
    assert all(graph.within(leaf, 1 - leaf % 2, 3) for leaf in range(2, 5000))
    assert time.process_time() - began < 2  # a search layer by layer takes milliseconds each


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("tied", [False, True])
def test_triangle_traces_without_shuffled_wedges(spark, monkeypatch, few, tied):
    rows = random_edges(21, 25, 160)
    g = stream(spark, rows)
    if tied:
        g = EdgeStream(g.edges.withColumn("seq", F.floor(F.col("seq") / 3).cast("long")))
    monkeypatch.setattr(A, "CLOSING_ROWS", few)
    first = {}
    for i, (a, b, _) in enumerate(rows):
        if a != b:
            first.setdefault((min(a, b), max(a, b)), i // 3 if tied else i)
    want = {}
    for t in plain_triangles(rows):
        seq = max(first[e] for e in itertools.combinations(t, 2))
        for v in (*t, -1):
            want[v, seq] = want.get((v, seq), 0) + 1
    totals, running_want = {}, {}
    for v, seq in sorted(want, key=lambda k: k[1]):
        totals[v] = running_want[v, seq] = totals.get(v, 0) + want[v, seq]
    got = A.triangle_trace(g).collect()
    assert len(got) == len(running_want) and {(r.id, r.seq): r.triangles for r in got} == running_want
    plan = A.triangle_trace(g, whole=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0  # a bucket's rows are shuffled once, and joined with nothing
