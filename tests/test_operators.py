"""The operators on the sample graph, batch: transformations, properties, windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edgewise.functions.ordered import fold_in_order
from edgewise.operators.edge_stream import EdgeStream
from edgewise.sources import edges as S

SAMPLE = [(1, 2, 12), (1, 3, 13), (2, 3, 23), (3, 4, 34), (3, 5, 35), (4, 5, 45), (5, 1, 51)]


@pytest.fixture(scope="module")
def graph(spark):
    return EdgeStream(S.from_rows(spark, SAMPLE))


def triples(stream):
    return sorted((r.src, r.dst, r.value) for r in stream.edges.collect())


def column(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_creation_and_context(spark, graph):
    assert triples(graph) == SAMPLE
    assert graph.context is graph.edges.sparkSession


def test_map_edges(graph):
    assert [v for _, _, v in triples(graph.map_edges(lambda s, d, v: v + 1))] == [13, 14, 24, 35, 36, 46, 52]
    pairs = graph.map_edges(lambda s, d, v: F.struct(v.alias("a"), (v + 1).alias("b")))
    assert triples(pairs)[0][2].b == 13
    assert triples(pairs.map_edges(lambda s, d, v: v["a"] + v["b"]))[0] == (1, 2, 25)


@pytest.mark.parametrize(("keep", "left"), [(lambda v: v > 20, 5), (lambda v: v > 0, 7), (lambda v: v < 0, 0)])
def test_filter_edges(graph, keep, left):
    assert len(triples(graph.filter_edges(lambda s, d, v: keep(v)))) == left


@pytest.mark.parametrize(("keep", "left"), [(lambda v: v > 1, SAMPLE[2:6]), (lambda v: v > 0, SAMPLE), (lambda v: v < 0, [])])
def test_filter_vertices(graph, keep, left):
    assert triples(graph.filter_vertices(keep)) == left
    assert len(triples(graph.undirected().filter_vertices(keep))) == 2 * len(left)


def test_vertex_filter_after_undirected_reaches_the_scan(spark, graph, tmp_path):
    graph.edges.write.parquet(str(tmp_path / "g"))
    read = EdgeStream(spark.read.parquet(str(tmp_path / "g")))
    plan = read.undirected().filter_vertices(lambda v: v > 1).edges._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(src), IsNotNull(dst), GreaterThan(src,1), GreaterThan(dst,1)]" in plan


def test_distinct_keeps_the_first(spark):
    twice = EdgeStream(S.from_rows(spark, SAMPLE + [(a, b, v + 100) for a, b, v in SAMPLE]))
    assert triples(twice.distinct()) == SAMPLE


def test_reverse_undirected_union(graph):
    assert triples(graph.reverse()) == sorted((b, a, v) for a, b, v in SAMPLE)
    assert triples(graph.undirected()) == sorted(SAMPLE + [(b, a, v) for a, b, v in SAMPLE])
    low, high = graph.filter_edges(lambda s, d, v: v < 35), graph.filter_edges(lambda s, d, v: v >= 35)
    assert triples(low.union(high)) == SAMPLE


def test_counts_and_traces(graph):
    assert column(graph.vertices(), "id") == [(i,) for i in range(1, 6)]
    assert column(graph.number_of_vertices(trace=True), "n") == [(i,) for i in range(1, 6)]
    assert column(graph.number_of_edges(trace=True), "n") == [(i,) for i in range(1, 8)]
    assert graph.number_of_vertices().first().n == 5
    assert graph.number_of_edges().first().n == 7


def test_degree_traces(graph):
    assert column(graph.degrees(trace=True), "id", "degree") == sorted(
        [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1), (4, 2), (5, 1), (5, 2), (5, 3)]
    )
    assert column(graph.in_degrees(trace=True), "id", "degree") == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (5, 2)]
    assert column(graph.out_degrees(trace=True), "id", "degree") == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1)]
    assert column(graph.degrees(), "id", "degree") == [(1, 3), (2, 2), (3, 4), (4, 2), (5, 3)]


def test_neighborhood(graph):
    assert {r.id: r.neighbors for r in graph.build_neighborhood().collect()}[3] == [1, 2, 4, 5]
    trace = {(r.src, r.dst): r.neighbors for r in graph.build_neighborhood(directed=True, trace=True).collect()}
    assert trace[1, 2] == [2] and trace[1, 3] == [2, 3]


def test_aggregates(graph):
    mapper = lambda s, d, v: F.array(F.struct(s.alias("id"), v.alias("value")))
    assert column(graph.aggregate_vertices(mapper, F.sum), "id", "value") == [(1, 25), (2, 23), (3, 69), (4, 45), (5, 51)]
    assert (1, 12) in column(graph.aggregate_vertices(mapper, F.sum, trace=True), "id", "value")
    assert column(graph.global_aggregate(lambda s, d, v: s, "max"), "value") == [(1,), (1,), (2,), (3,), (3,), (4,), (5,)]
    assert column(graph.global_aggregate(lambda s, d, v: s, "max", updates=True), "value") == [(i,) for i in range(1, 6)]


SUMS = {"out": [25, 23, 69, 45, 51], "in": [51, 12, 36, 34, 80], "all": [76, 35, 105, 79, 131]}
BIG = {"out": [3, 5], "in": [1, 5], "all": [1, 3, 4, 5]}


@pytest.mark.parametrize("direction", ["out", "in", "all"])
def test_slices(graph, direction):
    window = graph.slice("1 second", direction)
    want = list(zip(range(1, 6), SUMS[direction], strict=True))
    assert column(window.fold_neighbors(F.lit(0).cast("long"), lambda acc, v, n, value: acc + value), "id", "value") == want
    assert column(window.reduce_on_edges("sum"), "id", "value") == want
    assert column(window.reduce_on_edges(lambda a, b: a + b), "id", "value") == want

    def sized(v, near):
        total = F.aggregate(near, F.lit(0).cast("long"), lambda acc, e: acc + e["value"])
        return F.array(F.struct(v.alias("id"), F.when(total > 50, "big").otherwise("small").alias("size")))

    assert [i for i, s in column(window.apply_on_neighbors(sized), "id", "size") if s == "big"] == BIG[direction]

    def python_sized(v, near):
        yield v, "big" if sum(value for _, value in near) > 50 else "small"

    assert [i for i, s in column(window.apply_on_neighbors(python_sized, "id long, size string"), "id", "size") if s == "big"] == BIG[direction]


def test_slice_rejects_unknown_direction(graph):
    with pytest.raises(ValueError):
        graph.slice("1 second", "sideways")


def test_last_values(graph):
    assert column(graph.slice("1 second").last_values(), "id", "value")[0] == (1, 13)


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").write_text("1\t2\n3\t4\n")
    (tmp_path / "b").write_text("% comment here\n1 2 100\n3 4 250\n")
    (tmp_path / "c").write_text("1 2 +\n2 3 -\n")
    (tmp_path / "e").write_text("1 2 100\n3 4 250\n")
    (tmp_path / "d").write_text("7\t8\t3.5\n")
    assert column(S.read_tab_separated(spark, str(tmp_path / "a")), "src", "dst") == [(1, 2), (3, 4)]
    assert column(S.read_commented(spark, str(tmp_path / "b")), "src", "dst") == [(1, 2), (3, 4)]
    timed = S.read_timestamped(spark, str(tmp_path / "e"))
    assert column(timed.select("src", F.unix_millis("ts").alias("ms")), "src", "ms") == [(1, 100), (3, 250)]
    assert column(S.read_event_list(spark, str(tmp_path / "c")), "src", "op") == [(1, 1), (2, -1)]
    assert column(S.read_ratings(spark, str(tmp_path / "d")), "src", "dst", "value") == [(7, 1_000_008, 35)]
    edges = S.read_white_space(spark, str(tmp_path / "c")).select("src", "dst")
    S.write_text(edges, str(tmp_path / "out"))
    S.write_csv(edges, str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 2", "2 3"]
    assert spark.read.csv(str(tmp_path / "csv")).count() == 2


def test_generators(spark):
    assert S.generate(spark, "ring", 1000).count() == 2000
    assert S.generate(spark, "bipartite").count() == 1000
    assert column(S.generate(spark, "near", 2), "src", "dst") == [(1, 2), (1, 3), (2, 3), (2, 4)]


def test_whole_folds_order_blocks_not_rows(spark, monkeypatch):
    """One task orders packed blocks: its sort sees a block's number, not the rows."""
    monkeypatch.setattr("edgewise.functions.ordered.BLOCK", 3)
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("seq"), (F.col("id") * 37 % 100 * 2).alias("v"))
    rows = rows.repartition(7)

    def fold(frames):
        at = 0
        for frame in frames:
            yield frame.assign(at=range(at, at + len(frame)))[["at", "v"]]
            at += len(frame)

    found = fold_in_order(rows, "seq", fold, "at long, v long")
    assert {r.at: r.v for r in found.collect()} == {i: 2 * i for i in range(100)}
    assert "Sort [first#" in found._jdf.queryExecution().sparkPlan().toString()
