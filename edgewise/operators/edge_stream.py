"""The edge stream: an immutable wrapper of a DataFrame of edges, batch or streaming.

Columns are src, dst and, as far as they are there, value, ts and seq. ``seq`` is the arrival order,
which the trace forms (one output row for each event) need; final forms do not use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewise.functions.ordered import fold_in_order
from edgewise.functions.running import running
from edgewise.operators.snapshot import Snapshot

EdgeExpression = Callable[[Column, Column, Column], Column]


class EdgeStream:
    def __init__(self, edges: DataFrame, ts: Column | None = None, lag: str = "0 seconds", _single: EdgeStream | None = None):
        """``ts`` sets the event time; a stream then gets a watermark without slack, as times must ascend."""
        if ts is not None:
            edges = edges.withColumn("ts", ts.cast("timestamp"))
            edges = edges.withWatermark("ts", lag) if edges.isStreaming else edges
        self._df = edges
        self._single = _single  # the stream before undirected()

    @property
    def edges(self) -> DataFrame:
        return self._df

    @property
    def context(self) -> SparkSession:
        return self._df.sparkSession

    def _has(self, column: str) -> bool:
        return column in self._df.columns

    def _value(self) -> Column:
        return F.col("value") if self._has("value") else F.lit(None)

    # --- transformations ---------------------------------------------------------------------------

    def map_edges(self, f: EdgeExpression, returns: str | None = None) -> EdgeStream:
        """A new value, of any type, from the whole edge: by an expression, or by a Python function of (src, dst, value) if its type is given."""
        if returns is not None:
            return EdgeStream(self._df.withColumn("value", F.udf(f, returns, useArrow=True)("src", "dst", self._value())))
        return EdgeStream(self._df.withColumn("value", f(F.col("src"), F.col("dst"), self._value())))

    def filter_edges(self, f: EdgeExpression, python: bool = False) -> EdgeStream:
        """Edges for which an expression is true, or with ``python`` a Python function of (src, dst, value)."""
        if python:
            return EdgeStream(self._df.filter(F.udf(f, "boolean", useArrow=True)("src", "dst", self._value())))
        return EdgeStream(self._df.filter(f(F.col("src"), F.col("dst"), self._value())))

    def filter_vertices(self, f: Callable[[Column], Column]) -> EdgeStream:
        """Edges both of whose ends pass. After undirected() the filter goes below it, where the scan can use it."""
        if self._single is not None:
            return self._single.filter_vertices(f).undirected()
        return EdgeStream(self._df.filter(f(F.col("src")) & f(F.col("dst"))))

    def reverse(self) -> EdgeStream:
        return EdgeStream(self._df.withColumns({"src": F.col("dst"), "dst": F.col("src")}))

    def undirected(self) -> EdgeStream:
        """Each edge followed by its reverse: one scan, order kept in seq (doubled)."""
        ways = F.array(F.struct(F.lit(0).alias("o"), "src", "dst"), F.struct(F.lit(1).alias("o"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        rest = [c for c in self._df.columns if c not in ("src", "dst", "seq")]
        seq = [(F.col("seq") * 2 + F.col("way.o")).alias("seq")] if self._has("seq") else []
        rows = self._df.withColumn("way", F.explode(ways))
        return EdgeStream(rows.select(F.col("way.src").alias("src"), F.col("way.dst").alias("dst"), *rest, *seq), _single=self)

    def distinct(self) -> EdgeStream:
        """The first edge of each (source, target)."""
        if self._df.isStreaming or not self._has("seq"):
            return EdgeStream(self._df.dropDuplicates(["src", "dst"]))
        rest = [c for c in self._df.columns if c not in ("src", "dst", "seq")]
        if not rest:
            return EdgeStream(self._df.groupBy("src", "dst").agg(F.min("seq").alias("seq")))
        # min_by combines before the shuffle, which a ranking window cannot
        first = self._df.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), "seq").alias("_r"), F.min("seq").alias("seq"))
        return EdgeStream(first.select("src", "dst", *[F.col(f"_r.{c}").alias(c) for c in rest], "seq"))

    def union(self, other: EdgeStream) -> EdgeStream:
        return EdgeStream(self._df.unionByName(other._df, allowMissingColumns=True))

    # --- properties --------------------------------------------------------------------------------

    def _ends(self, sources: bool = True, targets: bool = True) -> DataFrame:
        """(id, seq): an edge's source before its target."""
        ends = [F.struct(F.lit(o).alias("o"), F.col(c).alias("id")) for o, c, used in ((0, "src", sources), (1, "dst", targets)) if used]
        rows = self._df.withColumn("end", F.explode(F.array(*ends)))
        order = (F.col("seq") * 2 + F.col("end.o")) if self._has("seq") else F.lit(None).cast("long")
        return rows.select(F.col("end.id").alias("id"), order.alias("seq"), *(["ts"] if self._has("ts") else []))

    def vertices(self) -> DataFrame:
        """(id): every vertex once."""
        ends = self._ends()
        return ends.select("id").dropDuplicates(["id"]) if self._df.isStreaming else ends.select("id").distinct()

    def number_of_vertices(self, trace: bool = False) -> DataFrame:
        """(n); as a trace one row for each new vertex: 1, 2, ..."""
        if not trace:
            return self._ends().agg(F.count_distinct("id").alias("n"))
        first = self._ends().groupBy("id").agg(F.min("seq").alias("seq"))
        return running(first, "seq", F.lit(1), name="n").select("n")

    def number_of_edges(self, trace: bool = False) -> DataFrame:
        """(n), repeats counted; as a trace one row for each edge."""
        if not trace:
            return self._df.agg(F.count(F.lit(1)).alias("n"))
        return running(self._df.select("seq"), "seq", F.lit(1), name="n").select("n")

    def _degrees(self, sources: bool, targets: bool, trace: bool) -> DataFrame:
        ends = self._ends(sources, targets)
        if not trace:
            return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return running(ends.select("id", "seq"), "seq", F.lit(1), name="degree", by=("id",)).select("id", "degree")

    def degrees(self, trace: bool = False) -> DataFrame:
        """(id, degree); a loop counts twice, repeats count. As a trace the running degree at each event."""
        return self._degrees(True, True, trace)

    def in_degrees(self, trace: bool = False) -> DataFrame:
        return self._degrees(False, True, trace)

    def out_degrees(self, trace: bool = False) -> DataFrame:
        return self._degrees(True, False, trace)

    def build_neighborhood(self, directed: bool = False, trace: bool = False) -> DataFrame:
        """(id, neighbors) sorted; as a trace (src, dst, neighbors) after each edge. Undirected doubles edges first."""
        df = (self if directed else self.undirected())._df
        if not trace:
            return df.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
        so_far = Window.partitionBy("src").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return df.select("src", "dst", F.array_sort(F.collect_set("dst").over(so_far)).alias("neighbors"))

    # --- aggregation -------------------------------------------------------------------------------

    def aggregate_vertices(self, edge_mapper: Callable[[Column, Column, Column], Column], aggregate: Callable[[str], Column], trace: bool = False) -> DataFrame:
        """Explode each edge to vertices by ``edge_mapper`` (an array of structs id, value) and aggregate the values by id.

        ``aggregate`` makes an aggregate column of the column named to it; as a trace it runs over the events so far.
        """
        at = [F.col("seq")] if self._has("seq") else []
        mapped = self._df.select(*at, F.posexplode(edge_mapper(F.col("src"), F.col("dst"), self._value())).alias("_o", "_m"))
        rows = mapped.select(F.col("_m.id").alias("id"), F.col("_m.value").alias("_value"), "_o", *at)
        if not trace:
            return rows.groupBy("id").agg(aggregate("_value").alias("value"))
        so_far = Window.partitionBy("id").orderBy("seq", "_o").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("id", aggregate("_value").over(so_far).alias("value"))

    def _mapped(self, edge_mapper: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """(id, value, seq) of the vertices (an array of structs id, value) that ``edge_mapper`` makes of each edge, in order."""
        mapped = self._df.select("seq", F.posexplode(edge_mapper(F.col("src"), F.col("dst"), self._value())).alias("_o", "_m"))
        return mapped.select(F.col("_m.id").alias("id"), F.col("_m.value").alias("value"), (F.col("seq") * 16 + F.col("_o")).alias("seq"))

    def fold_vertices(
        self, edge_mapper: Callable[[Column, Column, Column], Column], initial: Callable[[], object], step: Callable[[object, object, object], tuple], schema: str, changes_only: bool = False, whole: bool = False
    ) -> DataFrame:
        """Rows of ``schema``: explode each edge to at most 16 vertices, and pass them in order to a function with state.

        ``step`` takes (state, id, value) and gives (state, output tuple); the state is any Python object, one a vertex,
        or one for the whole stream if ``whole``, which one task then reads batch by batch. ``changes_only`` leaves out
        an output equal to the one before it.
        """
        if self._df.isStreaming:
            from edgewise.streaming.processors import fold_vertices

            return fold_vertices(self, edge_mapper, initial, step, schema, changes_only, whole)
        names = [part.strip().split()[0] for part in schema.split(",")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state, last = None, None, None
            for frame in frames:
                out = []
                values = frame["value"].astype(object).where(frame["value"].notna(), None)
                for v, value in zip(frame["id"].tolist(), values.tolist(), strict=True):
                    if state is None or (not whole and v != key):
                        key, state, last = v, (initial(),), None
                    held, row = step(state[0], v, value)
                    state = (held,)
                    if not (changes_only and row == last):
                        out.append(row)
                    last = row
                yield pd.DataFrame(out, columns=names, dtype=object)

        rows = self._mapped(edge_mapper)
        if whole:
            return fold_in_order(rows, "seq", run, schema)
        return rows.repartition("id").sortWithinPartitions("id", "seq").mapInPandas(run, schema)

    def global_aggregate(self, value: EdgeExpression, kind: str = "sum", updates: bool = False, trace: bool = True) -> DataFrame:
        """(value): the running sum, max or min of a value of each edge over the whole stream.

        With ``updates`` only rows where it changed. A batch runs in parallel by ranges of seq; a stream in one task, on whole numbers.
        """
        if self._df.isStreaming:
            best = {"sum": lambda a, b: a + b, "max": max, "min": min}[kind]

            def step(state: object, vertex: object, v: object) -> tuple:
                state = state if v is None else v if state is None else best(state, v)
                return state, (state,)

            one = lambda s, d, v: F.array(F.struct(F.lit(0).cast("long").alias("id"), value(s, d, v).cast("long").alias("value")))
            return self.fold_vertices(one, lambda: None, step, "value long", changes_only=updates, whole=True)
        from edgewise.functions.running import AGGREGATES

        own = self._df.withColumn("_own", value(F.col("src"), F.col("dst"), self._value()))
        if not trace:
            return own.agg(AGGREGATES[kind]("_own").alias("value"))
        rows = running(own.select("seq", "_own"), "seq", F.col("_own"), kind, "now", "was")
        if updates:
            rows = rows.filter(~F.col("now").eqNullSafe(F.col("was")))
        return rows.select(F.col("now").alias("value"))

    def aggregate(self, summary, **options) -> DataFrame:
        """Run a summary (see ``edgewise.operators.summary``) over the edges."""
        return summary.run(self, **options)

    def slice(self, size: str, direction: str = "out") -> Snapshot:
        """Tumbling windows of ``size`` by vertex: of the edges that leave it, that enter it, or both."""
        ways = {"out": lambda: self, "in": self.reverse, "all": self.undirected}
        if direction not in ways:
            raise ValueError(f"direction must be one of {sorted(ways)}, not {direction!r}")
        return Snapshot(ways[direction]()._df, size)
