"""Neighbourhood aggregation in tumbling windows.

Results carry ``window_end``, the last millisecond of the window since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}


def window_end(window: Column) -> Column:
    return F.unix_millis(window["end"]) - 1


class Snapshot:
    """Edges by (vertex, window); nothing is computed until one of the methods is called."""

    def __init__(self, edges: DataFrame, size: str):
        self._df, self.size = edges, size

    def _grouped(self):
        rows = self._df.withColumn("window", F.window("ts", self.size))
        return rows.groupBy("window", F.col("src").alias("id"))

    def _arrived(self) -> Column:
        """The window's edges of a vertex in arrival order, as an array of structs seq, dst, value."""
        order = F.col("seq") if "seq" in self._df.columns else F.unix_micros("ts")
        return F.array_sort(F.collect_list(F.struct(order.alias("seq"), "dst", "value")))

    def _finish(self, df: DataFrame) -> DataFrame:
        return df.withColumn("window_end", window_end(F.col("window"))).drop("window")

    def fold_neighbors(self, initial: Column, fold: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
        """(id, value, window_end): left fold in arrival order by an expression of accumulator, vertex, neighbour and value."""
        rows = self._grouped().agg(self._arrived().alias("_edges"))
        folded = F.aggregate("_edges", initial, lambda acc, e: fold(acc, F.col("id"), e["dst"], e["value"]))
        return self._finish(rows.select("window", "id", folded.alias("value")))

    def reduce_on_edges(self, reduce: str | Callable[[Column, Column], Column]) -> DataFrame:
        """(id, value, window_end): a named aggregate, or pairwise reduction of the values by an expression.

        Named aggregates combine before the shuffle; prefer them.
        """
        if isinstance(reduce, str):
            return self._finish(self._grouped().agg(NAMED[reduce]("value").alias("value")))
        rows = self._grouped().agg(F.transform(self._arrived(), lambda e: e["value"]).alias("_values"))
        first = F.get("_values", F.lit(0))
        rest = F.slice("_values", F.lit(2), F.greatest(F.size("_values") - 1, F.lit(0)))
        return self._finish(rows.select("window", "id", F.aggregate(rest, first, reduce).alias("value")))

    def apply_on_neighbors(self, apply: Callable, schema: str | None = None) -> DataFrame:
        """All neighbours of a vertex in a window at once.

        Without ``schema``, ``apply`` is an expression: from the vertex and its array of structs (seq, dst,
        value) to an array of structs, each of which becomes a row. With ``schema`` it is a Python generator
        function of (vertex, iterator of (neighbour, value)) that yields tuples; batch only, because a
        grouped Python function on a stream sees one micro-batch, not the window.
        """
        if schema is None:
            rows = self._grouped().agg(self._arrived().alias("_edges"))
            out = rows.select("window", "id", F.explode(apply(F.col("id"), F.col("_edges"))).alias("_out"))
            return self._finish(out.select("window", "_out.*"))
        if self._df.isStreaming:
            raise ValueError("Python functions over whole windows need a batch; use an expression on streams")
        import pandas as pd

        names = [part.split()[0] for part in schema.split(",")]
        order = F.col("seq") if "seq" in self._df.columns else F.unix_micros("ts")
        rows = self._df.select(window_end(F.window("ts", self.size)).alias("window_end"), "src", order.alias("seq"), "dst", "value")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("seq")
            neighbors: Iterator = zip(pdf["dst"].tolist(), pdf["value"].tolist(), strict=True)
            out = pd.DataFrame(list(apply(pdf["src"].iat[0], neighbors)), columns=names)
            return out.assign(window_end=pdf["window_end"].iat[0])

        return rows.groupBy("window_end", "src").applyInPandas(run, f"{schema}, window_end long")

    def last_values(self, key: str = "src", value: str = "value") -> DataFrame:
        """(id, value, window_end): the latest value of each key in each window."""
        rows = self._df.withColumn("window", F.window("ts", self.size)).groupBy("window", F.col(key).alias("id"))
        return self._finish(rows.agg(F.max_by(value, "seq").alias("value")))
