"""Components and two-colourings by partial forests: tasks shrink their edges to forests, whose roots are then tied by contraction.

Edges are placed by ranges of their ends, so that edges of the same vertices meet, and read in chunks of ``CHUNK``; no task
holds more. A chunk leaves one row a vertex: the smallest vertex of its component there, and the side it lies on. A range holds
about half a chunk however many edges there are: chunks of a wider range would have rows of the same vertices again and again.
A vertex with rows of several roots ties these; the ties, far fewer than the edges, are contracted over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from edgewise.operators.components import connected_components
from edgewise.session import materialize, stored

#: Edges of a chunk, and the most rows that merged forests of one task may have.
CHUNK = 1_000_000

#: Labels of roots up to this number are sent to every task, so that a component of most vertices is no task of its own.
BROADCAST_ROWS = 500_000


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n - 1 in the component of each, by hooking roots to smaller ones and halving paths."""
    parent = np.arange(n)
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = high, low


def spanning(a: np.ndarray, b: np.ndarray, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, roots, sides) of a forest of edges a - b; ``odd`` is 1 where the ends lie on opposite sides, None if sides do not matter.

    A root is the smallest vertex of a component. If it lies on an odd closed walk it has a second row, on its other side.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    x, y, n = at[: len(a)], at[len(a) :], len(ids)
    if odd is None:
        return ids, ids[_labels(x, y, n)], np.zeros(n, np.int32)
    low = _labels(np.concatenate([x * 2, x * 2 + 1]), np.concatenate([y * 2 + odd, y * 2 + 1 - odd]), 2 * n)
    plus, minus = low[0::2], low[1::2]
    root = np.minimum(plus, minus) // 2
    tied = ids[np.unique(root[plus == minus])]
    side = (plus % 2).astype(np.int32)
    return np.concatenate([ids, tied]), np.concatenate([ids[root], tied]), np.concatenate([side, np.ones(len(tied), np.int32)])


def _forest(edges: DataFrame, signed: bool, degree: int, chunk: int) -> DataFrame:
    """(id, root, side) rows of the forests of chunks; with ``degree`` > 1 a task merges its forests in a tree of that many at a time."""
    ends = F.array("src", "dst")
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(ends[0].alias("src"), ends[1].alias("dst"))
    kind = rows.schema["src"].dataType
    schema = StructType([StructField("id", kind), StructField("root", kind), StructField("side", IntegerType())])
    arrow = pa.schema([("id", to_arrow_type(kind)), ("root", to_arrow_type(kind)), ("side", pa.int32())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[int, list] = {}

        def batch(forest: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, type=t) for part, t in zip(forest, arrow.types, strict=True)], schema=arrow)

        def merged(forests: list) -> tuple:
            a, b, side = (np.concatenate(parts) for parts in zip(*forests, strict=True))
            return spanning(a, b, side.astype(np.int64) if signed else None)

        def push(forest: tuple, level: int) -> Iterator[pa.RecordBatch]:
            if degree < 2 or len(forest[0]) * degree > chunk:
                yield batch(forest)
                return
            own = levels.setdefault(level, [])
            own.append(forest)
            if len(own) == degree:
                levels[level] = []
                yield from push(merged(own), level + 1)

        def cut(parts: list) -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (0, 1))
            yield from push(spanning(a, b, np.ones(len(a), np.int64) if signed else None), 0)

        held, size = [], 0
        for own in batches:
            if own.num_rows:
                held.append(own)
                size += own.num_rows
            if size >= chunk:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)
        rest = [f for own in levels.values() for f in own]
        if rest:
            yield batch(merged(rest) if len(rest) > 1 else rest[0])

    ranges = -(-2 * rows.count() // chunk)
    if ranges > rows.sparkSession.sparkContext.defaultParallelism:
        placed = rows.repartitionByRange(ranges, "src", "dst")
    else:  # the session's number, small ones joined
        placed = rows.repartitionByRange("src", "dst")
    return placed.mapInArrow(fold, schema)


def _sides(ties: DataFrame) -> DataFrame:
    """(id, component, minus, conflict) of vertices tied to the same (odd = 0) or opposite sides (odd = 1), from the components of the double cover.

    Each vertex has two sides. A vertex whose sides are tied lies on an odd closed walk. Otherwise it is on the side that is tied to
    the plus side of the smallest vertex.
    """
    side = lambda c, s: F.struct(F.col(c).alias("id"), s.alias("minus"))
    zero, one, odd = F.lit(0), F.lit(1), F.col("odd")
    both = F.array(
        F.struct(side("src", zero).alias("src"), side("dst", odd).alias("dst")), F.struct(side("src", one).alias("src"), side("dst", one - odd).alias("dst"))
    )
    found = connected_components(ties.select(F.explode(both).alias("tie")).select("tie.src", "tie.dst"))
    by_vertex = found.groupBy(F.col("id.id").alias("id")).agg(
        F.min(F.when(F.col("id.minus") == 0, F.col("component"))).alias("plus"), F.min(F.when(F.col("id.minus") == 1, F.col("component"))).alias("minus")
    )
    conflict = F.col("plus") == F.col("minus")
    return by_vertex.select("id", F.least("plus.id", "minus.id").alias("component"), F.when(conflict, 0).otherwise(F.col("plus.minus")).alias("minus"), conflict.alias("conflict"))


def forest_components(edges: DataFrame, signed: bool = False, degree: int = 0, chunk: int | None = None) -> tuple[DataFrame, bool]:
    """(id, component, minus, conflict) for every vertex, and whether there is any conflict.

    A component is named by its smallest vertex; ``minus`` is 1 on the side opposite to it, ``conflict`` true in components without a
    two-colouring. Both are 0 and false unless ``signed``. Rows with a null end are ignored. All but the last join runs when this is called.
    """
    by_id = Window.partitionBy("id").orderBy("root", "side")
    before = {"last": F.lag("root").over(by_id), "last_side": F.lag("side").over(by_id)}
    seen = stored(_forest(edges, signed, degree, chunk or CHUNK).withColumns(before))
    ties = seen.filter("root != last OR side != last_side").select(F.col("root").alias("src"), F.col("last").alias("dst"), F.col("side").bitwiseXOR(F.col("last_side")).alias("odd")).distinct()
    if signed:
        label = _sides(materialize(ties))
    else:
        label = connected_components(ties).withColumns({"minus": F.lit(0), "conflict": F.lit(False)})
    label = materialize(label.toDF("root", "_c", "_m", "_x"))
    roots, odd = label.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("_x"), F.lit(False))).first()
    out = seen.filter("last IS NULL").join(F.broadcast(label) if roots <= BROADCAST_ROWS else label, "root", "left")
    conflict = F.coalesce("_x", F.lit(False))
    minus = F.col("side").bitwiseXOR(F.coalesce("_m", F.lit(0)))
    return out.select("id", F.coalesce("_c", "root").alias("component"), minus.alias("minus"), conflict.alias("conflict")), odd
