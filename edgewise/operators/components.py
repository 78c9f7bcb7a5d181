"""Connected components over an edge DataFrame, by repeated contraction.

Each round hooks every vertex to the smallest vertex next to it, shortens the resulting trees by
pointer doubling, and replaces the edges by edges between tree roots. The number of vertices left
at least halves each round, so rounds are logarithmic in the vertices. Nothing is collected;
lineage is cut in the shared checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import materialize


def _hooks(edges: DataFrame) -> DataFrame:
    """(id, parent): the smallest vertex next to or at each vertex, from edges with src > dst.

    Each vertex is a root, or has a smaller neighbour. Only partial aggregates are shuffled.
    """
    return edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))


def _moved(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the parents of their ends, larger end first, loops and repeats dropped."""
    p = parents.select(F.col("id").alias("src"), F.col("parent").alias("p"))
    q = parents.select(F.col("id").alias("dst"), F.col("parent").alias("q"))
    a, b = F.coalesce("p", "src"), F.coalesce("q", "dst")
    moved = edges.join(p, "src", "left").join(q, "dst", "left").select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
    return moved.filter("src != dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of ``edges``; a component is named by its smallest vertex.

    Vertex ids may be of any orderable type. Rows with a null end are ignored; a loop makes its
    vertex a component; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    given = edges.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    given = materialize(given)
    rest = given.filter("src != dst")
    label = None
    while not rest.isEmpty():
        parents = _hooks(rest)
        while True:  # double the pointers until every vertex points to a root
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
            jumped = materialize(parents.join(up, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("rose")))
            parents = jumped.select("id", "parent")
            if jumped.filter("rose").isEmpty():
                break
        rest = materialize(_moved(rest, parents))
        if label is None:
            label = parents
        else:
            step = parents.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
            kept = label.join(step, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent"))
            label = materialize(kept.unionByName(parents).groupBy("id").agg(F.min("parent").alias("parent")))
    vertices = given.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if label is None:
        return vertices.select("id", F.col("id").alias("component"))
    return vertices.join(label, "id", "left").select("id", F.coalesce("parent", "id").alias("component"))
