"""Near duplicates among embeddings by cosine, compared in tiles with PCA-ordered early stopping.

Vectors are scaled to length 1 and turned into the principal axes of all vectors (the rotation
keeps products), so the leading coordinates carry most of them. Two blocks are compared tile by
tile: products of the leading coordinates are added up first, and after each slice of coordinates
the rest of a product is bounded by the product of the suffix norms. Rows and columns of a tile
that can no longer reach the threshold leave it; a tile without any ends early.

Equal vectors form one class first. Classes are dealt to blocks by a hash, and each pair of blocks
is a task of its own. What leaves a task is one count a vector and spanning edges, never pairs.
Comparing all rows exactly costs the square of the classes; only memory and shuffle are bounded, by
the block: the table is cut in ``FEW_BLOCKS`` blocks, or more once they would exceed ``MOST_ROWS`` rows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of fewer components count as filled up with zeros;
repeated ids keep their rows, each judged by its own vector; rows without an id link as all others, but
do not name a component (null if no row of it has an id); an empty table gives an empty result;
columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.ngram_join import grouped, in_blocks, roots_of
from edgewise.operators.components import connected_components
from edgewise.session import materialize

FEW_BLOCKS = 8
LEAST_ROWS, MOST_ROWS = 512, 16_384
TILE = 1024
SLICE = 16
#: Products this close to the threshold are taken again from the vectors as given.
CLOSE = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares cannot overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def stacked(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """width x width, columns by falling second moment over all classes; a fixed number of sums is collected."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                v = unit(stacked(frame["embedding"].tolist(), width))
                total += v.T @ v
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = classes.select("embedding").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    moment = np.zeros((width, width))
    moment[sums["i"], sums["j"]] = sums["s"]
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float, near: float = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of all pairs whose product reaches threshold - near."""
    rows, columns = np.arange(len(a)), np.arange(len(b))
    least, width = threshold - near, a.shape[1]
    done = np.zeros((len(a), len(b)))
    for at in range(0, width, SLICE):
        done += a[rows, at : at + SLICE] @ b[columns, at : at + SLICE].T
        if at + SLICE >= width:
            break
        rest_a = np.sqrt(np.einsum("ij,ij->i", a[rows, at + SLICE :], a[rows, at + SLICE :]))
        rest_b = np.sqrt(np.einsum("ij,ij->i", b[columns, at + SLICE :], b[columns, at + SLICE :]))
        reach = done + rest_a[:, None] * rest_b[None, :] >= least
        keep_rows, keep_columns = reach.any(axis=1), reach.any(axis=0)
        if not keep_rows.any():
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        if keep_rows.mean() * keep_columns.mean() < 0.7:
            rows, columns = rows[keep_rows], columns[keep_columns]
            done = done[np.ix_(keep_rows, keep_columns)]
    i, j = np.nonzero(done >= least)
    return rows[i], columns[j], done[i, j]


def block_links(given: np.ndarray, turned: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of linked indices between ``left`` and ``right`` (or within them, if they are the same), tile by tile."""
    same = left is right
    for p in range(0, len(left), TILE):
        for q in range(p if same else 0, len(right), TILE):
            x, y = left[p : p + TILE], right[q : q + TILE]
            i, j, product = tile_pairs(turned[x], turned[y], threshold)
            if same and p == q:
                once = i < j
                i, j, product = i[once], j[once], product[once]
            i, j = x[i], y[j]
            close = np.flatnonzero(np.abs(product - threshold) < CLOSE)
            if len(close):
                u, v = given[i[close]], given[j[close]]
                exact = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
                product[close] = exact
            linked = product >= threshold
            yield np.stack([i[linked], j[linked]], 1)


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & sound & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = given.withColumn("usable", usable)
    good = rows.filter("usable").select("vec_id", "embedding")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("mark", F.monotonically_increasing_id()))  # ids may repeat, so classes have numbers of their own
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n:
        axes = principal_axes(classes, width)
        most = min(MOST_ROWS, max(LEAST_ROWS, -(-n // FEW_BLOCKS)))
        marked = classes.withColumns({"all": F.lit(0), "members": F.lit(n)})
        dealt = in_blocks(marked, "all", "mark", "members", most).select("block_a", "block_b", "block", "mark", "copies", "embedding")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in grouped(frames, ["block_a", "block_b"]):
                raw = stacked(g["embedding"].tolist(), width)
                turned = unit(raw) @ axes
                mark, copies, block = g["mark"].to_numpy(), g["copies"].to_numpy(), g["block"].to_numpy()
                a, b = g["block_a"].iat[0], g["block_b"].iat[0]
                left = np.flatnonzero(block == a)
                right = left if a == b else np.flatnonzero(block == b)
                links, edges = np.zeros(len(g), np.int64), [np.empty((0, 2), int)]
                for pairs in block_links(raw, turned, left, right, threshold):
                    if len(pairs):
                        links += np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(g)).astype(np.int64)
                        links += np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(g)).astype(np.int64)
                        root = roots_of(len(g), pairs)
                        tied = np.flatnonzero(root != np.arange(len(g)))
                        edges.append(np.stack([tied, root[tied]], 1))
                root = roots_of(len(g), np.concatenate(edges))
                has = links > 0
                yield pd.DataFrame({"mark": mark[has], "links": links[has], "root": mark[root[has]]})

        ordered = dealt.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b")
        found = materialize(ordered.mapInPandas(run, "mark long, links long, root long"))
        groups = connected_components(found.select(F.col("mark").alias("src"), F.col("root").alias("dst")))
        counts = found.groupBy("mark").agg(F.sum("links").alias("links"))
        placed = classes.join(counts, "mark", "left")
        placed = placed.join(groups.withColumnRenamed("id", "mark"), "mark", "left").withColumn("component", F.coalesce("component", "mark"))
        smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
        placed = placed.join(smallest, "component").select(
            "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    else:
        placed = classes.select("embedding", F.col("rep").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    # Stored first: both sides are plain exchanges then, and the copies of one vector can be dealt to several tasks.
    linked = good.join(materialize(placed), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding]) AS ok
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component c ON c.a = v.vec_id LEFT JOIN counts k ON k.a = v.vec_id
"""

QUERIES = {"op7_embedding_dedup": op7_query}
SQL = {"op7_embedding_dedup": OP7_SQL}
