"""Mixing sources to target word counts by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target number of words. A target above the source's own size is met by whole
epochs first; what is left over is a weighted sample without replacement: each document draws an
exponential key -ln(u) / quality, documents are sorted by key within their source, and sizes are
summed up along that order until the budget is reached. u comes from an md5 of the document id, so
reruns agree.

A source may hold a third of all rows, so the prefix sum never gathers a source in one task. The
unit interval of a monotone transform of the key is cut into slices (their number follows the
source's row count); slices are summed first, the sums of slices are accumulated by ranges of
slices in the same way, and the running sum inside a slice starts from there.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own, after
all others; repeated ids and ties in the key are ordered by id and then by text hash; a source of
size 0 has target 0; rows without an id draw no key and come last, by text hash; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.running import running
from edgewise.session import materialize

#: Rows that a slice of a source should hold.
SLICE_ROWS = 1000


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: the share of letters, of any script, among the characters."""
    n = F.length(text)
    letters = n - F.length(F.regexp_replace(text, r"\p{L}++", ""))
    return F.when(n > 0, F.lit(0.25) + F.lit(0.75) * letters / n).otherwise(F.lit(0.25))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """Targets by source, from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. A target never exceeds
    ``most_epochs`` times its source's size; what is above is dealt again by weight until no
    target is above. That fixed point is min(limit, level * weight) for one level, which is the
    largest over all prefixes of the sources ordered by limit / weight: no iteration is needed.
    One row a source, so the unpartitioned windows here hold as many rows as there are sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limited = by_source.withColumn("place", place).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most_epochs)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    top = limited.withColumn("level", level)
    return top.withColumn("target", F.least(F.col("limit").cast("double"), F.max("level").over(everything) * F.col("weight"))).select(
        "source", "source_size", "source_rows", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole_documents: bool = False,
    row_col: str | None = None,
) -> DataFrame:
    """Mix ``docs``; returns one row per document: doc_id, source, size, source_size, target, taken, epochs, and ``row_col`` if named.

    ``taken`` counts the words that the mix takes from a document, repeats counted: the whole
    epochs plus its part of the fractional sample. The document at the budget's edge gives only
    its first words, so the taken words of a source meet its target to one word; with
    ``whole_documents`` it is taken whole if at least half of it fits. ``epochs`` is the number
    of times that the document is begun.
    """
    text = F.col(text_col)
    row = [row_col] if row_col else []
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            (-F.log(uniform(F.col(id_col))) / quality_weight(text)).alias("key"),
            F.xxhash64(text).alias("tie"),
            *row,
        )
    )
    targets = source_targets(sizes, weights, share, most_epochs)
    targets = targets.withColumn("slices", F.ceil(F.col("source_rows") / SLICE_ROWS))
    targets = targets.withColumnRenamed("source", "of_source")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).select(
        *sizes.columns,
        "source_size",
        "target",
        # Rows without a key have as many slices again, after all others.
        F.coalesce(
            F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.lit(0.8))) * F.col("slices")), F.col("slices") + 1 + F.pmod(F.col("tie"), F.col("slices"))
        ).cast("long").alias("slice"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("full"),
    )
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sums = running(sums, "slice", F.col("slice_size"), name="slice_end", before="slice_start", by=("source",)).select(F.col("source").alias("of_source"), F.col("slice").alias("of_slice"), "slice_start")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "tie", *row).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice"))).withColumn(
        "start", F.col("inner_start") + F.col("slice_start")
    )
    left = F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long") - F.col("start")
    size = F.col("size")
    if whole_documents:
        part = F.when((size > 0) & (left * 2 >= size), size).otherwise(F.lit(0).cast("long"))
    else:
        part = F.greatest(F.lit(0).cast("long"), F.least(size, left))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("full") * size + part).alias("taken"),
        (F.col("full") + F.when(part > 0, 1).otherwise(0)).alias("epochs"),
        *row,
    )


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH base AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN length(text) > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * (length(text) - length(regexp_replace(text, '\\p{L}+', '', 'g')))
           / length(text) ELSE 0.25::DOUBLE END AS q,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM by_source),
limited AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS lim FROM placed),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM limited)
    - coalesce(sum(lim) OVER w, 0)::DOUBLE) / ((SELECT sum(weight) FROM limited) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS lev
  FROM limited WINDOW w AS (ORDER BY lim::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(lim::DOUBLE, (SELECT max(lev) FROM levels) * weight) AS target FROM levels),
run AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY -ln(b.u) / b.q, b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - start)))::BIGINT AS taken
FROM run
"""

QUERIES = {"op1_mixing": op1_query}
SQL = {"op1_mixing": OP1_SQL}
