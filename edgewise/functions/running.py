"""Running aggregates in one order, over a whole table or by key, without gathering a table or a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


#: Rows that a bucket of one key may hold if the key has all rows; the number of buckets is bounded by 8 and 256.
BUCKET_ROWS = 500_000


def with_bucket(df: DataFrame, order: str, keyed: bool = False) -> DataFrame:
    """``df`` with a bucket number that rises with ``order``: an even cut of the range of its values.

    Only the two ends and the count come to the driver, by a job that runs when this is called. Order numbers of streams are dense, so the cut is even.
    """
    lo, hi, rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if lo is None or lo == hi:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    buckets = max(8, min(256, rows // BUCKET_ROWS)) if keyed else 256
    width = -(-(hi - lo + 1) // buckets)
    return df.withColumn("bucket", F.floor((F.col(order) - lo) / width).cast("long"))


def running(
    df: DataFrame, order: str, value: Column, kind: str = "sum", name: str = "total", before: str | None = None, by: tuple[str, ...] = (), then: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with the aggregate of ``value`` over all rows up to and including each, by ``order``, within the columns ``by``.

    Buckets of ``order`` are aggregated first, which combines before the shuffle; a window over one row a key and
    bucket, at most 256 a key, carries on what earlier buckets hold; each key's bucket then runs on its own, so a key
    with a large share of the rows takes as many tasks as others. Ties go by ``then``. ``before`` names a second
    column without the row itself.
    """
    agg = AGGREGATES[kind]
    placed = with_bucket(df.withColumn("_v", value), order, bool(by))
    ahead = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*by, "bucket").orderBy(order, *then)
    upto_here, before_here = (lambda w: w.rowsBetween(Window.unboundedPreceding, 0)), (lambda w: w.rowsBetween(Window.unboundedPreceding, -1))
    carried = placed.groupBy(*by, "bucket").agg(agg("_v").alias("_b")).select(*by, "bucket", agg("_b").over(ahead).alias("_c"))
    if by:
        # What is carried goes ahead of a bucket's rows as one more row, so that the rows are shuffled once and joined with nothing.
        marks = carried.filter("_c IS NOT NULL").select(*by, "bucket", F.col("_c").alias("_v"), F.lit(True).alias("_mark"))
        rows = placed.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        own = Window.partitionBy(*by, "bucket").orderBy(F.col("_mark").desc(), order, *then)
        whole = (lambda c: F.coalesce(c, F.lit(0))) if kind == "sum" else (lambda c: c)
        sums = {name: whole(agg("_v").over(upto_here(own)))}
        if before:
            sums[before] = whole(agg("_v").over(before_here(own)))
        return rows.withColumns(sums).filter("NOT _mark").drop("_v", "_mark", "bucket")
    sums = {"_upto": agg("_v").over(upto_here(own))}
    if before:
        sums["_before"] = agg("_v").over(before_here(own))
    inside = placed.withColumns(sums)
    # Without keys there are at most 256 rows to carry.
    joined = inside.join(F.broadcast(carried.withColumnRenamed("bucket", "_bucket")), F.col("bucket") == F.col("_bucket"))

    def upto(here: Column) -> Column:
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce("_c", F.lit(0))
        return (F.greatest if kind == "max" else F.least)(here, F.col("_c"))

    out = joined.withColumn(name, upto(F.col("_upto")))
    if before:
        out = out.withColumn(before, upto(F.col("_before")))
    return out.drop("_v", "_c", "_upto", "_before", "bucket", "_bucket")
