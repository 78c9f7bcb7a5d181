"""Readers, generators and writers of edges.

Every reader gives the canonical columns src, dst, value, ts and seq. Files have no arrival order in
Spark, so ``seq`` comes from the caller's column where there is one, else from
``monotonically_increasing_id`` over the file, which keeps the order of lines within a file.
Readers take ``streaming=True`` for the same columns (without seq) as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("src", "dst", "value", "ts", "seq")


def _lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", 1) if streaming else spark.read
    lines = reader.format("text").load(path)
    lines = lines.filter(F.trim("value") != "")
    return lines if streaming else lines.withColumn("seq", F.monotonically_increasing_id())


def _edges(lines: DataFrame, tokens: Column, value: Column | None = None, ts: Column | None = None) -> DataFrame:
    rows = lines.withColumn("tokens", tokens)
    kept = [
        F.col("tokens")[0].cast("long").alias("src"),
        F.col("tokens")[1].cast("long").alias("dst"),
        (value if value is not None else F.lit(None).cast("long")).alias("value"),
        (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"),
    ]
    return rows.select(*kept, *([F.col("seq")] if "seq" in lines.columns else []))


def read_tab_separated(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of source and target, tab-separated."""
    return _edges(_lines(spark, path, streaming), F.split("value", "\t"))


def read_white_space(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of source and target, separated by one white-space character."""
    return _edges(_lines(spark, path, streaming), F.split("value", r"\s"))


def read_timestamped(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of source, target and event time in milliseconds; the time is the stream's clock, not a value."""
    tokens = F.split("value", r"\s")
    return _edges(_lines(spark, path, streaming), tokens, ts=F.timestamp_millis(F.col("tokens")[2].cast("long")))


def read_event_list(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of source, target and sign; anything but + deletes. Adds ``op``, +1 or -1."""
    lines = _lines(spark, path, streaming)
    edges = _edges(lines, F.split("value", r"\s"), value=F.when(F.col("tokens")[2] == "+", 1).otherwise(-1).cast("long"))
    return edges.withColumnRenamed("value", "op")


def read_commented(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """White-space lines, those whose first token is % skipped."""
    lines = _lines(spark, path, streaming)
    return _edges(lines.filter(F.split("value", r"\s")[0] != "%"), F.split("value", r"\s"))


def read_ratings(spark: SparkSession, path: str, streaming: bool = False, offset: int = 1_000_000, scale: int = 10) -> DataFrame:
    """Tab-separated user, item and rating; items are moved past the users, ratings scaled to integers."""
    edges = _edges(_lines(spark, path, streaming), F.split("value", "\t"), value=(F.col("tokens")[2].cast("double") * scale).cast("long"))
    return edges.withColumn("dst", F.col("dst") + offset)


def _generated(ks: DataFrame, targets: list[tuple[Column, Column]], ts: Column | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst")) for a, b in targets])
    rows = ks.select("k", F.posexplode(pairs).alias("o", "edge"))
    return rows.select(
        "edge.src", "edge.dst", F.lit(None).cast("long").alias("value"), (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"),
        (F.col("k") * len(targets) + F.col("o")).alias("seq"),
    )


def generate(spark: SparkSession, shape: str, n: int = 100) -> DataFrame:
    """Generated graphs: components, bipartite, ring, near (each vertex with the next two) and windows (near with event times)."""
    ks, k = spark.range(1, n + 1).withColumnRenamed("id", "k"), F.col("k")
    at = F.timestamp_millis(k * 100)
    if shape == "components":
        return _generated(ks, [(k, k + 2)], at)
    if shape == "bipartite":
        return _generated(ks, [(k, 2 * k + 1)] * 10)
    if shape == "ring":
        return _generated(ks.select((k - 1).alias("k")), [(k, (k + 2) % n), (k, (k + 4) % n)])
    if shape == "near":
        return _generated(ks, [(k, k + 1), (k, k + 2)])
    if shape == "windows":
        return _generated(ks, [(k, k + 1), (k, k + 2)], at)
    raise ValueError(f"no such shape: {shape}")


def from_rows(spark: SparkSession, rows: list[tuple], ts_ms: int | None = 0) -> DataFrame:
    """Edges of tuples (src, dst), (src, dst, value) or (src, dst, value, ts_ms), in their order."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else ts_ms, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "src long, dst long, value long, ms long, seq long")
    return df.select("src", "dst", "value", F.timestamp_millis("ms").alias("ts"), "seq")


# --- graphs from the relational tables -------------------------------------------------------------


def events_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General multigraph: users to the number in the event's properties; value in cents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("long").alias("dst"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    ).filter("dst IS NOT NULL")


def orders_parts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite graph: orders to parts, one edge a line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))


def suppliers_parts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bipartite graph: suppliers to parts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


def turnstile_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events graph whose every second occurrence of an edge deletes it."""
    from pyspark.sql import Window

    e = events_graph(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("src", "dst").orderBy("seq"))
    return e.withColumn("op", F.when(turn % 2 == 1, 1).otherwise(-1)).select("src", "dst", "op", "seq")


# --- sinks -----------------------------------------------------------------------------------------


def _text(df: DataFrame, sep: str) -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for c in df.columns]).alias("value"))


def write_text(df: DataFrame, path: str, sep: str = " ") -> None:
    _text(df, sep).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path)


def write_stream(df: DataFrame, kind: str, path: str | None = None, checkpoint: str | None = None, each=None, mode: str = "append", name: str | None = None):
    """Start a stream into text or csv files, the console, memory, or a function of each micro-batch."""
    out = _text(df, " ") if kind == "text" else df
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if kind == "each":
        return writer.foreachBatch(each).start()
    return writer.format(kind).start(path) if path else writer.format(kind).start()
