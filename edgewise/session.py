"""Session helpers: cutting lineage in shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set only where none is and all tasks run on one machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not configured and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="edgewise-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage there.

    The files outlive any executor, so later jobs never recompute or lose them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries that are planned and run inside have these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def small_batches(spark: SparkSession, rows: int = 1000) -> contextlib.AbstractContextManager[None]:
    """Python workers get at most so many rows at a time, so that long texts do not add up in them."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder; smaller than ``materialize`` for wide or text rows."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever Spark keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Intermediate tables of one computation, deleted when its ``with`` block ends: by then nothing lazy may read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def store(self, df: DataFrame) -> DataFrame:
        return stored(df, self.folder)
