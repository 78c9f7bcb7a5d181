"""All rows in one order for a Python fold in one task, without that task's sorting them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a block.
BLOCK = 10_000


def fold_in_order(rows: DataFrame, order: str, fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``fold`` over frames of ``rows`` by ``order``, in one task that reads them block by block and holds only its state.

    Ranges of the order are sorted in many tasks and packed into compressed blocks; the one task orders the blocks only.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own, sink = batch.slice(at, BLOCK), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(own)
                first = own.column(own.schema.get_field_index(order))[0].as_py()
                yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int64()), "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                n += 1

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["block"]:
                yield pa.ipc.open_stream(block).read_pandas()

    blocks = rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(pack, "first long, n long, block binary")
    return blocks.repartition(1).sortWithinPartitions("first", "n").mapInPandas(lambda frames: fold(unpacked(frames)), schema)
