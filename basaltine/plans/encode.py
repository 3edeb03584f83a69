"""Results as bytes: columnar chunks (Arrow streams of a bounded number of rows) or one JSON text a row.

Workers encode what they hold; nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a chunk.
CHUNK_ROWS = 1024


def chunks(df: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """(rows, chunk): the result in Arrow streams of at most `rows` rows each; empty partitions give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                own = batch.slice(at, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([own.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows", "chunk"])

    return df.mapInArrow(run, "rows long, chunk binary")


def unchunked(encoded: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("chunk"):
                yield from pa.ipc.open_stream(data.as_buffer())

    return encoded.select("chunk").mapInArrow(run, schema)


def lines(df: DataFrame) -> DataFrame:
    """(line): a JSON object for each row, null columns included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def unlined(encoded: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of JSON lines."""
    return encoded.select(F.from_json("line", schema).alias("r")).select("r.*")
