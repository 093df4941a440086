"""Session helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.sources.shared import fresh_path, stored

__all__ = ["column", "fresh_path", "sliced", "small_batches", "stored"]

#: Rows and text bytes of one slice of an Arrow batch that Python code turns into objects at a time; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker that the registered queries and the pipeline ask their session for.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Ask the session of an application for Arrow batches of bounded bytes, where it allows larger ones. The operators themselves leave the session as it is and work with any."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches (which Spark bounds in bytes) as slices of few rows and few bytes of ``text_col``, without copying."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and (i - begin >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no spare memory


def column(df: DataFrame, name: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
