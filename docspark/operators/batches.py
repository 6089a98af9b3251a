"""Arrow batches of whole texts in parts of bounded size, so that a worker's memory does not grow with its partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once; a longer text is a part of its own.
PART_BYTES = 1 << 20
#: Most rows in an Arrow batch that Spark sends. Spark's own 10,000 could be gigabytes of long texts.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def parts(batches: Iterable[pa.RecordBatch], text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, in slices whose column `text` has at most `most` bytes, or one row."""
    for batch in batches:
        first, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if i > first and size + (n or 0) > most:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def map_texts(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over whole texts, in small batches."""
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)
