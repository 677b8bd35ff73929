"""What the operators of this subpackage share: Arrow helpers, and the core's reading and intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.tables import checkpointed as cut
from ..sources.tables import spread, table, written

__all__ = ["TOKENIZER_DIR", "cut", "per_batch", "slices", "spread", "table", "written"]

TOKENIZER_DIR = "/opt/tokenizers"


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state per task: make() runs once in a task and returns what handles each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            out = handle(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text adds up to about so many bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
