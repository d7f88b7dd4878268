"""Keyed folds over ordered rows, without ever holding a group in memory.

Rows are hash-partitioned by key and segment and sorted inside each partition,
so a fold sees them in order and keeps one key's state at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

READ_ROWS, FLUSH_ROWS = 1_000, 5_000  # held as Python values at a time


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable, schema: str,
                 tasks: int | None = None) -> DataFrame:
    """Fold each key's rows in order.

    ``make(key)`` returns an object with ``row(tuple) -> list`` and
    ``finish() -> list``, whose items are output rows after the key columns.
    ``tasks`` fixes the number of partitions, which is otherwise the session's.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))
    wanted = [*keys, *columns]
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, folder, rows = None, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(start, READ_ROWS)
                for values in zip(*(part.column(c).to_pylist() for c in wanted)):
                    if values[:width] != key:
                        if folder is not None:
                            rows += [key + tuple(r) for r in folder.finish()]
                        key = values[:width]
                        folder = make(*key)
                    rows += [key + tuple(r) for r in folder.row(*values[width:])]
                    if len(rows) >= FLUSH_ROWS:
                        yield _batch(rows, out)
                        rows = []
        if folder is not None:
            rows += [key + tuple(r) for r in folder.finish()]
        if rows:
            yield _batch(rows, out)

    arranged = df.select(*wanted, *[c for c in order if c not in wanted])
    arranged = arranged.repartition(*keys) if tasks is None else arranged.repartition(tasks, *keys)
    return arranged.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)
