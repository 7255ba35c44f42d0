"""Folds over a file's rows in order, as they pass: what is held is the fold's own state, never a file."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows that are Python objects at once on their way in, and out.
ROWS, OUT_ROWS = 256, 4096


class Fold(Protocol):
    """The state of one file. Both give rows without the file_id."""

    def row(self, *values) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def fold_rows(rows: DataFrame, columns: list[str], order: list[str], make: Callable[[], Fold], out: str) -> DataFrame:
    """file_id and the fields of `out`: each file's rows (file_id and columns), in order, through one fold of its own.

    Files are dealt to tasks and sorted there (sorting spills); rows of a file go through the fold one by one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema["file_id"], *T._parse_datatype_string(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            values = list(zip(*found, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        found: list[tuple] = []
        for part in batches:
            for at in range(0, part.num_rows, ROWS):
                for file_id, *values in zip(*(c.to_pylist() for c in part.slice(at, ROWS).columns), strict=True):
                    if fold is None or file_id != key:
                        for x in fold.end() if fold is not None else ():
                            found.append((key, *x))
                            if len(found) >= OUT_ROWS:
                                yield batch(found)
                                found = []
                        key, fold = file_id, make()
                    found += ((key, *x) for x in fold.row(*values))
                    if len(found) >= OUT_ROWS:
                        yield batch(found)
                        found = []
        for x in fold.end() if fold is not None else ():
            found.append((key, *x))
            if len(found) >= OUT_ROWS:
                yield batch(found)
                found = []
        yield batch(found)

    sorted_rows = rows.select("file_id", *dict.fromkeys([*columns, *order])).repartition("file_id").sortWithinPartitions("file_id", *order)
    return sorted_rows.select("file_id", *columns).mapInArrow(run, schema)
