"""Series that advance together: many ordered recurrences at once, Arrow in and out.

Rows are dealt by series once and sorted inside partitions. Complete series of one kind
and one length form a runs x steps table; a step of the recurrence is a fixed number of
array operations for all of them. Rows pass through with all their columns, so nothing is
joined back, and what is held is bounded by ``LOCKSTEP_ROWS`` and one series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of complete series that advance together, about.
LOCKSTEP_ROWS = 400_000


def numbers(table: pa.Table, column: str, shape: tuple[int, int]) -> np.ndarray:
    """A column as series x steps, null as NaN."""
    return np.asarray(table.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(shape)


def _runs(batch: pa.RecordBatch, by: str) -> list[tuple[int, int]]:
    """The stretches of equal keys in a batch."""
    code = pc.dictionary_encode(batch.column(by), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = (np.flatnonzero(np.diff(code)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(code)]))


def advance_together(dealt: DataFrame, by: str, kinds: list[str], advance: Callable, added: str) -> DataFrame:
    """``dealt``, partitioned by series ``by`` and sorted by it and by time, with columns ``added``.

    ``advance(kind, table, shape)`` gives the new columns, as arrays of series x steps, for
    series of one length whose ``kinds`` (constant in a series) have the values ``kind``.
    NaN becomes null.
    """
    extra = T.StructType.fromDDL(added)
    kept = [c for c in dealt.columns if c not in extra.names]
    schema = T.StructType([dealt.schema[c] for c in kept] + list(extra))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, list[pa.Table]] = {}
        held: list[pa.RecordBatch] = []  # of the series that may go on in the next batch
        key, rows = None, 0

        def close() -> int:
            whole = pa.Table.from_batches(held)
            kind = tuple(whole.column(c)[0].as_py() for c in kinds)
            ready.setdefault((*kind, len(whole)), []).append(whole)
            held.clear()
            return len(whole)

        def flush() -> Iterator[pa.RecordBatch]:
            for (*kind, steps), tables in ready.items():
                table = pa.concat_tables(tables).combine_chunks()
                made = advance(tuple(kind), table, (len(tables), steps))
                arrays = [table.column(c) for c in kept]
                for f in extra:
                    values = made[f.name].reshape(-1)
                    lacking = np.isnan(values) if values.dtype.kind == "f" else None
                    arrays.append(pa.array(values, mask=lacking).cast(to_arrow_type(f.dataType)))
                yield from pa.Table.from_arrays(arrays, names=schema.names).to_batches(max_chunksize=10_000)
            ready.clear()

        for batch in batches:
            for a, b in _runs(batch, by) if batch.num_rows else ():
                own = batch.column(by)[a].as_py()
                if held and own != key:
                    rows += close()
                    if rows >= LOCKSTEP_ROWS:
                        yield from flush()
                        rows = 0
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            close()
        yield from flush()

    return dealt.mapInArrow(of, schema)
