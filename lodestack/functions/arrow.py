"""Functions of rows as Arrow UDFs whose memory is that of their input batch and of about a megabyte of rows.

Spark bounds a batch (10,000 rows, 64 MB); rows become Python objects a few at a time and leave as soon as they are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and characters of input after which what was made of them is handed on.
MOST_ROWS, MOST_CHARS = 512, 1 << 20


def _parts(of: Callable, kind: pa.DataType, columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
    made, chars = [], 0
    for k in range(len(columns[0])):
        row = [c[k].as_py() for c in columns]
        made.append(of(*row))
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(made) >= MOST_ROWS or chars >= MOST_CHARS:
            yield pa.array(made, kind)
            made, chars = [], 0
    if made:
        yield pa.array(made, kind)


def row_by_row(of: Callable, returns: str | T.DataType, kind: pa.DataType, large: bool = False):
    """A UDF of what of() gives for each row; kind is the Arrow type of returns.

    Large results leave in parts; such a UDF has a Python worker of its own. Others are joined to a
    batch, and several in a projection share a worker.
    """

    def stream(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what the last batch left
            yield from _parts(of, kind, batch if isinstance(batch, tuple) else (batch,))

    def whole(*columns: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays([pa.array([], kind), *_parts(of, kind, columns)])

    return F.arrow_udf(stream if large else whole, returns)
