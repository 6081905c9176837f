"""Python on the texts of rows, a bounded slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that become Python values at once; a batch may hold many times that.
SLICE_BYTES = 1 << 20


def slices(columns: tuple[pa.Array, ...], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64) for c in columns))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def sliced_udf(read: Callable, kind: T.DataType, most: int = SLICE_BYTES) -> Callable:
    """A column function of text columns that calls ``read`` for each row.  Python
    values and results are those of one slice, however large rows and batches are."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for a, b in slices(columns, most):
                yield pa.array([read(*row) for row in zip(*(c.slice(a, b - a).to_pylist() for c in columns))], arrow)
            if not len(columns[0]):
                yield pa.array([], arrow)

    return F.arrow_udf(run, kind)
