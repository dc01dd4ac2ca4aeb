"""Arrow batches cut so that what one step holds of them is bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step takes at a time; a longer text is taken alone.
STEP = 8 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """The rows in pieces that hold at most ``most`` bytes in ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
