"""Walking Arrow batches of texts with memory bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: A batch that goes back to the JVM is closed once its values hold so many bytes.
BATCH_BYTES = 4 << 20


def values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null counts as empty."""
    for value in column:
        buffer = value.as_buffer()
        yield b"" if buffer is None else buffer.to_pybytes()


class Rows:
    """Gathers rows for a schema and gives them out in batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, row: tuple, size: int) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += size

    def full(self) -> bool:
        return self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(column, field.type) for column, field in zip(self.columns, self.schema)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)
