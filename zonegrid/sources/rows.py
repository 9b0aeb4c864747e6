"""Matrix files row by row on one machine, in file order, without Spark: for tools and for small files."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from zonegrid import codec
from zonegrid.errors import od_error
from zonegrid.header import ODHeader, read_header
from zonegrid.sources.matfile import local, records


@dataclass(frozen=True)
class Row:
    """One origin's values in one table; is_zero_row tells how it was stored, and rows compare without it."""

    row_index: int
    table_index: int
    values: np.ndarray
    is_zero_row: bool = field(default=False, compare=False)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Row) and (self.row_index, self.table_index) == (other.row_index, other.table_index) and np.array_equal(self.values, other.values)


class RowReader:
    """Reads rows in order; rows of tables that are not asked for are passed over, not decoded."""

    def __init__(self, source: str | bytes | BinaryIO) -> None:
        if isinstance(source, str):
            try:
                source = open(local(source), "rb")
            except OSError as e:
                raise od_error("io", str(e)) from None
        self.source = io.BytesIO(source) if isinstance(source, bytes) else source
        self.header, self._start = read_header(self.source)
        self._rewind()

    def _rewind(self) -> None:
        self.rows_read = 0
        self.position = self._start
        self._records = records(self.source, self.header, self._start)

    def reset(self) -> None:
        """Back to the first row."""
        self.source.seek(self._start)
        self._rewind()

    def into_inner(self) -> BinaryIO:
        """The source, standing where the last row that was read ends; the reader is done with."""
        self.source.seek(self.position)
        self._records = iter(())
        return self.source

    def prepare_selection(self, keys: Iterable[str | int]) -> frozenset[int]:
        """Tables by name or by index from 1, for read_selected_row; repeated ones count once."""
        found = set()
        for k in keys:
            if isinstance(k, int) and not isinstance(k, bool):
                if not 1 <= k <= self.header.table_count:
                    raise od_error("table_index_out_of_range", f"{k} of {self.header.table_count} tables")
                found.add(k)
            else:
                found.add(self.header.table(k).index)
        return frozenset(found)

    def read_selected_row(self, selection: frozenset[int]) -> Row | None:
        """The next row of one of the tables, or None at the end."""
        if not selection:
            return None
        for at, origin, table, payload in self._records:
            self.rows_read += 1
            self.position = at + 5 + len(payload)
            if table in selection:
                try:
                    values = codec.decode(payload, self.header.tables[table - 1].code, self.header.zone_count)
                except Exception as e:
                    raise od_error(e.kind, e.message, at) if getattr(e, "kind", None) else e from None
                return Row(origin, table, values, payload[2:] == b"\0")
        return None

    def read_row(self) -> Row | None:
        """The next row of any table."""
        return self.read_selected_row(frozenset(range(1, self.header.table_count + 1)))

    def read_table_row(self, key: str | int) -> Row | None:
        """The next row of one table."""
        return self.read_selected_row(self.prepare_selection([key]))

    def rows(self, keys: Sequence[str | int] | None = None) -> Iterator[Row]:
        selection = self.prepare_selection(keys if keys is not None else range(1, self.header.table_count + 1))
        while (row := self.read_selected_row(selection)) is not None:
            yield row


class RowWriter:
    """Writes a file's rows in order: origin by origin, in each the tables by index."""

    def __init__(self, target: str | BinaryIO, header: ODHeader) -> None:
        self.header = header.checked()
        self.target = open(local(target), "wb") if isinstance(target, str) else target
        self.target.write(header.to_bytes())
        self.rows_written = 0

    @property
    def _tables(self) -> int:
        return self.header.table_count

    def _left(self) -> int:
        return self.header.row_count - self.rows_written

    def write_next_row(self, values: Sequence[float] | np.ndarray) -> None:
        if not self._left():
            raise od_error("writer_finished", "all rows are written")
        values = np.asarray(values, np.float64)
        if values.shape != (self.header.zone_count,):
            raise od_error("zone_count_mismatch", f"{values.shape} values for {self.header.zone_count} zones")
        origin, table = divmod(self.rows_written, self._tables)
        self.target.write(codec.record(origin + 1, table + 1, codec.encode(values, self.header.tables[table].code)))
        self.rows_written += 1

    def _block(self, values: object, shape: tuple[int, ...]) -> np.ndarray:
        values = np.asarray(values, np.float64)
        if values.size != int(np.prod(shape)):
            raise od_error("shape_mismatch", f"{values.shape} instead of {shape}")
        return values.reshape(shape)

    def write_origins(self, values: object, count: int) -> None:
        """count origins' tables by zones, from the start of an origin."""
        block = self._block(values, (count * self._tables, self.header.zone_count))
        if self.rows_written % self._tables:
            raise od_error("writer_position_mismatch", "the writer stands inside an origin")
        if len(block) > self._left():
            raise od_error("writer_finished", f"{len(block)} rows for {self._left()} left")
        for row in block:
            self.write_next_row(row)

    def write_origin(self, values: object) -> None:
        self.write_origins(values, 1)

    def write_stack(self, values: object) -> int:
        """What is left to write of a whole array (table, origin, destination); returns the rows written."""
        z = self.header.zone_count
        stack = self._block(values, (self._tables, z, z))
        if not self._left():
            raise od_error("writer_finished", "all rows are written")
        first = self.rows_written
        for n in range(first, self.header.row_count):
            origin, table = divmod(n, self._tables)
            self.write_next_row(stack[table, origin])
        return self.rows_written - first

    def flush(self) -> None:
        self.target.flush()

    def into_inner(self) -> BinaryIO:
        """The target as it is, whether or not every row is there."""
        return self.target

    def finish(self) -> BinaryIO:
        """The target, once every row is there."""
        if self._left():
            raise od_error("incomplete_matrix", f"{self._left()} of {self.header.row_count} rows are missing")
        self.flush()
        return self.target
