"""Matrix files as a Spark data source, and reads of them from any store that Spark reaches.

`odmat` (register with register(spark)) splits a local file by origins: the driver skims the row
records' five-byte heads for an index, tasks seek to their origins and decode only the selected
tables. read() takes files in other stores as well, whole, through Spark's binaryFile source.
"""

from __future__ import annotations

import io
import json
import mmap
import os
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from zonegrid import codec
from zonegrid.errors import from_text, od_error
from zonegrid.header import DEFAULT_BANNER, DEFAULT_RUN_ID, ODHeader, TableInfo, read_header, table_infos

#: Cells a task decodes, cells of an Arrow batch, bytes read for a header in a store.
TASK, BATCH, HEAD = 16 << 20, 1 << 18, 5 << 20


def wide_schema(tables: Iterable[TableInfo]) -> T.StructType:
    keys = [T.StructField("Origin", T.LongType()), T.StructField("Destination", T.LongType())]
    return T.StructType(keys + [T.StructField(t.column, T.DoubleType(), True, {"index": t.index, "name": t.name, "type_code": t.code}) for t in tables])


def records(source: BinaryIO, header: ODHeader, at: int, first: int = 1, last: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, origin, table, payload) of the rows of origins first to last; source stands at offset `at`.

    Rows must come in order, and nothing may follow the file's last one.
    """
    last = header.zone_count if last is None else last
    for origin in range(first, last + 1):
        for table in range(1, header.table_count + 1):
            head = source.read(5)
            if len(head) < 5:
                raise od_error("unexpected_eof", "in a row", at + len(head))
            got_origin, got_table, size = struct.unpack("<HBH", head)
            if size < 2:
                raise od_error("invalid_chunk_size", f"{size}", at + 3)
            payload = source.read(size - 2)
            if len(payload) < size - 2:
                raise od_error("unexpected_eof", "in a row", at + 5 + len(payload))
            _in_order(header, got_origin, got_table, origin, table, at)
            yield at, origin, table, payload
            at += 3 + size
    if last == header.zone_count and source.read(1):
        raise od_error("trailing_bytes", "behind the last row", at)


def _in_order(header: ODHeader, origin: int, table: int, want_origin: int, want_table: int, at: int) -> None:
    if not 1 <= origin <= header.zone_count:
        raise od_error("invalid_row_index", f"{origin} of {header.zone_count} zones", at)
    if not 1 <= table <= header.table_count:
        raise od_error("table_index_out_of_range", f"{table} of {header.table_count} tables", at)
    if (origin, table) != (want_origin, want_table):
        raise od_error("row_order_violation", f"row {origin}, table {table} instead of {want_origin}, {want_table}", at)


_known: dict[tuple, list[tuple[int, int, int]]] = {}


def index(path: str, header: ODHeader, at: int, step: int) -> list[tuple[int, int, int]]:
    """(offset, first, last origin) of parts of `step` origins, by the heads of the rows in the mapped file.

    A file of one part is not looked at. The index of a file is kept as long as its size and time stay.
    """
    found = os.stat(path)
    key = (path, found.st_size, found.st_mtime_ns, found.st_ino, at, step)
    if key not in _known:
        if len(_known) > 64:
            _known.clear()
        _known[key] = _indexed(path, header, at, step, found.st_size)
    return _known[key]


def _indexed(path: str, header: ODHeader, at: int, step: int, size: int) -> list[tuple[int, int, int]]:
    if step >= header.zone_count or at >= size:
        return [(at, 1, header.zone_count)]
    parts, head = [], struct.Struct("<HBH").unpack_from
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        for origin in range(1, header.zone_count + 1):
            if (origin - 1) % step == 0:
                parts.append((at, origin, min(origin + step - 1, header.zone_count)))
            for table in range(1, header.table_count + 1):
                if at + 5 > size:
                    return parts  # the task that reads so far reports it
                got_origin, got_table, length = head(data, at)
                if length < 2 or (got_origin, got_table) != (origin, table) or at + 3 + length > size:
                    return parts[:-1] + [(parts[-1][0], parts[-1][1], header.zone_count)]
                at += 3 + length
    return parts


def _decoded(rows: Iterable[tuple[int, int, int, bytes]], header: ODHeader, chosen: Sequence[TableInfo]) -> Iterator[tuple[int, np.ndarray]]:
    """Each origin with the values of the chosen tables; the others are not decoded."""
    place = {t.index: i for i, t in enumerate(chosen)}
    values = np.zeros((len(chosen), header.zone_count))
    for at, origin, table, payload in rows:
        if table in place:
            try:
                values[place[table]] = codec.decode(payload, header.tables[table - 1].code, header.zone_count)
            except Exception as e:
                if getattr(e, "kind", None) is None or e.offset is not None:
                    raise
                raise od_error(e.kind, e.message, at) from None
        if table == header.table_count:
            yield origin, values


def _batches(rows: Iterable[tuple[int, np.ndarray]], names: list[str], zeros: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        origins, places, cells = (np.concatenate(c, axis=-1) for c in zip(*held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(origins), pa.array(places), *map(pa.array, cells)], ["Origin", "Destination", *names])

    for origin, values in rows:
        at = np.arange(values.shape[1]) if zeros else np.flatnonzero((values != 0).any(axis=0))
        if len(at):
            held.append((np.full(len(at), origin, np.int64), at.astype(np.int64) + 1, values[:, at]))
            n += values[:, at].size
        if n >= BATCH:
            yield flush()
            n = 0
    if held:
        yield flush()


class _Part(InputPartition):
    def __init__(self, offset: int, first: int, last: int) -> None:
        self.offset, self.first, self.last = offset, first, last


class _Reader(DataSourceReader):
    """Decodes parts of a file."""

    def __init__(self, path: str, header: ODHeader, chosen: list[TableInfo], names: list[str], start: int, zeros: bool) -> None:
        self.path, self.header, self.chosen, self.names, self.start, self.zeros = path, header, chosen, names, start, zeros
        self.low, self.high = 1, header.zone_count

    def partitions(self) -> Sequence[InputPartition]:
        step = max(1, TASK // (self.header.zone_count * self.header.table_count))
        parts = index(self.path, self.header, self.start, step)
        return [_Part(*p) for p in parts if p[1] <= self.high and p[2] >= self.low]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            rows = records(f, self.header, partition.offset, partition.first, partition.last)
            yield from _batches((r for r in _decoded(rows, self.header, self.chosen) if self.low <= r[0] <= self.high), self.names, self.zeros)


class _FilteredReader(_Reader):
    """Takes bounds on Origin as well; Spark allows this where spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("Origin",) and isinstance(value := getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f  # Spark applies them again


def zero_rows(header: ODHeader):
    """The rows of an origin whose cells are all zero."""
    zero = [codec.encode(np.zeros(1), t.code) for t in header.tables]
    return lambda origin: b"".join(codec.record(origin, t.index, z) for t, z in zip(header.tables, zero))


def _copy(source: BinaryIO, target: BinaryIO, at: int, size: int) -> None:
    """Copies bytes inside the kernel where it can, so that they don't pass through this process."""
    target.flush()
    source.seek(at)
    while size:
        try:
            n = os.copy_file_range(source.fileno(), target.fileno(), size, offset_src=at)
        except (AttributeError, OSError):
            n = 0
        if not n:
            source.seek(at)
            while size:
                data = source.read(min(size, 1 << 24))
                target.write(data)
                size -= len(data)
            target.flush()
            return
        at, size = at + n, size - n


def _cells_by_origin(batches: Iterator[pa.RecordBatch], h: ODHeader) -> dict[int, np.ndarray]:
    """Each origin's values (table, destination), missing pairs 0."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        origins, places = (np.asarray(b.column(i).cast(pa.int64())) for i in (0, 1))
        if len(origins) and not (1 <= min(origins.min(), places.min()) and max(origins.max(), places.max()) <= h.zone_count):
            raise od_error("invalid_row_index", f"a pair lies outside 1 to {h.zone_count}")
        cells = np.stack([np.asarray(b.column(2 + i).fill_null(0.0)) for i in range(h.table_count)])
        order = np.argsort(origins, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(origins[order])) + 1) if len(order) else ():
            values = held.setdefault(int(origins[at[0]]), np.zeros((h.table_count, h.zone_count)))
            values[:, places[at] - 1] = cells[:, at]
    return held


def encoded_origins(df: DataFrame, header: ODHeader) -> DataFrame:
    """(origin, rows) for each origin of df, whose cells of one origin are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _cells_by_origin(batches, header)
        for origin in sorted(held):
            data = b"".join(codec.record(origin, t.index, codec.encode(v, t.code)) for t, v in zip(header.tables, held[origin]))
            yield pa.RecordBatch.from_pydict({"origin": [origin], "rows": [data]}, schema=pa.schema([("origin", pa.int32()), ("rows", pa.binary())]))

    return df.mapInArrow(run, "origin int, rows binary")


class _Staged(WriterCommitMessage):
    def __init__(self, path: str, origins: list[tuple[int, int, int]]) -> None:
        self.path, self.origins = path, origins


class _Writer(DataSourceArrowWriter):
    """Encodes whole origins in tasks, beside the target; commit puts them in order behind the header.

    All cells of an origin must be in one task (repartition by Origin); missing pairs are 0.
    """

    def __init__(self, path: str, header: ODHeader) -> None:
        self.path, self.header = path, header.checked()

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        h, held = self.header, _cells_by_origin(batches, self.header)
        staged, origins = f"{self.path}.part-{uuid.uuid4().hex}", []
        with open(staged, "wb") as f:
            for origin in sorted(held):
                data = b"".join(codec.record(origin, t.index, codec.encode(v, t.code)) for t, v in zip(h.tables, held[origin]))
                origins.append((origin, f.tell(), len(data)))
                f.write(data)
        return _Staged(staged, origins)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m for m in messages if isinstance(m, _Staged)]
        where = {}
        for m in parts:
            for origin, at, size in m.origins:
                if origin in where:
                    raise od_error("writer_position_mismatch", f"origin {origin} is in two tasks; repartition by Origin")
                where[origin] = (m.path, at, size)
        zero = zero_rows(self.header)
        temporary = f"{self.path}.writing"
        files = {m.path: open(m.path, "rb") for m in parts}
        try:
            with open(temporary, "wb") as f:
                f.write(self.header.to_bytes())
                run: tuple[str, int, int] | None = None  # what one call copies: origins that stand together in a part
                for origin in range(1, self.header.zone_count + 1):
                    if origin in where and run is not None and (run[0], run[1] + run[2]) == where[origin][:2]:
                        run = (run[0], run[1], run[2] + where[origin][2])
                        continue
                    if run is not None:
                        _copy(files[run[0]], f, run[1], run[2])
                    run = where.get(origin)
                    if run is None:
                        f.write(zero(origin))
                if run is not None:
                    _copy(files[run[0]], f, run[1], run[2])
        finally:
            for opened in files.values():
                opened.close()
        os.replace(temporary, self.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if isinstance(m, _Staged) and os.path.exists(m.path):
                os.remove(m.path)


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class MatSource(DataSource):
    """Options: path, tables (JSON list of names), include_zeros, pushdown (of bounds on Origin); for writes zone_count, type_codes (JSON), banner, run_id."""

    @classmethod
    def name(cls) -> str:
        return "odmat"

    def _opened(self) -> tuple[str, ODHeader, list[TableInfo], list[str], int]:
        path = local(self.options["path"])
        try:
            with open(path, "rb") as f:
                header, start = read_header(f)
        except OSError as e:
            raise od_error("io", str(e)) from None
        own, chosen = header, list(header.tables)
        if self.options.get("tables"):
            own, chosen = header.narrowed(json.loads(self.options["tables"]))
        return path, header, chosen, own.columns, start

    def schema(self) -> T.StructType:
        _, _, chosen, _, _ = self._opened()
        return wide_schema(table_infos(chosen))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        """Decodes the tables that the schema has; one that is given with fewer columns than the file's prunes them."""
        path, header, chosen, names, start = self._opened()
        if schema.names[:2] != ["Origin", "Destination"] or set(schema.names[2:]) - set(names):
            raise od_error("table_not_found", f"a schema is Origin, Destination and tables of {', '.join(names)}, not {', '.join(schema.names)}")
        place = {n: t for n, t in zip(names, chosen)}
        chosen, names = [place[c] for c in schema.names[2:]], schema.names[2:]
        kind = _FilteredReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(path, header, chosen, names, start, self.options.get("include_zeros", "false").lower() == "true")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        codes = json.loads(self.options.get("type_codes", "{}"))
        pairs = json.loads(self.options.get("tables_written", "null")) or [(n, codes.get(n, "D")) for n in schema.names[2:]]
        zones = int(self.options["zone_count"])
        return _Writer(local(self.options["path"]), ODHeader(zones, table_infos([tuple(p) for p in pairs]), self.options.get("banner", DEFAULT_BANNER), self.options.get("run_id", DEFAULT_RUN_ID)))


class ReadMat:
    """Table function read_mat(path, tables => array(...), include_zeros => true): one task, for SQL at hand.

    Spark's vectorised table functions can't tell their columns from a file, so rows are tuples; the format
    odmat is the one for large files.
    """

    @staticmethod
    def analyze(path, tables=None, include_zeros=None):
        from pyspark.sql.udtf import AnalyzeResult

        with open(local(path.value), "rb") as f:
            header, _ = read_header(f)
        own = header.narrowed(list(tables.value))[0] if tables is not None and tables.value is not None else header
        return AnalyzeResult(T.StructType([T.StructField(f.name, f.dataType) for f in wide_schema(own.tables)]))

    def eval(self, path: str, tables: list[str] | None = None, include_zeros: bool = False):
        with open(local(path), "rb") as f:
            header, start = read_header(f)
            chosen = header.narrowed(tables)[1] if tables is not None else list(header.tables)
            for origin, values in _decoded(records(f, header, start), header, chosen):
                at = np.arange(header.zone_count) if include_zeros else np.flatnonzero((values != 0).any(axis=0))
                yield from zip(repeat(origin), (at + 1).tolist(), *values[:, at].tolist())


def register(spark: SparkSession) -> None:
    """Makes the format odmat and the table function read_mat known to a session."""
    from pyspark.sql.functions import udtf

    spark.dataSource.register(MatSource)
    spark.udtf.register("read_mat", udtf(ReadMat))


def read(spark: SparkSession, path: str, tables: Sequence[str] | None = None, include_zeros: bool = False) -> tuple[ODHeader, DataFrame]:
    """Header and wide relation of a file; files in other stores are decoded whole, in one task each."""
    if "://" not in path or path.startswith("file:"):
        try:
            with open(local(path), "rb") as f:
                header, _ = read_header(f)
        except OSError as e:
            raise od_error("io", str(e)) from None
        own = header.narrowed(list(tables))[0] if tables is not None else header
        register(spark)
        pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        options = {"path": path, "include_zeros": str(include_zeros).lower(), "pushdown": str(pushdown)} | ({"tables": json.dumps(list(tables))} if tables is not None else {})
        return own, spark.read.format("odmat").options(**options).load()
    files = spark.read.format("binaryFile").load(path)
    row = files.select(F.substring("content", 1, HEAD).alias("head")).first()
    header, _ = read_header(io.BytesIO(bytes(row["head"]))) if row else (None, None)
    if header is None:
        raise od_error("io", f"no file at {path}")
    own, chosen = header.narrowed(list(tables)) if tables is not None else (header, list(header.tables))
    return own, decode_files(files, header, chosen, own.columns, include_zeros)


def decode_files(files: DataFrame, header: ODHeader, chosen: list[TableInfo], names: list[str], zeros: bool = False) -> DataFrame:
    """The wide relation of binaryFile rows that all have this header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(b.schema.get_field_index("content")):
                source = io.BytesIO(content.as_py())
                _, start = read_header(source)
                yield from _batches(_decoded(records(source, header, start), header, chosen), names, zeros)

    return files.select("content").mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in wide_schema(table_infos(chosen))]))


def validate(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, ok, zones, tables, rows, kind, offset) of files, each decoded in full; Spark leaves out empty ones."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                zones = tables = rows = 0
                kind = offset = None
                try:
                    source = io.BytesIO(content.as_py())
                    header, start = read_header(source)
                    zones, tables = header.zone_count, header.table_count
                    for _ in _decoded(records(source, header, start), header, list(header.tables)):
                        rows += tables
                except Exception as e:
                    found = from_text(str(e))
                    if found is None:
                        raise
                    kind, offset = found.kind, found.offset
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "ok": kind is None, "zones": zones, "tables": tables, "rows": rows, "kind": kind, "offset": offset}], schema=pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("zones", pa.int32()), ("tables", pa.int32()), ("rows", pa.int64()), ("kind", pa.string()), ("offset", pa.int64())]))

    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInArrow(check, "path string, ok boolean, zones int, tables int, rows long, kind string, offset long")
