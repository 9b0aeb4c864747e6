"""ODMatrix: a header and a sparse wide DataFrame, with the operators as methods."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.errors import od_error
from zonegrid.functions.cells import quantised, quoted
from zonegrid.header import DEFAULT_BANNER, DEFAULT_RUN_ID, ODHeader, TableInfo, table_infos
from zonegrid.operators import aggregates, reshape, updates
from zonegrid.operators.ingest import IngestOptions, ingest
from zonegrid.sources import matfile, tabular

#: Zones up to which arrays are made on the driver.
MOST_DENSE = 4_096


@dataclass(frozen=True)
class ODMatrix:
    """An immutable matrix: updates give a new one. Pairs that frame lacks are 0.0 in every table."""

    header: ODHeader
    frame: DataFrame

    # Making

    @classmethod
    def read(cls, spark: SparkSession, path: str, tables: Sequence[str] | None = None) -> ODMatrix:
        return cls(*matfile.read(spark, path, tables))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, tables: Sequence[str] | None = None) -> ODMatrix:
        import io

        header, _ = matfile.read_header(io.BytesIO(data))
        own, chosen = header.narrowed(list(tables)) if tables is not None else (header, list(header.tables))
        files = spark.createDataFrame([(bytearray(data),)], "content binary")
        return cls(own, matfile.decode_files(files, header, chosen, own.columns))

    @classmethod
    def create(cls, spark: SparkSession, zone_count: int, tables: Iterable[object], banner: str = DEFAULT_BANNER, run_id: str = DEFAULT_RUN_ID) -> ODMatrix:
        """All zeros."""
        header = cls.validate_schema(zone_count, tables, banner, run_id)
        return cls(header, spark.createDataFrame([], matfile.wide_schema(header.tables)))

    @staticmethod
    def validate_schema(zone_count: int, tables: Iterable[object], banner: str = DEFAULT_BANNER, run_id: str = DEFAULT_RUN_ID) -> ODHeader:
        """The header of such a matrix, checked as for create(); names must differ."""
        header = ODHeader(zone_count, table_infos(tables), banner, run_id).checked()
        if any(not n.strip() for n in header.names) or len(set(header.names)) < header.table_count:
            raise od_error("invalid_table_name", "names are blank or repeat")
        return header

    def like(self) -> ODMatrix:
        return ODMatrix(self.header, self.frame.limit(0))

    def copy(self) -> ODMatrix:
        return self

    @classmethod
    def from_dataframe(cls, df: DataFrame, options: IngestOptions = IngestOptions()) -> ODMatrix:
        return cls(*ingest(df, options))

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf: object, options: IngestOptions = IngestOptions()) -> ODMatrix:
        return cls(*ingest(spark.createDataFrame(pdf), options))

    @classmethod
    def from_polars(cls, spark: SparkSession, frame: object, options: IngestOptions = IngestOptions()) -> ODMatrix:
        return cls(*ingest(spark.createDataFrame(frame.to_arrow()), options))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), **read: str) -> ODMatrix:
        return cls(*tabular.from_csv(spark, path, options, **read))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), columns: Sequence[str] | None = None, parquet_engine: str = "auto") -> ODMatrix:
        return cls(*tabular.from_parquet(spark, path, options, columns=columns, engine=parquet_engine))

    @classmethod
    def from_arrays(cls, spark: SparkSession, arrays: Mapping[str, np.ndarray], codes: Mapping[str, object] | None = None, **header: str) -> ODMatrix:
        """From a square array a table."""
        sizes = {a.shape for a in map(np.asarray, arrays.values())}
        if len(sizes) != 1 or len(shape := next(iter(sizes))) != 2 or shape[0] != shape[1]:
            raise od_error("shape_mismatch", f"arrays have shapes {sorted(sizes)}")
        own = cls.validate_schema(shape[0], [(n, (codes or {}).get(n, "D")) for n in arrays], **header)
        stack = np.stack([np.asarray(a, np.float64) for a in arrays.values()])
        o, d = np.nonzero((stack != 0).any(axis=0))
        rows = [(int(i) + 1, int(j) + 1, *map(float, stack[:, i, j])) for i, j in zip(o, d)]
        return cls(own, spark.createDataFrame(rows, matfile.wide_schema(own.tables)))

    @classmethod
    def from_parts(cls, header: ODHeader, frame: DataFrame) -> ODMatrix:
        """From a header and a wide relation that has its columns."""
        if frame.columns != [*reshape.KEYS, *header.columns]:
            raise od_error("shape_mismatch", f"columns {frame.columns} for tables {header.columns}")
        return cls(header, frame)

    def into_parts(self) -> tuple[ODHeader, DataFrame]:
        return self.header, self.frame

    # What it is

    @property
    def zone_count(self) -> int:
        return self.header.zone_count

    @property
    def table_count(self) -> int:
        return self.header.table_count

    @property
    def row_count(self) -> int:
        return self.header.row_count

    @property
    def banner(self) -> str:
        return self.header.banner

    @property
    def run_id(self) -> str:
        return self.header.run_id

    @property
    def table_names(self) -> tuple[str, ...]:
        return tuple(self.header.names)

    @property
    def table_defs(self) -> tuple[tuple[str, str], ...]:
        return tuple((t.name, t.code) for t in self.header.tables)

    def catalogue(self) -> DataFrame:
        """(table_index from 1, table, type_code)."""
        rows = [(t.index, t.name, t.code) for t in self.header.tables]
        return self.frame.sparkSession.createDataFrame(rows, "table_index int, table string, type_code string")

    def __len__(self) -> int:
        return self.table_count

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self.header.find(name) is not None

    def __iter__(self) -> Iterator[str]:
        return iter(self.header.names)

    def __getitem__(self, key: str | int) -> DataFrame:
        return self.table(key)

    def keys(self) -> list[str]:
        return self.header.names

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(t.name, self.table(i)) for i, t in enumerate(self.header.tables)]

    def values(self) -> list[DataFrame]:
        return [f for _, f in self.items()]

    # Reading cells

    def table(self, key: str | int) -> DataFrame:
        """(Origin, Destination, value) of a table's pairs, by name or by place from 0."""
        return self.frame.select(*reshape.KEYS, quoted(self.header.table(key).column).alias("value"))

    def select(self, keys: Sequence[str | int]) -> ODMatrix:
        """The chosen tables, in the order asked for."""
        chosen = self.header.select(keys)
        own = replace(self.header, tables=table_infos(chosen))
        return ODMatrix(own, self.frame.select(*reshape.KEYS, *[quoted(t.column).alias(n.column) for t, n in zip(chosen, own.tables)]))

    def _zone(self, *zones: int) -> None:
        for z in zones:
            if isinstance(z, bool) or not isinstance(z, int) or not 1 <= z <= self.zone_count:
                raise od_error("invalid_row_index", f"zone {z!r} of {self.zone_count}")

    def get(self, key: str | int, origin: int, destination: int) -> float:
        self._zone(origin, destination)
        row = self.table(key).where((F.col("Origin") == origin) & (F.col("Destination") == destination)).first()
        return float(row["value"]) if row else 0.0

    def row(self, key: str | int, origin: int) -> DataFrame:
        """(Origin, cells) of one origin, all destinations."""
        self._zone(origin)
        return aggregates.row_vector(self.frame, self.header.table(key), origin, self.zone_count)

    def wide(self, tables: Sequence[str | int] | None = None, **options: object) -> DataFrame:
        return reshape.wide(self.frame, self.header.select(tables), self.zone_count, **options)

    def long(self, tables: Sequence[str | int] | None = None, *, include_zeros: bool | None = None, zero_policy: str = "auto", zone_base: int = 1) -> DataFrame:
        chosen = self.header.select(tables)
        zeros = reshape.include_zeros(zero_policy, len(chosen), self.zone_count, include_zeros)
        return reshape.long(self.frame, chosen, self.zone_count, zeros=zeros, zone_base=zone_base)

    def dense(self) -> DataFrame:
        return reshape.densify(self.frame, self.zone_count)

    def view(self, name: str, include_zeros: bool = False) -> DataFrame:
        """A temporary SQL view of the wide relation."""
        df = self.dense() if include_zeros else reshape.nonzero(self.frame)
        df.createOrReplaceTempView(name)
        return df

    def array(self, key: str | int) -> np.ndarray:
        """A table as a square array on the driver, for small matrices."""
        return self.stack([key])[0]

    def stack(self, keys: Sequence[str | int] | None = None) -> np.ndarray:
        """Tables as one array (table, origin, destination) on the driver."""
        if self.zone_count > MOST_DENSE:
            raise od_error("invalid_zone_count", f"{self.zone_count} zones are too many for an array; {MOST_DENSE} at most")
        chosen = self.header.select(keys)
        got = self.frame.select(*reshape.KEYS, *[quoted(t.column).alias(f"t{i}") for i, t in enumerate(chosen)]).toArrow()
        out = np.zeros((len(chosen), self.zone_count, self.zone_count))
        o, d = (np.asarray(got[c], np.int64) - 1 for c in reshape.KEYS)
        for i in range(len(chosen)):
            out[i, o, d] = np.asarray(got[f"t{i}"])
        return out

    # Aggregates

    def stats(self) -> DataFrame:
        return aggregates.stats(self.frame, self.header.tables)

    def total(self, key: str | int) -> float:
        return float(aggregates.total(self.frame, self.header.table(key)).first()[0])

    def diagonal_total(self, key: str | int) -> float:
        return float(aggregates.diagonal_total(self.frame, self.header.table(key)).first()[0])

    def origin_totals(self, dense: bool = True) -> DataFrame:
        return aggregates.margin(self.frame, self.header.tables, "Origin", self.zone_count if dense else None)

    def destination_totals(self, dense: bool = True) -> DataFrame:
        return aggregates.margin(self.frame, self.header.tables, "Destination", self.zone_count if dense else None)

    def diagonal(self, dense: bool = True) -> DataFrame:
        return aggregates.diagonal(self.frame, self.header.tables, self.zone_count if dense else None)

    def report(self) -> str:
        """Header and totals as lines of text, totals with six decimals."""
        lines = [f"zones {self.zone_count}", f"tables {self.table_count}", f"banner {self.banner}", f"run_id {self.run_id}"]
        lines += [f"{r['table_index']} {r['table']} {r['type_code']} total={r['total']:.6f} diagonal={r['diagonal']:.6f}" for r in self.stats().collect()]
        return "\n".join(lines)

    def report_json(self) -> str:
        number = lambda x: x if math.isfinite(x) else None
        tables = [{"index": r["table_index"], "name": r["table"], "type_code": r["type_code"], "total": number(r["total"]), "diagonal": number(r["diagonal"])} for r in self.stats().collect()]
        return json.dumps({"zone_count": self.zone_count, "table_count": self.table_count, "banner": self.banner, "run_id": self.run_id, "tables": tables})

    # Updates

    def _with(self, frame: DataFrame) -> ODMatrix:
        return ODMatrix(self.header, frame)

    def _column(self, key: str | int) -> str:
        return self.header.table(key).column

    def _changed(self, changes: Mapping[str, Column | Callable[[Column], Column]], dense: bool, where: Column | None = None) -> ODMatrix:
        if dense:
            return self._with(updates.transformed(self.frame, changes, self.zone_count))
        return self._with(updates.changed(self.frame, changes, self.zone_count, where))

    def transform(self, changes: Mapping[str | int, Callable[[Column], Column]], dense: bool = False) -> ODMatrix:
        """Tables changed cell by cell, absent pairs included where their zeros become something else; dense keeps every pair."""
        return self._changed({self._column(k): f for k, f in changes.items()}, dense)

    def mask(self, key: str | int, where: Column, value: Column, dense: bool = False) -> ODMatrix:
        """A table's cells replaced where a condition holds, absent pairs included."""
        column = self._column(key)
        return self._changed({column: F.when(where, value).otherwise(quoted(column))}, dense)

    def clamp(self, key: str | int, low: float = 0.0) -> ODMatrix:
        frame = self.dense() if low > 0 else self.frame
        return self._with(updates.clamped(frame, self._column(key), low))

    def fill(self, key: str | int, value: float) -> ODMatrix:
        return self._with(updates.filled(self.frame, self._column(key), value, self.zone_count))

    def submatrix(self, key: str | int, origins: Sequence[int], destinations: Sequence[int], change: Callable[[Column], Column], dense: bool = False) -> ODMatrix:
        """A block of origins by destinations changed, absent pairs included."""
        self._zone(*origins, *destinations)
        column = self._column(key)
        inside = F.col("Origin").isin(list(origins)) & F.col("Destination").isin(list(destinations))
        return self._changed({column: F.when(inside, change(quoted(column))).otherwise(quoted(column))}, dense, inside)

    def set(self, key: str | int, origin: int, destination: int, value: float) -> ODMatrix:
        self._zone(origin, destination)
        one = self.frame.sparkSession.createDataFrame([(origin, destination, float(value))], "Origin long, Destination long, value double")
        return self._with(updates.points(self.frame, self._column(key), one))

    def points(self, key: str | int, cells: DataFrame) -> ODMatrix:
        return self._with(updates.points(self.frame, self._column(key), cells))

    def scatter_add(self, key: str | int, deltas: DataFrame) -> ODMatrix:
        return self._with(updates.scatter_added(self.frame, self._column(key), deltas))

    def replace_table(self, key: str | int, cells: DataFrame | np.ndarray) -> ODMatrix:
        """A whole table from (Origin, Destination, value) or from a square array."""
        if isinstance(cells, np.ndarray):
            if cells.shape != (self.zone_count, self.zone_count):
                raise od_error("shape_mismatch", f"{cells.shape} for {self.zone_count} zones")
            o, d = np.nonzero(cells)
            rows = [(int(i) + 1, int(j) + 1, float(cells[i, j])) for i, j in zip(o, d)]
            cells = self.frame.sparkSession.createDataFrame(rows, "Origin long, Destination long, value double")
        return self._with(updates.replaced(self.frame, self._column(key), cells))

    def set_stack(self, cells: DataFrame | np.ndarray) -> ODMatrix:
        """All tables at once, from a wide relation with their columns or from an array (table, origin, destination)."""
        if isinstance(cells, np.ndarray):
            if cells.shape != (self.table_count, self.zone_count, self.zone_count):
                raise od_error("shape_mismatch", f"{cells.shape} for {self.table_count} tables of {self.zone_count} zones")
            o, d = np.nonzero((cells != 0).any(axis=0))
            rows = [(int(i) + 1, int(j) + 1, *map(float, cells[:, i, j])) for i, j in zip(o, d)]
            return self._with(self.frame.sparkSession.createDataFrame(rows, matfile.wide_schema(self.header.tables)))
        return ODMatrix.from_parts(self.header, cells)

    def align(self, other: ODMatrix, rename: Mapping[str, str] | None = None) -> ODMatrix:
        """Both matrices' tables in one, by pair; rename is for tables of the other that this one has too."""
        if other.zone_count != self.zone_count:
            raise od_error("zone_count_mismatch", f"{other.zone_count} zones beside {self.zone_count}")
        new = [(rename or {}).get(t.name, t.name) for t in other.header.tables]
        tables = table_infos([*self.header.tables, *zip(new, (t.code for t in other.header.tables))])
        right = other.frame.toDF(*reshape.KEYS, *new)
        return ODMatrix(replace(self.header, tables=tables), reshape.aligned(self.frame, right))

    def reindex_zones(self, keep: Sequence[int], basis: str = "zone") -> ODMatrix:
        return ODMatrix(replace(self.header, zone_count=len(list(keep))), reshape.reindexed(self.frame, keep, self.zone_count, basis))

    def quantise(self) -> ODMatrix:
        """Cells as a file of this matrix would hold them."""
        return self._with(self.frame.select(*reshape.KEYS, *[quantised(quoted(t.column), t.code).alias(t.column) for t in self.header.tables]))

    # Writing

    def write(self, path: str, partitions: int | None = None) -> None:
        """A matrix file at a local or mounted path that executors share: origins are encoded in parallel."""
        self.header.checked()
        matfile.register(self.frame.sparkSession)
        parts = partitions or max(1, min(self.zone_count, math.ceil(self.zone_count * self.zone_count * self.table_count / matfile.TASK)))
        df = self.frame.toDF(*reshape.KEYS, *[f"c{i}" for i in range(self.table_count)]).repartitionByRange(parts, "Origin")
        # Tables travel under plain names, so that equal and odd ones reach the header as they are.
        names = json.dumps([[t.name, t.code] for t in self.header.tables])
        df.write.format("odmat").mode("append").options(path=path, zone_count=str(self.zone_count), tables_written=names, banner=self.banner, run_id=self.run_id).save()

    def to_bytes(self) -> bytes:
        """The matrix file's bytes on the driver: origins are encoded in tasks and come one partition at a time, in order."""
        self.header.checked()
        df = self.frame.toDF(*reshape.KEYS, *[f"c{i}" for i in range(self.table_count)])
        parts = max(1, math.ceil(self.zone_count * self.zone_count * self.table_count / matfile.TASK))
        encoded = matfile.encoded_origins(df.repartitionByRange(parts, "Origin"), self.header)
        out, zero, done = [self.header.to_bytes()], matfile.zero_rows(self.header), 0
        for r in encoded.orderBy("origin").toLocalIterator():
            out += [zero(o) for o in range(done + 1, r["origin"])] + [bytes(r["rows"])]
            done = r["origin"]
        return b"".join(out + [zero(o) for o in range(done + 1, self.zone_count + 1)])

    def to_csv(self, path: str, tables: Sequence[str | int] | None = None, *, sep: str = ",", encoding: str = "utf-8", quotechar: str = '"', integral: bool = False, one_file: bool = False, **options: object) -> None:
        """The wide export as a folder of CSV files in order, or as one file at the path."""
        tabular.to_csv(self.wide(tables, **options), path, sep=sep, encoding=encoding, quotechar=quotechar, integral=integral, one_file=one_file)

    def to_parquet(self, path: str, tables: Sequence[str | int] | None = None, *, compression: str = "snappy", one_file: bool = False, parquet_engine: str = "auto", **options: object) -> None:
        tabular.to_parquet(self.wide(tables, **options), path, compression=compression, one_file=one_file, engine=parquet_engine)

    def to_csv_long(self, path: str, *, one_file: bool = False, **options: object) -> None:
        tabular.to_csv(self.long(**options), path, one_file=one_file)

    def to_parquet_long(self, path: str, *, one_file: bool = False, parquet_engine: str = "auto", **options: object) -> None:
        tabular.to_parquet(self.long(**options), path, one_file=one_file, engine=parquet_engine)

    def to_pandas(self, tables: Sequence[str | int] | None = None, **options: object):
        return self.wide(tables, **options).toPandas()

    def to_polars(self, tables: Sequence[str | int] | None = None, **options: object):
        """The wide relation as a polars frame, where polars is installed."""
        import polars

        return polars.from_arrow(self.wide(tables, **options).toArrow())

    def to_long_pandas(self, **options: object):
        return self.long(**options).toPandas()


def info(spark: SparkSession, path: str) -> DataFrame:
    """(zone_count, table_count, banner, run_id, table_index, table, type_code), from the header alone."""
    header, _ = matfile.read(spark, path)
    rows = [(header.zone_count, header.table_count, header.banner, header.run_id, t.index, t.name, t.code) for t in header.tables]
    return spark.createDataFrame(rows, T.StructType.fromDDL("zone_count int, table_count int, banner string, run_id string, table_index int, table string, type_code string"))
