"""CSV and Parquet in and out, by Spark's own readers and writers."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonegrid.capabilities import parquet_engine
from zonegrid.errors import od_error
from zonegrid.functions.cells import plain_text, quoted
from zonegrid.header import ODHeader
from zonegrid.operators.ingest import IngestOptions, ingest

COMPRESSIONS = ("snappy", "zstd", "none")


def _separator(sep: str) -> str:
    sep = "\t" if sep == "tab" else sep
    if len(sep) != 1:
        raise od_error("invalid_od", f"a separator is one character or tab, not {sep!r}")
    return sep


def from_csv(spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), *, sep: str = ",", encoding: str = "utf-8", quotechar: str = '"') -> tuple[ODHeader, DataFrame]:
    """A matrix from CSV with a header line. All columns are read as text and checked by ingest().

    For on_duplicate_od="last" without an ordinal, lines are ordered by file, place of the split in it and line.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("sep", _separator(sep)).option("quote", quotechar).option("escape", quotechar).option("encoding", encoding).option("inferSchema", False)
    df = reader.csv(path)
    if options.on_duplicate_od == "last" and options.ordinal is None:
        df, options = df.withColumn("_line", in_file_order()), replace(options, ordinal="_line")
    return ingest(df, options)


def in_file_order() -> Column:
    """What orders rows as their files hold them, by file name; Spark may read files and their parts in any order."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))


def from_parquet(spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), *, columns: Sequence[str] | None = None, engine: str = "auto") -> tuple[ODHeader, DataFrame]:
    """A matrix from Parquet; columns are pruned in the scan. The last of duplicates, without an ordinal, is by file and row."""
    parquet_engine(engine)
    df = spark.read.parquet(path)
    if options.on_duplicate_od == "last" and options.ordinal is None:
        df, options = df.withColumn("_line", F.struct("_metadata.file_path", "_metadata.row_index")), replace(options, ordinal="_line")
    wanted = columns if columns is not None else options.table_columns
    if wanted is not None and options.drop_extra_columns:
        keys = [options.origin_col, options.destination_col, *([options.ordinal] if options.ordinal else [])]
        df = df.select(*[quoted(c) for c in dict.fromkeys([*keys, *wanted]) if c in df.columns])
    return ingest(df, options)


#: Encodings whose texts may be put together as bytes.
_JOINABLE = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "latin1")


def _as_one(spark: SparkSession, folder: str, path: str, head: bytes = b"") -> None:
    """Puts a folder's part files together, in their order, behind head, as one file at path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    parts = sorted(str(f.getPath()) for f in fs.listStatus(at(folder)) if f.getPath().getName().startswith("part-"))
    if fs.exists(at(path)):
        fs.delete(at(path), True)
    if len(parts) == 1 and not head:
        fs.rename(at(parts[0]), at(path))
    else:
        out = fs.create(at(path), True)
        out.write(bytearray(head))
        for part in parts:
            source = fs.open(at(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.close()
    fs.delete(at(folder), True)


def to_csv(wide: DataFrame, path: str, *, sep: str = ",", encoding: str = "utf-8", quotechar: str = '"', integral: bool = False, one_file: bool = False, names: Sequence[str] | None = None) -> None:
    """The relation as a folder of CSV files at path, in order of their names, or as one file there.

    Rows are computed and written in parallel; for one file the parts are put together afterwards.
    integral prints 2.0 as 2 and large values without exponent; names are for the header line of one file,
    and may repeat.
    """
    if integral:
        wide = wide.select(*wide.columns[:2], *[plain_text(quoted(c)).alias(c) for c in wide.columns[2:]])
    joinable = encoding.lower() in _JOINABLE
    df = wide.coalesce(1) if one_file and not joinable else wide
    writer = df.write.mode("overwrite").option("sep", _separator(sep)).option("quote", quotechar).option("escape", quotechar).option("encoding", encoding)
    if not one_file:
        writer.option("header", True).csv(path)
        return
    folder, line = f"{path}.parts", io.StringIO()
    csv.writer(line, delimiter=_separator(sep), quotechar=quotechar, lineterminator="\n").writerow(names or wide.columns)
    writer.option("header", not joinable).csv(folder)
    _as_one(wide.sparkSession, folder, path, line.getvalue().encode(encoding) if joinable else b"")


def to_parquet(wide: DataFrame, path: str, *, compression: str = "snappy", one_file: bool = False, engine: str = "auto") -> None:
    """The relation as a folder of Parquet files at path, or as one file there, which one task copies from the parts."""
    parquet_engine(engine)
    if compression not in COMPRESSIONS:
        raise od_error("invalid_od", f"compression is one of {', '.join(COMPRESSIONS)}, not {compression!r}")
    folder = f"{path}.parts" if one_file else path
    wide.write.mode("overwrite").option("compression", compression).parquet(folder)
    if one_file:
        spark = wide.sparkSession
        whole = spark.read.schema(wide.schema).parquet(folder).orderBy(*wide.columns[:2]) if wide.columns else wide
        whole.coalesce(1).write.mode("overwrite").option("compression", compression).parquet(f"{path}.one")
        _as_one(spark, f"{path}.one", path)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
