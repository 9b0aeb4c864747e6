"""What the operators share: table access, label folds, lineage cuts, Arrow text buffers, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space, in Java's and DuckDB's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Ways in which the rows of a crowded key are split.
SALTS = 32
#: Keys that are crowded, at most: those with more than one CROWDED-th of all rows.
CROWDED = 1_000
#: Edges whose components a task finds by itself.
HELD = 100_000
#: Bytes of a batch that goes to Python, and the setting that bounds it, with its default.
BATCH, _BATCHES, _WIDE = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder and read back, so a lost executor can't undo it.

    On a local master without spark.checkpoint.dir, as in tests, a temporary folder takes its place; a
    cluster without it is an error, as executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that its executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def text_udf(run: Callable[..., pa.Array], kind: T.DataType) -> Callable[..., Column]:
    """An Arrow UDF whose batches hold about BATCH bytes: an executor's JVM and its Python workers each hold some at once.

    The bound is a setting of the session and stays; one that the session has set itself is left alone.
    """
    spark = SparkSession.active()
    if int(re.sub(r"\D", "", spark.conf.get(_BATCHES) or "0")) == _WIDE:
        spark.conf.set(_BATCHES, str(BATCH))
    return F.arrow_udf(run, kind)


def join_small(rows: DataFrame, small: DataFrame, by: list[str], most: int, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table that is small as a rule, without dealing rows out by a key that may be crowded.

    small (written already) is counted: up to `most` rows are broadcast. A larger one is copied to SALTS
    salts, and rows are dealt out by key and by a hash of `spread`.
    """
    if small.count() <= most:
        return rows.join(F.broadcast(small), by, how)
    salt = spare_name(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied, [*by, salt], how).drop(salt)


def join_crowded(rows: DataFrame, keyed: DataFrame, by: list[str], count: str, total: int) -> DataFrame:
    """rows inner-joined with keyed (written already; one row a key), whose column `count` tells how many rows a key has.

    Keys with more than a CROWDED-th of `total` rows, CROWDED of them at most, are broadcast; every other key
    has so few rows that dealing them out by key crowds no task.
    """
    crowded = F.col(count) * CROWDED > F.lit(total)
    few = F.broadcast(keyed.where(crowded))
    rest = rows.join(F.broadcast(keyed.where(crowded).select(*by)), by, "left_anti").join(keyed.where(~crowded), by)
    return rows.join(few, by).unionByName(rest)


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A batch's UTF-8 bytes in one array, and the n+1 offsets of its texts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums_by_text(values: np.ndarray, starts: np.ndarray, first: int, into: np.ndarray) -> None:
    """Adds values of the positions first, first+1, ... to the rows of the texts they lie in."""
    last = first + len(values)
    lo, hi = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, last, "left")
    cuts = np.maximum(starts[lo:hi], first) - first
    rows = np.arange(lo, hi)
    full = np.diff(np.append(cuts, len(values))) > 0  # empty texts share their start with the next one
    if full.any():
        into[rows[full]] += np.add.reduceat(values, cuts[full], axis=0)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from every node of a task's edges to the least node that they reach."""
    least: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := least.setdefault(root, root)) != root:
            root = up
        while x != root:
            least[x], x = root, least[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = find(a), find(b)
            least[max(a, b)] = min(a, b)
    pairs = [(x, root) for x in least if (root := find(x)) != x]
    for i in range(0, len(pairs), 1 << 16):
        a, b = zip(*pairs[i : i + (1 << 16)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, root) for every node of edges (a, b), longs: root is the smallest node that can be reached.

    Tasks of about `held` edges first join what their own edges connect; one such task is all that few edges
    need, so the driver has a handful of stages to plan and not dozens. What several tasks leave is joined by
    alternating large-star and small-star until nothing changes; each round is a map-side combined
    minimum and an equi-join, so a node with very many edges meets no single task, and each round's
    edges go to the checkpoint folder. Self-loops and repeated edges are allowed; no edges give no rows.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    tasks = -(-e.count() // held)
    e = cut_lineage(e.coalesce(max(1, tasks)).mapInArrow(_joined, "a long, b long"))
    last = mark(e) if tasks > 1 else (0, None)
    while last[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sampled(df: DataFrame, group: str, most: int, key: Column, size: Column | None = None, budget: int | None = None, overall: int | None = None, least: int = 1) -> tuple[DataFrame, dict]:
    """About `most` rows of each group of df by hash of the key, and each group's count.

    Groups of up to `most` rows come whole, but for those whose sizes exceed `budget`: of them about the
    budget comes. With `overall`, groups share about so many rows, but have `least` in any case.
    Null groups take no part; the groups themselves come to the driver.
    """
    df = df.where(F.col(group).isNotNull())
    totals = {r[0]: (r[1], r[2] or 0) for r in df.groupBy(group).agg(F.count(F.lit(1)), F.sum(size if size is not None else F.lit(0))).collect()}
    if overall is not None:
        most = min(most, max(least, overall // max(1, len(totals))))
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = {g: min(1.0, most / n, budget / held if budget and held else 1.0) for g, (n, held) in totals.items()}
    some = [g for g, share in shares.items() if share < 1.0]
    if some:
        pairs = F.create_map(*[F.lit(x) for g in some for x in (g, shares[g])])
        df = df.where(unit < F.coalesce(F.try_element_at(pairs, F.col(group)), F.lit(1.0)))
    return df, {g: n for g, (n, _) in totals.items()}


def labelled(docs: DataFrame, known: DataFrame, label: str, most: int, budget: int) -> tuple[pa.Table, dict]:
    """Rows of docs (doc_id, text, ...) for about `most` ids of either label of known (doc_id, label), and the labels' counts.

    An id that many rows of docs have gives one of them, by hash of the text. Texts are whole; null ones
    are empty, one that is beyond the budget of bytes by itself can't be held, and where all of them are
    beyond it, fewer rows are taken, by hash again.
    """
    ids, counts = sampled(known, label, most, F.col("doc_id"))  # at most about 2 * most ids
    own = docs.withColumn("text", F.coalesce("text", F.lit(""))).where(F.octet_length("text") <= budget)
    others = [c for c in docs.columns if c != "doc_id"]
    one = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), *others)).alias("row"))
    rows = cut_lineage(one.select("doc_id", label, *[f"row.{c}" for c in others]))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > budget:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("budget"), "doc_id"), F.lit(1 << 30)) < F.lit(int(budget / held * (1 << 30))))
    return on_driver(rows), counts


def platt(z: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) the chance of label 1, by Newton's method on Platt's smoothed labels."""
    high, low = ((w * t).sum() + 1) / ((w * t).sum() + 2), 1 / ((w * (1 - t)).sum() + 2)
    goal = np.where(t > 0, high, low)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h, e = w * p * (1 - p) + 1e-9, w * (p - goal)
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(e * z).sum() + 1e-3 * (a - 1), e.sum()])
        a, b = max(a - np.clip(step[0], -1, 1), 0.05), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def on_driver(sample: DataFrame) -> pa.Table:
    """A bounded sample's rows, in an order that is the same in every run."""
    got = sample.toArrow()
    return got.sort_by([(c, "ascending") for c in ("doc_id", "text")])
