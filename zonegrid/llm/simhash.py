"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most two bits
have a segment that differs in at most one, so they agree on that segment with one bit left out:
each distinct fingerprint is indexed under its 64 one-wildcard segments, equal signatures are
joined and the pairs verified. A wildcard leaves the other half of its segment whole, so fingerprints
are dealt out four times, by each 16-bit half, and a task makes and joins the 16 signatures that
agree there: 4 rows move for a fingerprint and not 64. Only where very many share a half are their
signatures dealt out one by one. A signature that very many fingerprints share (a family of close
copies, or an adversary) is not paired off: its members are indexed once under their 2016
two-wildcard fingerprints, where an equal key alone proves a link, and each key links its members
to its smallest one. So no link is lost, and work stays in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import CROWDED, SALTS, components, cut_lineage, join_crowded, raw_texts, spare_name, text_udf, union_all

SEED = 42
#: Signatures shared by more fingerprints than this link through two-wildcard keys; pairs would cost more.
PAIRED = 128
#: Rows (a fingerprint by a half) whose signatures a task joins, as far as the session's partitions go, and the mean at most.
JOINED, MOST = 50_000, 1_000_000
#: Rows that a task turns into signatures to be dealt out, 16 of each.
SIGNED = 100_000
_LOW = 0xFFFFFFFF
#: One byte to eight one-byte lanes of its bits: at most 255 of these add up without overflow.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_AT_ONCE = 60_000


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of consecutive runs of hashes; no run is empty."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    pieces = -(-sizes // 255)
    run = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    counts = np.add.reduceat(lanes, starts[run] + 255 * nth, axis=0).view(np.uint8).reshape(-1, 64)
    totals = np.add.reduceat(counts.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(2 * totals > sizes[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def _fingerprints(texts: pa.Array) -> pa.Array:
    data, offsets = raw_texts(texts)
    view, xxh = memoryview(data), xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.int64)
    rows, sizes, hashes = [], [], []

    def flush() -> None:
        if rows:
            out[rows] = _majority(np.array(hashes, np.uint64), np.array(sizes))
            rows.clear(), sizes.clear(), hashes.clear()

    for i in range(len(texts)):
        words = bytes(view[offsets[i] : offsets[i + 1]]).lower().split()
        if len(words) > 2:
            hashes.extend([xxh(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])])
            sizes.append(len(words) - 2)
        elif words:
            hashes.append(xxh(b" ".join(words), SEED))
            sizes.append(1)
        else:
            continue
        rows.append(i)
        if len(hashes) >= _AT_ONCE:
            flush()
    flush()
    return pa.array(out)


def fingerprint(text: Column) -> Column:
    """SimHash of a text's 3-word shingles (repeats included) as a signed long; zero for null or no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, fewer than three words are
    one shingle; a bit is set if over half of the shingles' XXH64 (seed 42) have it.
    """
    return text_udf(_fingerprints, T.LongType())(text)


def _halved(fps: DataFrame) -> DataFrame:
    """(fp, part) by each 16-bit half of fp: part is the half's place (0 is lowest) above its bits."""
    parts = [F.shiftrightunsigned("fp", 16 * h).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(h << 16)).cast("int") for h in range(4)]
    return fps.select("fp", F.explode(F.array(*parts)).alias("part"))


def _signatures(halved: DataFrame) -> DataFrame:
    """(fp, key): fp's segment around the half, with one bit of the segment's other half left out."""
    place = F.shiftright("part", 16)
    segment = F.when(place < 2, F.col("fp").bitwiseAND(F.lit(_LOW))).otherwise(F.shiftrightunsigned("fp", 32))

    def keys(h: int) -> Column:
        return F.array(*[segment.bitwiseAND(F.lit(_LOW & ~(1 << v % 32))).bitwiseOR(F.lit(v << 32)) for v in _wild(h)])

    return halved.select("fp", F.explode(F.when(place == 0, keys(0)).when(place == 1, keys(1)).when(place == 2, keys(2)).otherwise(keys(3))).alias("key"))


def _wild(h: int) -> range:
    """The bits that signatures with a whole half h leave out: those of the segment's other half."""
    return range(16 * (h ^ 1), 16 * (h ^ 1) + 16)


def _matched(batches: Iterable[pa.RecordBatch], paired: int) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) among halved rows that agree in a signature, a < b; (a, a) for each member of one that more than `paired` share.

    A pair comes from the signature that leaves out the bit in which its segments differ, or else the segment's first.
    """
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    fps, place = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy() >> 16
    for h in range(4):
        own = fps[place == h]
        segment = (own >> np.uint64(32 * (h // 2))).astype(np.uint32)
        for v in _wild(h):
            keys = segment & np.uint32(_LOW & ~(1 << v % 32))
            order = np.argsort(keys)
            keys = keys[order]
            firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.append(firsts, len(keys)))
            shared = np.repeat(sizes, sizes)
            many = own[order[shared > paired]]
            found = [(many, many)]
            some = (shared > 1) & (shared <= paired)
            keys, members = keys[some], own[order[some]]
            left, step = np.arange(len(keys)), 0
            while len(left):
                step += 1
                left = left[left + step < len(keys)]
                left = left[keys[left] == keys[left + step]]
                x, y = members[left], members[left + step]
                differ = x ^ y
                within = differ >> np.uint64(32 * (h // 2)) & np.uint64(_LOW)
                near = (np.bitwise_count(differ) <= 2) & ((within != 0) | (v % 32 == 0))
                x, y = x[near].view(np.int64), y[near].view(np.int64)
                found.append((np.minimum(x, y), np.maximum(x, y)))
            a, b = (np.concatenate([f[i].view(np.int64) for f in found]) for i in range(2))
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b) fingerprints that differ in one or two bits, enough of them to join all that such steps join.

    fps has distinct longs fp. Signatures of at most `paired` fingerprints give all their pairs.
    """
    halved, total = _halved(fps), fps.count()
    shared = halved.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > paired) & (F.col("n") * CROWDED > F.lit(total)))
    crowded = [r["part"] for r in shared.collect()]  # under CROWDED of each place
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-4 * total // JOINED), partitions), -(-4 * total // MOST))
    rest = halved.where(~F.col("part").isin(crowded)) if crowded else halved
    found = cut_lineage(rest.repartition(tasks, "part").mapInArrow(lambda batches: _matched(batches, paired), "a long, b long"))
    pairs, many = [found.where("a <> b")], [found.where("a = b").select(F.col("a").alias("fp"))]
    if crowded:
        few, most = _dealt(halved.where(F.col("part").isin(crowded)), paired, partitions)
        pairs, many = [*pairs, few], [*many, most]
    masks = F.array(*[F.lit(_signed((1 << 64) - 1 & ~(1 << i | 1 << j))) for i, j in combinations(range(64), 2)])
    wild = union_all(many).distinct().select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    hubs = wild.groupBy("k", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = wild.join(hubs, ["k", "rest"]).select(F.col("fp").alias("a"), "b").where("a <> b")
    return union_all([*pairs, stars]).distinct()


def _dealt(halved: DataFrame, paired: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs (a, b) and fingerprints (fp) of signatures that more than `paired` share, for halves too crowded for a task."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    halved = cut_lineage(halved)
    tasks = min(-(-halved.count() // SIGNED), partitions)
    halved = halved.repartition(max(1, tasks), "fp", "part")  # a few small partitions would be few large tasks, 16 times as large
    buckets = cut_lineage(_signatures(halved).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    two = buckets.where("n = 2").select("a", "b").where(near)
    members = _signatures(halved).join(buckets.where("n > 2").select("key", "n"), "key")
    members = cut_lineage(members)
    few = members.where(F.col("n") <= paired).select("key", F.col("fp").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b").where(near)
    return two.unionByName(pairs), members.where(F.col("n") > paired).select("fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    component_id is the smallest doc_id that steps of at most two differing bits reach, the row's own
    included. Null and empty texts have fingerprint zero, which links like any other; null ids take
    part but never name a component (it is null where all its ids are). Repeated rows stay.
    """
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    found = cut_lineage(classes(rows))
    total = found.agg(F.sum("n")).first()[0] or 0
    return join_crowded(rows, found, ["fp"], "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _salt() -> Column:
    """So that what many tasks have found of one fingerprint does not meet in one task at once."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))


def classes(rows: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of each distinct fingerprint of rows (doc_id, fp); n rows have it."""
    parts = rows.groupBy("fp", _salt().alias("salt")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    fps = cut_lineage(parts.groupBy("fp").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n")))
    roots = cut_lineage(components(links(fps.select("fp"))))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    linked = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("linked_id")), "root").select("fp", "root", "linked_id")
    return fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("linked_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class of near-duplicates: the one of the smallest doc_id, nulls last.

    Among rows of that id the smallest hash of the text stays, and one of rows that are equal in both.
    All columns stay. Texts move once, by (id, hash), against the small table of what stays.
    """
    own = spare_name(docs, "text_hash")
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = cut_lineage(hashed.select(F.col(doc_id).alias("doc_id"), F.col(own).alias("h"), fingerprint(F.col(text)).alias("fp")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("best")
    best = rows.groupBy("fp", _salt().alias("salt")).agg(least).groupBy("fp").agg(F.min("best").alias("best"))
    stay = best.join(classes(rows), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.h")
    stay = cut_lineage(stay)
    copies = rows.groupBy("doc_id", "h").count().where("count > 1").withColumnsRenamed({"doc_id": "i", "h": "g"})
    repeated = cut_lineage(stay.join(copies, stay.doc_id.eqNullSafe(copies.i) & (stay.h == copies.g), "left_semi"))
    same = hashed[doc_id].eqNullSafe(stay.doc_id) & (hashed[own] == stay.h)
    if repeated.isEmpty():
        return hashed.join(stay, same, "left_semi").drop(own)
    again = hashed[doc_id].eqNullSafe(repeated.doc_id) & (hashed[own] == repeated.h)
    once = hashed.join(repeated, again, "left_semi").dropDuplicates([doc_id, own])
    rest = stay.join(repeated, stay.doc_id.eqNullSafe(repeated.doc_id) & (stay.h == repeated.h), "left_anti")
    same = hashed[doc_id].eqNullSafe(rest.doc_id) & (hashed[own] == rest.h)
    return hashed.join(rest, same, "left_semi").unionByName(once).drop(own)
