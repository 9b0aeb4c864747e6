"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner products become distances by one more component that brings every vector to the largest norm.
Centroids come from balanced two-means splits of a bounded sample, so lists are of even size; their
number grows with the square root of the table. A vector goes to the list of its nearest centroid.
Vectors near a boundary (the BOUNDARY share of them whose nearest centroids are most nearly equally
far) go to the next lists too. Centroids are searched on their neighbour graph: a beam of fixed width
finds a query's nearest centroid, and from there the search opens the centroids not farther than a
ratio of that distance, and no others. Their lists are scored in full, in double precision.

The ratio is the least at which the lists of a sample of the table's own queries hold the wanted share
of their true neighbours, which are found by scoring every vector; how many lists that takes has no
bound. Clustered vectors need few lists; vectors that fill the sphere evenly need most of them at any size.

Equal vectors are indexed once and expanded at the end. Neighbouring lists form blocks of bounded size,
and longer lists several blocks. A block's vectors move once, are held, and its queries stream past them,
so memory is bounded by the block, and a popular block is split by queries beyond QUERIES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonegrid.llm.common import cut_lineage, join_crowded, join_small

#: Lists per square root of the vectors, most centroids (some 700 bytes each at 64 components), sampled vectors a centroid.
SCALE, CENTROIDS, SAMPLE = 4.0, 65_536, 16
#: Share of vectors that count as near a boundary, and lists that such a vector may go to.
BOUNDARY, COPIES = 0.25, 3
#: Share of true neighbours that the lists of about SAMPLED of the table's queries must hold.
RECALL, SAMPLED = 0.94, 256
#: Neighbours of a centroid in the graph (and of those that it is a neighbour of), centroids opened at a time, width of the beam.
DEGREE, BACK, OPENED, BEAM = 24, 16, 8, 32
#: Most and fewest vectors of a block, blocks for each core, and queries that stream past one copy of a block.
BLOCK, LEAST, SPREAD, QUERIES = 16_384, 128, 4, 65_536
_AT_ONCE, _ASKED, _PAIRS, _GAPS = 512, 256, 32_768, 4_096


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def centroids(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of `lists` parts of even size, by repeated two-means splits at the median."""
    g = np.random.default_rng(seed)
    out, todo = [], [(sample, lists)]
    while todo:
        x, n = todo.pop()
        if n <= 1 or len(x) < 2:
            if len(x):
                out.append(x.mean(0))
            continue
        a, b = x[g.choice(len(x), 2, replace=False)]
        left = n // 2
        for _ in range(8):
            side = x @ (b - a)
            cut = np.argsort(side, kind="stable")
            at = len(x) * left // n
            a, b = x[cut[:at]].mean(0) if at else a, x[cut[at:]].mean(0)
        todo += [(x[cut[:at]], left), (x[cut[at:]], n - left)]
    return np.array(out)


def _neighbours(points: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest others, nearest first, and their squared distances."""
    near, far = np.zeros((len(points), many), np.int64), np.zeros((len(points), many))
    for i in range(0, len(points) if many else 0, 256):
        d = _squared(points[i : i + 256], points)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = -1.0
        some = np.argpartition(d, many, axis=1)[:, : many + 1]
        d = np.take_along_axis(d, some, 1)
        order = np.argsort(d, axis=1, kind="stable")[:, 1:]
        near[i : i + 256], far[i : i + 256] = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
    return near, far


def _reversed(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each point the BACK nearest of those that have it as a neighbour; itself where there are fewer."""
    n, many = near.shape
    out = np.repeat(np.arange(n)[:, None], BACK, axis=1)
    order = np.lexsort((far.ravel(), near.ravel()))
    target, source = near.ravel()[order], np.repeat(np.arange(n), many)[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    kept = place < BACK
    out[target[kept], place[kept]] = source[kept]
    return out


class Graph:
    """Centroids with each one's nearest neighbours and a few random ones, searched by beam."""

    def __init__(self, points: np.ndarray, seed: int = 5) -> None:
        self.points, self.rough = points, points.astype(np.float32)  # the beam finds its way by the latter
        n = len(points)
        g = np.random.default_rng(seed)
        near, far = _neighbours(points, min(DEGREE, n - 1))
        self.links = np.concatenate([near, _reversed(near, far), g.integers(0, n, (n, 4))], axis=1).astype(np.int32)
        self.entries = np.unique(np.concatenate([g.integers(0, n, min(n, 31)), [_squared(points, points.mean(0)[None])[:, 0].argmin()]]))

    def nearest(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to `want` (BEAM at most) centroids near each row of x, nearest first, and their distances (infinite where there are fewer)."""
        n, rows, width = len(self.points), np.arange(len(x))[:, None], min(BEAM, len(self.points))
        norms, own, rough = (self.points**2).sum(1), (x**2).sum(1)[:, None], x.astype(np.float32)
        start = self.entries[:width]
        beam, far = np.full((len(x), width), n), np.full((len(x), width), np.inf)
        beam[:, : len(start)], far[:, : len(start)] = start, _squared(x, self.points[start])
        seen, opened = np.zeros((len(x), n + 1), bool), np.zeros((len(x), n + 1), bool)
        seen[:, start] = seen[:, n] = opened[:, n] = True
        live = np.arange(len(x))
        while len(live):
            order = np.argsort(far[live], axis=1, kind="stable")
            beam[live], far[live] = np.take_along_axis(beam[live], order, 1), np.take_along_axis(far[live], order, 1)
            closed = opened[live[:, None], beam[live]]
            live = live[~closed.all(1)]
            if not len(live):
                break
            at = np.argsort(opened[live[:, None], beam[live]], axis=1, kind="stable")[:, :OPENED]  # the nearest unopened
            node = beam[live[:, None], at]
            node = np.where(opened[live[:, None], node], n, node)
            opened[live[:, None], node] = True
            around = np.concatenate([self.links, np.full((1, self.links.shape[1]), n)])[node].reshape(len(live), -1)
            around = np.where(seen[live[:, None], around], n, around)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            seen[live[:, None], around] = True
            near = np.minimum(around, n - 1)
            if around.shape[1] * 4 > n:
                inner = np.take_along_axis(rough[live] @ self.rough.T, near, 1)
            else:
                inner = np.matmul(self.rough[near], rough[live][:, :, None])[:, :, 0]
            d = np.where(around == n, np.inf, np.maximum(own[live] + norms[near] - 2 * inner, 0))
            both, dist = np.concatenate([beam[live], around], 1), np.concatenate([far[live], d], 1)
            keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
            beam[live], far[live] = np.take_along_axis(both, keep, 1), np.take_along_axis(dist, keep, 1)
        order = np.argsort(far, axis=1, kind="stable")[:, :want]
        return beam[rows, order], np.sqrt(far[rows, order])

    def within(self, x: np.ndarray, ratio: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid): the centroids found not farther than ratio times the nearest one's distance, which counts as `least` or more."""
        n = len(self.points)
        near, far = self.nearest(x, BEAM)
        reach = ratio * np.maximum(far[:, :1], least)
        norms, own = (self.points**2).sum(1), (x**2).sum(1)
        d = np.full((len(x), n + 1), np.inf)
        np.put_along_axis(d, near, far, 1)
        d = d[:, :n]
        seen, opened = np.isfinite(d), np.zeros((len(x), n), bool)
        while True:
            row, node = np.nonzero((d <= reach) & ~opened)
            if not len(row):
                break
            opened[row, node] = True
            fresh = np.zeros((len(x), n), bool)
            fresh[row[:, None], self.links[node]] = True
            fresh &= ~seen
            row, node = np.nonzero(fresh)
            seen |= fresh
            if 8 * len(row) > fresh.size:
                inner = (x @ self.points.T)[row, node]
            else:
                inner = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[row[j : j + _PAIRS]], self.points[node[j : j + _PAIRS]]) for j in range(0, len(row), _PAIRS))])
            d[row, node] = np.sqrt(np.maximum(own[row] + norms[node] - 2 * inner, 0))
        return np.nonzero(d <= reach)


class Index:
    """What assigns vectors and queries to lists, and lists to blocks."""

    def __init__(self, sample: np.ndarray, lists: int, norm: float) -> None:
        self.norm = norm
        x = self.lifted(sample)
        self.graph = Graph(centroids(x, lists))
        _, far = self.graph.nearest(x[:: -(-len(x) // _GAPS)], 2)
        gap = far[:, 1] / np.maximum(far[:, 0], 1e-12 * max(norm, 1e-300)) if far.shape[1] > 1 else np.full(len(far), np.inf)
        self.closure = float(np.quantile(gap, BOUNDARY)) if np.isfinite(gap).all() else 1.0
        self.ratio = 1.0
        self.first, self.parts = np.zeros(len(self.graph.points), np.int64), np.ones(len(self.graph.points), np.int64)
        self.sizes, self.wanted = np.ones(len(self.graph.points), np.int64), 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))[:, None]], 1)

    def lists_of_vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list and, near a boundary, the next ones."""
        near, far = self.graph.nearest(self.lifted(x), COPIES)
        looks = (far <= self.closure * far[:, :1]) & np.isfinite(far)
        looks[:, 0] = True
        row, at = np.nonzero(looks)
        return row, near[row, at]

    def _asking(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x**2).sum(1, keepdims=True))
        return np.concatenate([x / size * self.norm, np.zeros((len(x), 1))], 1)

    def lists_of_queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that a query looks at; beyond the ratio where those hold too few vectors to choose from."""
        row, near = self.graph.within(self._asking(x), self.ratio, 1e-9 * self.norm)
        held = np.bincount(row, self.sizes[near], len(x))
        few = np.flatnonzero(held < min(self.wanted, self.sizes.sum()))
        if not len(few):
            return row, near
        order = np.argsort(_squared(self._asking(x[few]), self.graph.points), axis=1, kind="stable")
        ahead = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        more, at = np.nonzero(ahead < self.wanted)
        both = np.unique(np.concatenate([np.stack([row, near], 1), np.stack([few[more], order[more, at]], 1)]), axis=0)
        return both[:, 0], both[:, 1]

    def tune(self, x: np.ndarray, found: list[tuple[int, list[int]]]) -> None:
        """Sets the ratio by a sample of queries and, for each of their true neighbours, (row of x, its lists).

        The first ratio is by exact distances; it grows until the lists that the graph search finds hold
        the wanted share too.
        """
        far = np.sqrt(_squared(self._asking(x), self.graph.points))
        least = np.maximum(far.min(1), 1e-9 * self.norm)
        needed = np.sort([far[i, lists].min() / least[i] for i, lists in found])
        if not len(needed):
            return
        self.ratio = max(1.0, float(needed[math.ceil(RECALL * len(needed)) - 1])) * (1 + 1e-9)
        while True:
            row, near = self.lists_of_queries(x)
            looks = np.zeros(far.shape, bool)
            looks[row, near] = True
            if looks.all() or np.mean([looks[i, lists].any() for i, lists in found]) >= RECALL:
                return
            self.ratio *= 1.01

    def place(self, most: int) -> None:
        """Deals lists to blocks of about `most` vectors; a longer list has several blocks of its own."""
        block, held = 0, 0
        for i, n in enumerate(self.sizes):
            if n > most:
                block += held > 0
                self.first[i], self.parts[i], held = block, -(-n // most), 0
                block += self.parts[i]
                continue
            if held + n > most:
                block, held = block + 1, 0
            self.first[i], held = block, held + n


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _listed(vectors: DataFrame, index: Index) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(i, _AT_ONCE)
                row, where = held.value.lists_of_vectors(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "id", "v"])

    return vectors.select("id", "v").mapInArrow(assign, "list long, id long, v array<double>")


def _looks(queries: DataFrame, index: Index) -> DataFrame:
    """(block, id, v, lists): every block that a query looks at, with the lists that it looks at there."""
    held = queries.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            for i in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(i, _AT_ONCE)
                row, where = own.lists_of_queries(_matrix(part.column("v")))
                parts = own.parts[where]
                nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                row, where, block = np.repeat(row, parts), np.repeat(where, parts), np.repeat(own.first[where], parts) + nth
                order = np.lexsort((where, block, row))
                row, where, block = row[order], where[order], block[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(where.astype(np.int64)))
                at = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(block[starts].astype(np.int64)), part.column("id").take(at), part.column("v").take(at), lists], ["block", "id", "v", "lists"])

    return queries.select("id", "v").mapInArrow(assign, "block long, id long, v array<double>, lists array<long>")


def _true_neighbours(posted: DataFrame, sample: pa.Table, k: int) -> list[tuple[int, list[int]]]:
    """(row of sample, lists) for the k best of all vectors for each row; a task holds its own best only."""
    held = posted.sparkSession.sparkContext.broadcast((np.asarray(sample["id"]), _matrix(sample["v"])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = held.value
        ids, lists, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in batches:
            if not b.num_rows:
                continue
            own = np.asarray(b.column("id"))
            inner = np.where(asked[:, None] == own, -np.inf, q @ _matrix(b.column("v")).T)
            ids, lists = (np.concatenate([old, np.broadcast_to(new, inner.shape)], 1) for old, new in ((ids, own), (lists, np.asarray(b.column("list")))))
            scores = np.concatenate([scores, inner], 1)
            wide = min(scores.shape[1], COPIES * k)  # a vector is in COPIES lists at most
            at = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
            ids, lists, scores = (np.take_along_axis(c, at, 1) for c in (ids, lists, scores))
        row, at = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row.astype(np.int64), ids[row, at], lists[row, at], scores[row, at])], ["row", "id", "list", "score"])

    found = posted.select("list", "id", "v").mapInArrow(score, "row long, id long, list long, score double")
    found = found.groupBy("row", "id").agg(F.max("score").alias("score"), F.collect_list("list").alias("lists"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("row", "lists")
    return [(r["row"], r["lists"]) for r in found.collect()]


def _best_of_block(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, starts: np.ndarray, ends: np.ndarray, asking: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a block's vectors (sorted by list) for each query; every one that ties with the last is weighed by its exact score and id."""
    q, asked = _matrix(asking.column("v")), np.asarray(asking.column("id"))
    looked = asking.column("lists")
    values = np.asarray(looked.flatten())
    at = np.searchsorted(lists, values)
    here = (at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == values)
    looks = np.zeros((len(q), len(lists)), bool)
    looks[np.repeat(np.arange(len(q)), np.asarray(looked.value_lengths()))[here], at[here]] = True
    wide, longest = min(len(x), COPIES * k), np.sqrt((x**2).sum(1).max())
    for i in range(0, len(q), _ASKED):
        part, some = q[i : i + _ASKED], looks[i : i + _ASKED]
        near = np.full((len(part), len(x)), -np.inf)
        for j in np.flatnonzero(some.any(axis=0)):
            own = np.flatnonzero(some[:, j])
            near[own, starts[j] : ends[j]] = part[own] @ x[starts[j] : ends[j]].T
        last = np.partition(near, len(x) - wide, axis=1)[:, len(x) - wide]
        slack = 1e-11 * longest * np.sqrt((part**2).sum(1))  # products in another order round otherwise
        row, column = np.nonzero((near >= (last - slack)[:, None]) & np.isfinite(near))
        exact = np.concatenate([np.zeros(0), *((part[row[a : a + _PAIRS]] * x[column[a : a + _PAIRS]]).sum(1) for a in range(0, len(row), _PAIRS))])
        order = np.lexsort((ids[column], -exact, row))
        row, named, exact = row[order], ids[column[order]], exact[order]
        fresh = np.append(True, (row[1:] != row[:-1]) | (named[1:] != named[:-1])) if len(row) else np.zeros(0, bool)  # copies in two lists stand together
        row, named, exact = row[fresh], named[fresh], exact[fresh]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (asked[i + row], named, exact)], ["query", "id", "score"])


def _scored(k: int):
    """Streams rows sorted by (block, chunk, kind): a block's vectors are held, then its queries pass."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(c), np.int64) for c in ("block", "chunk", "kind")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                part = b.slice(lo, hi - lo)
                if current != (keys[0, lo], keys[1, lo]):
                    current, pieces, ready = (keys[0, lo], keys[1, lo]), [], None
                if keys[2, lo] == 0:
                    pieces.append((_matrix(part.column("v")), np.asarray(part.column("id")), np.asarray(part.column("list"))))
                elif pieces:
                    if ready is None:
                        x, ids, where = (np.concatenate(c) for c in zip(*pieces))
                        order = np.argsort(where, kind="stable")
                        lists, starts = np.unique(where[order], return_index=True)
                        ready = x[order], ids[order], lists, starts, np.append(starts[1:], len(ids))
                    yield from _best_of_block(*ready, part, k)

    return score


def _sound(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _unit(seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def build(distinct: DataFrame, n: int, norm: float) -> Index:
    """An index fitted on about SAMPLE vectors a list, by hash of the id."""
    lists = min(CENTROIDS, max(1, round(SCALE * math.sqrt(n))))
    sample = distinct.where(_unit("ann") < F.lit(min(1.0, SAMPLE * lists / n))).select("id", "v").toArrow().sort_by("id")
    if not sample.num_rows:
        sample = pa.table({"v": distinct.limit(1).select("v").toArrow()["v"]})
    return Index(_matrix(sample["v"]), lists, norm)


def _filled(rows: DataFrame) -> DataFrame | None:
    """rows with vectors filled up with zeros to the longest one's length; None without rows."""
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if most is None:
        return None
    return rows if least == most else rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("v"))))


def _found(distinct: DataFrame, queries: DataFrame, index: Index, posted: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k best of the lists that each query looks at."""
    sc = distinct.sparkSession.sparkContext
    cores = max(1, sc.defaultParallelism)
    index.place(int(min(BLOCK, max(LEAST, -(-index.sizes.sum() // (SPREAD * cores))))))
    places = distinct.sparkSession.createDataFrame(pa.table({"list": np.arange(len(index.sizes)), "first": index.first, "parts": index.parts}))
    left = posted.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"), "id", "v", "list")
    looks = cut_lineage(_looks(queries, index))
    popular = cut_lineage(looks.groupBy("block").count().where(F.col("count") > QUERIES).select("block", F.ceil(F.col("count") / QUERIES).alias("chunks")))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    if popular.isEmpty():
        left, looks, n = left.withColumn("chunk", zero), looks.withColumn("chunk", zero), 1
    else:
        n = popular.agg(F.max("chunks")).first()[0]
        left = join_small(left, popular, ["block"], CENTROIDS, F.col("id"), "left").withColumn("chunk", F.explode(F.sequence(zero, F.coalesce(F.col("chunks"), F.lit(1)) - 1))).drop("chunks")
        looks = join_small(looks, popular, ["block"], CENTROIDS, F.col("id"), "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce(F.col("chunks"), F.lit(1)))).drop("chunks")
    columns = ["block", "chunk", "kind", "id", "v", "list", "lists"]
    both = left.withColumns({"kind": F.lit(0), "lists": none.cast("array<long>")}).select(*columns).unionByName(looks.withColumns({"kind": F.lit(1), "list": none.cast("long")}).select(*columns))
    blocks = int(index.first[-1] + index.parts[-1])
    tasks = int(max(1, min(blocks * n, max(SPREAD * cores, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    ordered = both.repartition(tasks, "block", "chunk").sortWithinPartitions("block", "chunk", "kind")
    found = ordered.mapInArrow(_scored(k), "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # a vector found in two lists has one place
    return found.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k).select("query", "id", "score").distinct()


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k best found for each vec_id divisible by `every`.

    vectors has vec_id and embedding. A query's own id is no candidate; ties go to the smaller id;
    fewer candidates than k are all returned. Null ids, null and zero vectors and vectors with null or
    non-finite components take no part. Vectors of unequal length are compared as if filled up with
    zeros. Rows that repeat an id with its vector count once; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _sound(F.col("v")))
    filled = _filled(rows)
    if filled is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = filled
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asks = F.when(F.pmod("id", F.lit(every)) == 0, F.col("id"))
    distinct = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min(asks).alias("asks"), F.count(asks).alias("n_asks")))
    n, total, most, asking = distinct.agg(F.count(F.lit(1)), F.sum("n"), F.max(norm), F.count("asks")).first()
    index = build(distinct, n, float(most))
    posted = cut_lineage(_listed(distinct, index))
    index.sizes = np.zeros(len(index.graph.points), np.int64)
    for r in posted.groupBy("list").count().collect():  # at most CENTROIDS counts come to the driver
        index.sizes[r["list"]] = r["count"]
    index.wanted = COPIES * (k + 2)  # a vector is in COPIES lists at most, so so many hold k + 2 different ones
    queries = distinct.where(F.col("asks").isNotNull()).select(F.col("asks").alias("id"), "v", F.col("id").alias("rep"))
    if len(index.graph.points) > 1 and asking:
        sample = queries.where(_unit("tune") < F.lit(min(1.0, SAMPLED / asking))).select(F.col("rep").alias("id"), "v").toArrow().sort_by("id")
        if sample.num_rows:
            index.tune(_matrix(sample["v"]), _true_neighbours(posted, sample, k))
    found = cut_lineage(_found(distinct, queries, index, posted, k + 1))
    # ids of found stand for equal vectors: the k + 1 smallest ids of each are all that can be among k besides the query's own.
    many = distinct.where("n > 1").select("v", F.col("id").alias("same"), F.col("asks").alias("query"), "n", "n_asks")
    members = cut_lineage(join_crowded(rows, many, ["v"], "n", total).select("same", "id", "query", "n_asks").distinct())
    smallest = Window.partitionBy("same").orderBy("id")
    few = members.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).groupBy("same").agg(F.collect_list("id").alias("ids"))
    hits = found.join(few.withColumnRenamed("same", "id"), "id", "left").select("query", F.explode(F.coalesce("ids", F.array("id"))).alias("vec_id"), "score")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    hits = cut_lineage(hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits")))
    others = members.where((F.pmod("id", F.lit(every)) == 0) & (F.col("id") != F.col("query"))).select("query", F.col("id").alias("query_id"))
    counted = hits.join(distinct.where("n_asks > 1").select(F.col("asks").alias("query"), "n_asks"), "query")
    more = join_crowded(others, cut_lineage(counted), ["query"], "n_asks", total).select("query_id", "hits")
    every_one = hits.withColumnRenamed("query", "query_id").unionByName(more)
    best = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return every_one.select("query_id", F.posexplode(best).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
