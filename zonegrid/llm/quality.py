"""Quality classification by co-training on two views of a document.

The content view is the hashed histogram of the text's byte trigrams with a few figures of its
spread; the metadata view is what the table says about the page, without its text: language, source
and stated length. Each view has a logistic classifier. In each round both score every document
without a label, in Spark; of those that one is sure of, by its calibrated score, a bounded number
by hash come to the driver, for the other to learn from. At the end each view is calibrated on
labelled documents that took no part in training, and a logistic blend of the calibrated views, fitted
on those too, scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import cut_lineage, labelled, platt, raw_texts, text_udf

#: Bounds of the fit: labelled documents of either label, and their bytes.
LABELLED, BYTES = 2_000, 48 << 20
#: Co-training: rounds, pseudo-labels of either label that a view learns from a round, and how sure the other must be.
ROUNDS, GIVEN, SURE = 3, 200, 0.97
BUCKETS, FIGURES, NAMES, SIZES = 2048, 8, 256, 40
#: Documents scored at least so high are accepted.
ACCEPT = 0.5
#: Bytes hashed, and documents turned into rows, at once.
_BLOCK, _AT_ONCE = 1 << 18, 64


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte, made block by block: a byte's temporary numbers take twenty times its room."""
    out = np.empty(max(0, len(data) - 2), np.uint16)
    for at in range(0, len(out), _BLOCK):
        a, b, c = (data[at + i : min(at + _BLOCK, len(out)) + i].astype(np.uint32) for i in range(3))
        code = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
        out[at : at + _BLOCK] = ((code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
    return out


def content_view(texts: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed byte trigrams, and figures of their spread and of the lines."""
    data, offsets = raw_texts(texts)
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS + FIGURES), np.float32)
    code = _trigrams(data)
    for i in range(n):
        grams = code[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        if len(grams):
            share = sum(np.bincount(grams[k : k + _BLOCK], minlength=BUCKETS) for k in range(0, len(grams), _BLOCK)) / len(grams)
            out[i, :BUCKETS] = np.sqrt(share)
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            lines, words = text.split(b"\n"), text.split()
            spread = 10 * (share**2).sum(), (share > 0).sum() / min(len(grams), 500), len(zlib.compress(text, 1)) / len(grams)
            layout = np.log1p(len(text) / len(lines)) / 10, max(map(len, lines)) / len(text), len(set(lines)) / len(lines)
            out[i, BUCKETS:] = *spread, *layout, len(set(words)) / max(len(words), 1), np.log1p(len(text) / max(len(words), 1)) / 5
    return out


def metadata_view(langs: pa.Array, sources: pa.Array, stated: pa.Array) -> np.ndarray:
    """A row for each document: hashed language and source, the stated length's power of two, its logarithm, and whether each is missing."""
    n = len(langs)
    out = np.zeros((n, 2 * NAMES + SIZES + 4), np.float32)
    for at, names in ((0, langs), (NAMES, sources)):
        for i, name in enumerate(names.to_pylist()):
            out[i, at + zlib.crc32((name or "").encode()) % NAMES] = 1
    told = np.array([x if x is not None and x > 0 else 0 for x in pc.cast(stated, pa.float64()).to_pylist()]).reshape(n)
    size = np.log2(1 + told)
    out[np.arange(n), 2 * NAMES + np.minimum(size.astype(int), SIZES - 1)] = 1
    out[:, -4:] = np.stack([size / 10, *(np.array(pc.is_null(c)).reshape(n) for c in (langs, sources, stated))], 1)
    return out


class Logistic:
    """Logistic regression by full-batch Adam, on standardised columns with an L2 penalty. With `spent`, float32 rows x are standardised in place."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 250, l2: float = 1e-3, start: Logistic | None = None, spent: bool = False) -> None:
        w = np.ones(len(y)) if weight is None else weight
        w = (w / w.sum()).astype(np.float32)
        self.mean = w @ x
        self.scale = 1 / np.sqrt(np.maximum(np.einsum("i,ij,ij->j", w, x, x) - self.mean**2, 0) + 1e-4)
        z = np.subtract(x, self.mean, dtype=np.float32, out=x if spent else None)  # the only copy of x
        z *= self.scale.astype(np.float32)
        beta, m, v = np.zeros(x.shape[1] + 1, np.float32), 0.0, 0.0
        if start is not None:
            beta = np.append(start.beta / self.scale, start.bias + self.mean @ start.beta).astype(np.float32)
        for t in range(1, steps + 1):
            gap = w * (sigmoid(z @ beta[:-1] + beta[-1]) - y)
            grad = np.append(z.T @ gap + l2 * beta[:-1], gap.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            beta = (beta - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        self.beta = (beta[:-1] * self.scale).astype(np.float32)
        self.bias = float(beta[-1] - self.mean @ self.beta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.beta + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _views(t: pa.Table) -> list[np.ndarray]:
    """Both views of a table's rows, a few documents at a time."""
    content = np.zeros((t.num_rows, BUCKETS + FIGURES), np.float32)
    for i in range(0, t.num_rows, _AT_ONCE):
        content[i : i + _AT_ONCE] = content_view(t["text"].slice(i, _AT_ONCE).combine_chunks())
    others = [t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("lang", "source", "n_chars")]
    return [content, metadata_view(*others)]


class Model:
    """Two views' classifiers, their calibrations and the blend of both."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, weight: np.ndarray, aside: np.ndarray) -> None:
        """Trains either view on the labelled documents that are not aside; views are their rows."""
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), bool)
        self._labelled = views, y, weight, aside
        self._given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # what either view has learned from the other
        self.view: list[Logistic | None] = [None, None]
        self.calibration, self.blend = [(1.0, 0.0)] * 2, (0.5, 0.5, 0.0)
        self._train()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_labelled": None, "_given": None}

    def learn(self, given: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Goes on training either view with rows and labels that the other one is sure of."""
        for held, new in zip(self._given, given):
            held.append(new)
        self._train()

    def _train(self) -> None:
        views, y, weight, aside = self._labelled
        for v in (0, 1):
            self.view[v] = self._one(v, ~aside, self.view[v])
        z = self._aside_logits()
        if z is not None:
            check = aside if aside.any() else np.ones(len(y), bool)
            self.calibration = [platt(z[:, v], y[check], weight[check]) for v in (0, 1)]
            sure = np.stack([a * z[:, v] + b for v, (a, b) in enumerate(self.calibration)], 1)
            fitted = Logistic(sure.astype(np.float32), y[check], weight[check], 2000, 1e-2)
            self.blend = (float(fitted.beta[0]), float(fitted.beta[1]), float(fitted.bias))

    def _one(self, v: int, rows: np.ndarray, start: Logistic | None) -> Logistic:
        views, y, weight, _ = self._labelled
        more = self._given[v]
        w = np.concatenate([weight[rows], *(np.full(len(t), 0.5 * weight.mean()) for _, t in more)])
        x, n = np.empty((len(w), views[v].shape[1]), np.float32), int(rows.sum())
        np.take(views[v], np.flatnonzero(rows), axis=0, out=x[:n], mode="clip")  # the other mode makes a second copy
        for held, _ in more:
            x[n : n + len(held)] = held
            n += len(held)
        return Logistic(x, np.concatenate([y[rows], *(t for _, t in more)]), w, 80 if start else 250, start=start, spent=True)

    def _aside_logits(self) -> np.ndarray | None:
        """Both views' logits of labelled documents that they were not trained on: those aside or, where there are none, by halves; None with under two of a label."""
        views, y, _, aside = self._labelled
        if aside.any():
            return np.stack([m.logit(x[aside]) for m, x in zip(self.view, views)], 1)
        half = np.zeros(len(y), bool)
        for k in (0, 1):
            half[np.flatnonzero(y == k)[::2]] = True
        if min((y[half] == k).sum() for k in (0, 1)) < 1 or min((y[~half] == k).sum() for k in (0, 1)) < 1:
            return None
        z = np.zeros((len(y), 2))
        for part in (half, ~half):
            for v in (0, 1):
                z[part, v] = self._one(v, ~part, None).logit(views[v][part])
        return z

    def logits(self, texts: pa.Array, langs: pa.Array, sources: pa.Array, stated: pa.Array) -> np.ndarray:
        """A row for each document: the calibrated logits of the content and of the metadata."""
        rows = content_view(texts), metadata_view(langs, sources, stated)
        return np.stack([a * m.logit(x) + b for m, x, (a, b) in zip(self.view, rows, self.calibration)], 1)

    def blended(self, z: np.ndarray) -> np.ndarray:
        first, second, bias = self.blend
        return sigmoid(first * z[:, 0] + second * z[:, 1] + bias)


def _apply(model: Model, docs: DataFrame, kind: T.DataType, finish, text: Column, lang: Column, source: Column, stated: Column) -> Column:
    """A column of finish(calibrated logits), a few documents at a time."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(texts: pa.Array, langs: pa.Array, sources: pa.Array, stated: pa.Array) -> pa.Array:
        out = [np.zeros((0, 2)), *(held.value.logits(*(a.slice(i, _AT_ONCE) for a in (texts, langs, sources, stated))) for i in range(0, len(texts), _AT_ONCE))]
        return finish(held.value, np.concatenate(out))

    return text_udf(rate, kind)(text, lang, source, stated.cast("double"))


_COLUMNS = ("text", "lang", "source", "n_chars")


def sure_of(model: Model, docs: DataFrame, known: DataFrame, given: int, taken: list[list[int]]) -> list[tuple[int, int, int]]:
    """(h, teacher, label): for either view and label, the `given` documents least by hash of all that it is sure of, that have no label and that the other view has not learned from.

    h is the hash of a document's text and metadata, so equal documents count as one.
    """
    pair = T.StructType([T.StructField("z0", T.DoubleType()), T.StructField("z1", T.DoubleType())])

    def both(_: Model, z: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(z[:, 0]), pa.array(z[:, 1])], ["z0", "z1"])

    z = _apply(model, docs, pair, both, *map(F.col, _COLUMNS))
    scored = cut_lineage(docs.select("doc_id", _hash().alias("h"), z.alias("z")).select("doc_id", "h", "z.z0", "z.z1"))
    free = cut_lineage(scored.join(known.select("doc_id"), "doc_id", "left_anti").select("h", "z0", "z1"))
    limit, found = float(np.log(SURE / (1 - SURE))), []
    for teacher in (0, 1):
        for label in (0, 1):
            sure = F.col(f"z{teacher}") >= limit if label else F.col(f"z{teacher}") <= -limit
            rows = free.where(sure & ~F.col("h").isin(taken[1 - teacher])).groupBy("h").agg(F.lit(1)).orderBy("h").limit(given)
            found += [(r["h"], teacher, label) for r in rows.collect()]
    return found


def _hash() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _COLUMNS])


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> Model | None:
    """Co-trains on about `most` documents of either label and BYTES, and on all documents without one.

    Each round scores every document and brings back `given` pseudo-labels of either label for either view
    at most. Null and empty texts take part; repeated ids of labels count once, with the smallest label,
    repeated ids of docs once; labels other than 0 and 1, null labels and null ids take no part. None
    where either label is missing.
    """
    own = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample, counts = labelled(own, known, "quality", most, BYTES)
    y = np.array(sample["quality"].to_pylist() if sample.num_rows else [], np.float64)
    if not {0, 1} <= set(y):
        return None
    weight = np.array([counts[k] / (y == k).sum() for k in y])
    aside = np.array([zlib.crc32(b"aside%d" % i) % 3 == 0 for i in sample["doc_id"].to_pylist()])
    model = Model(_views(sample), y, np.sqrt(weight / weight.mean()), aside)
    del sample
    pa.default_memory_pool().release_unused()  # the texts have served, and the driver's memory is small
    taken: list[list[int]] = [[], []]
    for _ in range(rounds):
        sure = sure_of(model, own, known, given, taken)
        if not sure:
            break
        keys = own.sparkSession.createDataFrame(sorted({(h,) for h, _, _ in sure}), "h long")  # at most 4 * given hashes
        rows = own.withColumn("h", _hash()).where(F.octet_length(F.coalesce("text", F.lit(""))) <= BYTES // given)
        rows = rows.join(F.broadcast(keys), "h").groupBy("h").agg(*[F.first(c).alias(c) for c in _COLUMNS]).toArrow().sort_by("h")
        place, views = {h: i for i, h in enumerate(rows["h"].to_pylist())}, _views(rows)
        lessons = []
        for learner in (0, 1):
            told = [(h, label) for h, teacher, label in sure if teacher == 1 - learner and h in place]
            taken[learner] += [h for h, _ in told]
            lessons.append((views[learner][[place[h] for h, _ in told]], np.array([label for _, label in told], np.float64)))
        model.learn(lessons)
    return model


def score(model: Model | None, docs: DataFrame, text: Column, lang: Column, source: Column, stated: Column) -> Column:
    """How likely a document is good, from 0 to 1; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)
    return _apply(model, docs, T.DoubleType(), lambda m, z: pa.array(m.blended(z), pa.float64()), text, lang, source, stated)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 to 1) and accepted of each row of docs.

    Null or empty texts have no content and are scored by what else is known; null columns count as
    empty names and a stated length of zero; very long texts are scored whole; repeated rows stay, equal
    documents have equal scores; a score of ACCEPT is accepted. Without labels all are; an empty table stays empty.
    """
    model = fit(docs, labels)
    q = score(model, docs, *map(F.col, _COLUMNS))
    return docs.select("doc_id", q.alias("quality")).withColumn("accepted", F.col("quality") >= ACCEPT)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; nulls, empty tables and ties as for classify()."""
    model = fit(docs, labels)
    return docs.where(score(model, docs, *map(F.col, _COLUMNS)) >= ACCEPT)
