"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed rows, of the whole word and of its first four letters.
Filters of widths one to three run over the words; each filter's largest response over the whole
text, rectified, feeds a logistic output. Scores are Platt-calibrated to the labelled documents'
own rate, on documents that took no part in training, and each language gets the threshold that
serves its calibration documents best. Scoring needs no multiplication a word: each hashed row's
responses are tabulated once, so a filter's response is a sum of table rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import fold, labelled, platt, text_udf

#: Bounds of the fit: labelled documents of either label, and their bytes.
LABELLED, BYTES = 4_000, 64 << 20
#: Hashed rows, their size, widths of filters and filters of each width.
ROWS, SIZE, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
#: The contract's threshold; languages with fewer calibration documents of either label use it too.
THRESHOLD, ENOUGH = 0.3, 20
_WORD = re.compile(r"[^\W\d_]+")
_HALF = ROWS // 2  # words have the first half of the rows, their beginnings the second; a code holds both
_PAD = ROWS  # a row of zeros, behind each text so that no window reaches the next one
_TAPS = sum(WIDTHS)
#: Training documents that must hold a word for its row to be used.
SEEN = 3
#: Steps between looks at the documents aside, and steps without gain after which training ends.
CHECKED, PATIENCE = 50, 400
#: Words that a process remembers, and words whose responses are held at a time.
_CACHED, _AT_ONCE = 200_000, 50_000


class Words:
    """Codes of a text's words; the words seen lately are remembered, up to a bound."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        codes = self.codes
        if len(codes) > _CACHED:
            codes.clear()
        out = []
        for w in _WORD.findall(text.lower()):
            c = codes.get(w)
            if c is None:
                c = codes[w] = zlib.crc32(w.encode()) % _HALF * _HALF + zlib.crc32(w[:4].encode()) % _HALF
            out.append(c)
        code = np.array(out, np.int64)
        return np.stack([code // _HALF, _HALF + code % _HALF], axis=1).astype(np.int32)


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of consecutive texts, pads behind each, and where each text's windows start and end.

    Windows start at words; an empty text has one, of pads.
    """
    pads = np.full((max(WIDTHS), 2), _PAD, np.int32)
    sizes = np.array([len(rows) for rows in texts], np.int64)
    starts = np.cumsum(sizes + len(pads)) - sizes - len(pads)
    flat = [x for rows in texts for x in (rows, pads)]
    return np.concatenate(flat) if flat else np.zeros((0, 2), np.int32), starts, starts + np.maximum(sizes, 1)


def _responses(taps: np.ndarray) -> np.ndarray:
    """Filters' responses at each position from each word's responses to every tap."""
    out = np.zeros((len(taps), len(WIDTHS) * FILTERS), np.float32)
    tap = 0
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            column = taps[j:, tap * FILTERS : (tap + 1) * FILTERS]
            out[: len(column), k * FILTERS : (k + 1) * FILTERS] += column
            tap += 1
    return out


class Network:
    """The classifier; fit() trains it, score() gives calibrated scores."""

    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        self.rows = g.normal(0, 0.1, (ROWS + 1, SIZE)).astype(np.float32)
        self.rows[_PAD] = 0
        self.taps = g.normal(0, 0.3, (SIZE, _TAPS * FILTERS)).astype(np.float32)
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = g.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = 0.0
        self.slope, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray, langs: list[str | None], aside: np.ndarray, steps: int = 1500, batch: int = 64, seed: int = 7) -> None:
        """Trains on the documents not aside, by sparse Adagrad; calibrates on those aside (on all where they lack a label)."""
        words = Words()
        rows = [words(t) for t in texts]
        fit = np.array(list({texts[i]: i for i in np.flatnonzero(~aside)[::-1]}.values())[::-1])  # copies count once
        spread = np.zeros((2, ROWS + 1, 2))  # by label: documents that hold a word of the row; what one document holds is no evidence
        for i in fit:
            for side in (0, 1):
                spread[int(y[i]), np.unique(rows[i][:, side]), side] += 1
        rare = spread.sum(0) < SEEN
        wanted = spread.sum(0) * y[fit].mean()  # a row starts with how far it leans to a label, in standard deviations
        self.rows[:, 0] = ((spread[1] - wanted) / np.sqrt(wanted + 1)).max(1) / 4
        rows = [np.where(rare[r, [0, 1]], _PAD, r).astype(np.int32) for r in rows]
        self.rows[rare.all(1)] = 0
        self.rows[_PAD] = 0
        self.taps[0, 0], self.out[0] = 1, 1  # by the first filter of width one
        groups = [fit[y[fit] == k] for k in (0, 1)]
        g = np.random.default_rng(seed)
        seen = [np.full_like(a, 1e-6) for a in (self.rows, self.taps, self.bias, self.out)]
        seen_base, rate = 1e-6, 0.05
        trial = [i for i in np.flatnonzero(aside)] if len(set(y[aside])) == 2 else []
        best, best_loss = None, np.inf
        for step in range(min(steps, 25 * (1 + len(fit) // 8)) + 1):
            if trial and step % CHECKED == 0:  # the state that does best on the documents aside stays
                self.table = None
                z = self.logits([rows[i] for i in trial])
                loss = (weight[trial] * np.logaddexp(0, np.where(y[trial] > 0, -z, z))).sum()
                if loss < best_loss:
                    best, best_loss, since = (self.rows.copy(), self.taps.copy(), self.bias.copy(), self.out.copy(), self.base), loss, step
                elif step - since >= PATIENCE:
                    break
            chosen = np.concatenate([g.choice(groups[0], batch * 2 // 3), g.choice(groups[1], batch // 3)])
            pairs, starts, ends = _laid_out([rows[i] for i in chosen])
            x = self.rows[pairs].sum(1)
            r = _responses(x @ self.taps)
            at = np.stack([s + r[s:e].argmax(0) for s, e in zip(starts, ends)])
            top = np.take_along_axis(r, at, 0) + self.bias
            feature = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(feature @ self.out + self.base, -30, 30)))
            gap = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            back = gap[:, None] * self.out * (top > 0)
            d_out, d_base, d_bias = feature.T @ gap + 1e-4 * self.out, gap.sum(), back.sum(0)
            d_taps, spots, moves = 1e-4 * self.taps, [], []
            tap = 0
            for k, width in enumerate(WIDTHS):
                b, a = back[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    where = np.minimum(a + j, len(pairs) - 1)
                    cols = slice(tap * FILTERS, (tap + 1) * FILTERS)
                    d_taps[:, cols] += np.einsum("df,dfs->sf", b, x[where])
                    spots.append(pairs[where].reshape(-1, 2))
                    moves.append((b[:, :, None] * self.taps[:, cols].T[None]).reshape(-1, SIZE))
                    tap += 1
            spots, moves = np.concatenate(spots), np.concatenate(moves)
            live = np.abs(moves).sum(1) > 0
            for side in (0, 1):
                touched, inverse = np.unique(spots[live, side], return_inverse=True)
                d = np.zeros((len(touched), SIZE), np.float32)
                np.add.at(d, inverse, moves[live])
                d[touched == _PAD] = 0
                seen[0][touched] += d**2
                self.rows[touched] -= rate * d / np.sqrt(seen[0][touched])
            for v, d, s in ((self.taps, d_taps, seen[1]), (self.bias, d_bias, seen[2]), (self.out, d_out, seen[3])):
                s += d**2
                v -= rate * d / np.sqrt(s)
            seen_base += d_base**2
            self.base -= float(rate * d_base / np.sqrt(seen_base))
        if best is not None:
            self.rows, self.taps, self.bias, self.out, self.base = best
        self.table = None
        check = np.flatnonzero(aside) if len(set(y[aside])) == 2 else np.arange(len(y))
        z, t, w = self.logits([rows[i] for i in check]), y[check], weight[check]
        self.slope, self.shift = platt(z, t, w)
        p = self._calibrated(z)
        named = np.array([k or "" for k in langs], object)[check]
        for k in sorted(set(named) - {""}):
            own = named == k
            if min((t[own] > 0).sum(), (t[own] == 0).sum()) < ENOUGH:
                continue
            cuts = np.linspace(0.05, 0.95, 91)
            f1 = [2 * w[own & (p >= c)] @ t[own & (p >= c)] / (w[own & (p >= c)].sum() + w[own] @ t[own]) for c in cuts]
            best = cuts[np.isclose(f1, np.max(f1))]
            self.thresholds[k] = float(best[np.abs(best - THRESHOLD).argmin()])

    def logits(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        if self.table is None:
            self.table = (self.rows @ self.taps).astype(np.float32)
        out, held, n = [np.zeros(0)], [], 0
        for rows in texts:
            held.append(rows)
            n += len(rows)
            if n >= _AT_ONCE:
                out.append(self._logits(held))
                held, n = [], 0
        return np.concatenate([*out, self._logits(held)] if held else out)

    def _logits(self, texts: list[np.ndarray]) -> np.ndarray:
        pairs, starts, ends = _laid_out(texts)
        edges = np.stack([starts, ends], axis=1).ravel()
        top = np.maximum.reduceat(_responses(self.table[pairs[:, 0]] + self.table[pairs[:, 1]]), edges, axis=0)[::2]
        return np.maximum(top + self.bias, 0) @ self.out + self.base

    def _calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))

    def score(self, texts: pa.Array, words: Words) -> np.ndarray:
        return self._calibrated(self.logits(words(t.as_py() or "") for t in texts))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Network | None:
    """Trains on a bounded sample: about `most` documents of either label and BYTES, each whole.

    Null texts are empty ones. Repeated ids of labels count once, with the largest label, and repeated ids
    of docs once; labels other than 0 and 1 and null ids take no part. None where either label is missing.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample, counts = labelled(docs.select("doc_id", "text", "lang"), known, "toxic", most, BYTES)
    y = np.array(sample["toxic"].to_pylist() if sample.num_rows else [], np.float64)
    if len(set(y)) < 2:
        return None
    weight = np.array([counts[k] / (y == k).sum() for k in y])
    aside = np.array([zlib.crc32(b"aside%d" % i) % 4 == 0 for i in sample["doc_id"].to_pylist()])
    if len(set(y[~aside])) < 2:
        aside[:] = False
    net = Network()
    net.fit(sample["text"].to_pylist(), y, weight, sample["lang"].to_pylist(), aside)
    return net


def score(net: Network | None, docs: DataFrame, text: Column) -> Column:
    """A text's toxicity from 0 to 1, null as empty; 0 without a network."""
    if net is None:
        return F.lit(0.0)
    held = docs.sparkSession.sparkContext.broadcast(net)
    words = Words()

    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts, words), pa.float64())

    return text_udf(rate, T.DoubleType())(text)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), lang_threshold and flagged of each row of docs.

    Only labels of ids whose crc32 modulo mod is not held are learned from; without either label all scores
    are 0. A null text scores as an empty one, a very long one whole, a null id is not held out, repeated
    rows stay, an empty table stays empty, ties of score and threshold count as toxic. Scores use the text alone; flagged holds
    them against the language's own threshold (0.3 for null and for languages with few labels).
    """
    net = fit(docs, labels.where(fold(F.col("doc_id"), mod) != held))
    own = F.lit(THRESHOLD)
    for lang, cut in (net.thresholds if net else {}).items():
        own = F.when(F.col("lang") == F.lit(lang), F.lit(cut)).otherwise(own)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), score(net, docs, F.col("text")).alias("score"), own.alias("lang_threshold"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
