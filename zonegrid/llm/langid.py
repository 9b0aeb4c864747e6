"""Language identification by prediction by partial matching over bytes.

For each language a variable-order context tree holds how often each byte follows each context of up
to three bytes. A byte's probability is its share in the longest known context or, by method C's
escape, the escape probability times that in the next shorter context, with the bytes that the longer
one knows excluded: a proper distribution over all 256 bytes, so its logarithm is an exact code
length. After fitting the statistics are frozen, and every known context and byte gets its cost, every
context the cost of an escape: an unknown byte costs the escapes down to the context that knows it.
The language with the shortest code wins, among equals the first by name.

Trees are sparse, one for each language, so each language's is as large as its own sample makes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import fold, on_driver, raw_texts, sampled, sums_by_text, text_udf

#: Bounds of the fit: texts and bytes of a language, and texts in all (beyond it languages have fewer, LEAST at least).
TEXTS, BYTES, ALL, LEAST = 600, 4 << 20, 60_000, 20
#: Symbols after which more text makes a prediction no surer in its score.
SURE = 200
#: Bytes of a context, bytes of a process's table of costs, costs looked up at a time.
ORDER, TABLE, _BLOCK = 3, 32 << 20, 1 << 20


def _keys(data: np.ndarray, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bytes at the positions first to last, each behind the three before it in its text (0 before a text), as one number."""
    code = np.zeros(last - first, np.uint32)
    for back in range(ORDER, -1, -1):
        own = np.zeros(last - first, np.uint32)
        lo = max(first, back)
        if lo < last:
            own[lo - first :] = data[lo - back : last - back]
        near = starts[np.searchsorted(starts, first - back) : np.searchsorted(starts, last)]
        for i in range(back):
            at = near + i - first
            own[at[(at >= 0) & (at < last - first)]] = 0
        code = code << np.uint32(8) | own
    return code


def _mask(order: int) -> np.uint32:
    return np.uint32((1 << 8 * (order + 1)) - 1)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in the sorted known, and whether they do."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Tree:
    """One language's frozen statistics: costs of known bytes by context, and of escapes, for each order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts = offsets[:-1][np.diff(offsets) > 0]
        grams, counts = np.unique(_keys(data, starts, 0, len(data)), return_counts=True)
        self.keys, self.costs, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            keys, inverse = np.unique(grams & _mask(order), return_inverse=True)
            seen = np.bincount(inverse, counts, len(keys))
            contexts, place = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(place, seen, len(contexts)), np.bincount(place, minlength=len(contexts)).astype(float)
            shorter = 2.0 ** -self.costs[-1][_find(self.keys[-1], keys & _mask(order - 1))[0]] if order else np.full(len(keys), 1 / 256)
            rest = 1 - np.bincount(place, shorter, len(contexts))
            kinds[(kinds == 256) | (rest <= 1e-12)] = 0
            self.keys.append(keys)
            self.costs.append(-np.log2(seen / (total + kinds)[place]))
            self.contexts.append(contexts)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escapes.append(np.where(kinds > 0, -np.log2(kinds / (total + kinds) / np.maximum(rest, 1e-12)), np.inf))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each gram behind the others."""
        out, live = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            own = grams[live] & _mask(order)
            at, known = _find(self.keys[order], own)
            out[live[known]] += self.costs[order][at[known]]
            live, own = live[~known], own[~known]
            at, known = _find(self.contexts[order], own >> np.uint32(8))
            out[live[known]] += self.escapes[order][at[known]]
        out[live] += 8.0
        return out


class Model:
    """The trees of all languages, and a process's table of the costs met lately."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.languages = sorted(texts)
        self.trees = [Tree(*raw_texts(pa.array(texts[k], pa.large_binary()))) for k in self.languages]
        self.table: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """A row for each gram, a column for each language; costs that the table holds are not worked out again."""
        if self.table is None:
            slots = max(8, int(np.log2(TABLE / (4 * len(self.languages) + 8))))
            self.table = slots, np.full(1 << slots, -1, np.int64), np.zeros((1 << slots, len(self.languages)), np.float32)
        slots, held, costs = self.table
        slot = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots)
        missing = held[slot] != grams
        out = costs[slot]
        if missing.any():
            new, inverse = np.unique(grams[missing], return_inverse=True)
            fresh = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            out[missing] = fresh[inverse]
            own = (new * np.uint32(0x9E3779B1)) >> np.uint32(32 - slots)
            _, one = np.unique(own, return_index=True)  # of grams that share a slot one stays
            held[own[one]], costs[own[one]] = new[one], fresh[one]
        return out

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's code length by language, and its bytes."""
        data, offsets = raw_texts(texts)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        starts, begin = offsets[:-1], offsets[:-1][np.diff(offsets) > 0]
        step = max(1, _BLOCK // len(self.languages))
        for first in range(0, len(data), step):
            sums_by_text(self.costs(_keys(data, begin, first, min(first + step, len(data)))), starts, first, out)
        return out, np.diff(offsets)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        bits, sizes = self.bits(texts)
        scaled = -np.log(2) * (bits - bits.min(1, keepdims=True)) * (np.minimum(sizes, SURE) / np.maximum(sizes, 1))[:, None]
        chance = np.exp(scaled)
        chance /= chance.sum(1, keepdims=True)
        best = bits.argmin(1)
        data, offsets = raw_texts(texts)
        letters = np.zeros((len(best), 1))
        low = data | np.uint8(32)
        sums_by_text(((low >= 97) & (low <= 122))[:, None].astype(np.float64), offsets[:-1], 0, letters)
        names, score = [], chance[np.arange(len(best)), best]
        for i, k in enumerate(best):
            lettered = letters[i, 0] > 0 or any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
            names.append(self.languages[k] if lettered else "und")
            if not lettered:
                score[i] = 0.0
        return names, score


def fit(docs: DataFrame, texts: int = TEXTS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Context trees of a bounded sample of docs: about `texts` rows and BYTES of every language, by hash of id and text.

    Every language that a row names is learned; where there are more than ALL / texts of them, each has so
    many rows fewer. Sampled texts are whole; empty ones tell nothing, and one beyond BYTES by itself
    can't be held. Equal rows count once. None where no language is known.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = F.octet_length("text")
    known = known.where(size.between(1, BYTES) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sample = on_driver(sampled(known, "lang", texts, F.struct("doc_id", F.xxhash64("text")), size, BYTES, ALL, LEAST)[0].distinct())
    by: dict[str, list[bytes]] = {}
    for k, t in zip(sample["lang"].to_pylist(), sample["text"].to_pylist()):
        by.setdefault(k, []).append(t.encode())
    return Model(by) if by else None


def language(model: Model | None, docs: DataFrame, text: Column) -> Column:
    """struct(lang_pred, score) of a text; `und` and 0 for null, without a letter, or without a model."""
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(texts: pa.Array) -> pa.Array:
        names, score = held.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return text_udf(predict, kind)(text)


def identify(docs: DataFrame, mod: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs, learned from the rows not held out.

    Held out are ids whose crc32 modulo mod is held; null ids are not held out, nor learned from. Null
    texts and texts without a letter are `und` with score 0; languages that code a text equally short go by
    name, the first one wins; repeated rows stay, an empty table stays empty.
    """
    model = fit(docs.where(fold(F.col("doc_id"), mod) != held))
    found = docs.select("doc_id", language(model, docs, F.col("text")).alias("l"))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), "l.lang_pred", "l.score")
