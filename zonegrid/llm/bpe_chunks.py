"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the normalised text cuts it where the hash of the last few characters says so,
wherever a passage stands: documents that share a passage share its chunks. A task keeps the chunks
it has met lately with their pre-tokens and encodings, so each is encoded once a task and its copies
cost a lookup. A cut may fall inside a word, so what a chunk gives alone can be wrong at its ends. At
each join the pre-tokens are cut again, from the last one that the chunk's end can't have touched,
over ever more of the next chunk until a cut falls on one of that chunk's own: from there on both
agree, as pre-tokens depend on nothing before them. Only what lies between is encoded again.

Texts of plain characters, whose normal form and classes are those below, are normalised and cut by
Python's own functions; others by the tokenizer file's normalizer and pre-tokenizer, and go through
the same chunks. A stretch between white space that holds a special token goes through the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import text_udf

#: Characters the rolling hash sees, and the mean length of a chunk; chunks and words a task keeps.
SEEN, MEAN = 12, 1024
CHUNKS, WORDS = 4_096, 150_000
#: Characters of a chunk that a join looks at first; characters looked at behind a pre-token (a contraction's letters).
HEAD, AHEAD = 48, 3
#: The parts of a tokenizer file that the chunks rest on (fixed by the format): white space parts pre-tokens, and each is encoded by itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _plain(c: str) -> bool:
    low = c.lower()
    return unicodedata.category(c) != "Cn" and unicodedata.normalize("NFC", c) == c and len(low) == 1 and ord(low) < 0x250


_PLAIN = [c for c in map(chr, range(0x250)) if _plain(c)] + [c for c in map(chr, range(0x2010, 0x205F)) if unicodedata.category(c)[0] in "PS"]
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_in = lambda kinds: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] in kinds and c not in _SPACES)
_LETTERS, _NUMBERS = _in("L"), _in("N")
_WHOLE = re.compile(f"[{''.join(map(re.escape, _PLAIN))}]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def cuts(text: str) -> list[int]:
    """Where text is cut: after characters whose rolling hash is in one of MEAN classes."""
    if len(text) <= SEEN:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = code.copy()
    for back in range(1, SEEN):
        h[back:] += code[:-back] * np.uint32(pow(0x01000193, back, 1 << 32))
    h *= np.uint32(0x9E3779B1)
    at = np.flatnonzero(h[SEEN - 1 :] < np.uint32((1 << 32) // MEAN)) + SEEN
    return at[at < len(text)].tolist()


def supported(path: str) -> bool:
    """Whether a tokenizer file is of the kind that this module encodes by chunks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = cutters[0]
    plain = split.get("type") == "Split" and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
    mapped = len(cutters) == 2 and cutters[1].get("type") == "ByteLevel" and not cutters[1].get("add_prefix_space") and not cutters[1].get("use_regex")
    added = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") == NORMALIZER and plain and mapped and added and spec.get("decoder") is None and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")


Encoding = tuple[int, str, str]  # how many ids, the ids, the decoded text
Pieces = list[tuple[str, int]]  # pre-tokens by their key and where each ends


class Chunk:
    """What a chunk gives alone: its first pre-tokens one by one, the encoding of the others, and the end that the next chunk may change."""

    __slots__ = ("head", "words", "body", "tail", "text")

    def __init__(self, text: str, head: Pieces, words: list[str], tail: str) -> None:
        self.text, self.head, self.tail = text, head, tail
        self.words: list[str] | None = words  # until body, their encoding, is there
        self.body: Encoding = (0, "", "")


def _stable(pieces: Pieces, size: int) -> int:
    """How many pre-tokens of a text of that size no text behind it can change."""
    n = len(pieces)
    while n and pieces[n - 1][1] + AHEAD > size:
        n -= 1
    return n


class Encoder:
    """Encodes whole texts as one tokenizer file does, and decodes ids; keeps recent chunks and words."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not supported(path):
            raise ValueError(f"{path} is not a tokenizer file whose pre-tokens end at white space and are encoded one by one")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"[^{_SPACES}]*(?:{'|'.join(map(re.escape, special))})[^{_SPACES}]*") if special else None
        self.names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.numbers = list(map(str, range(max(self.names, default=0) + 1)))
        self.words: dict[str, Encoding] = {}
        self.chunks: OrderedDict[tuple[bool, str], Chunk] = OrderedDict()

    def encode(self, text: str) -> Encoding:
        """How many ids, the ids and the decoded text; ids are decimal, joined by one space."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            ids = self.tokenizer.encode(m.group(), add_special_tokens=False).ids
            parts += [*self._chunked(text[at : m.start()]), (len(ids), " ".join(map(str, ids)), self.decode(ids))]
            at = m.end()
        return _joined(parts + self._chunked(text[at:] if at else text))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special ones included; ids that the file does not have are passed over."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def _chunked(self, text: str) -> list[Encoding]:
        if not text:
            return []
        plain = _WHOLE.fullmatch(text) is not None
        flat = text.lower() if plain else self.tokenizer.normalizer.normalize_str(text)
        parts: list[list[str] | Chunk] = []
        carried, wait, start = "", 0, 0
        for end in [*cuts(flat), len(flat)]:
            got, start = self._chunk(flat[start:end], plain), end
            if not carried:
                parts += [[w for w, _ in got.head], got]
                carried, wait = got.tail, 0
            elif len(carried) + len(got.text) < wait:  # a pre-token of many chunks is not looked at anew for each
                carried += got.text
            else:
                carried, agreed = self._join(carried, got, plain, parts)
                wait = 0 if agreed else 2 * len(carried)
        parts.append([w for w, _ in self._pieces(carried, plain)])
        return self._encoded(parts, plain)

    def _join(self, carried: str, chunk: Chunk, plain: bool, parts: list[list[str] | Chunk]) -> tuple[str, bool]:
        """Adds what follows from carried on to parts; what is carried on to the next join, and whether the chunk's own cuts were met."""
        seen = min(HEAD, len(chunk.text))
        own = {end: i for i, (_, end) in enumerate(chunk.head)}
        pieces = self._pieces(carried + chunk.text[:seen], plain)
        n = _stable(pieces, len(carried) + seen)
        for k in range(n):
            i = own.get(pieces[k][1] - len(carried))
            if i is not None:
                parts += [[w for w, _ in pieces[: k + 1] + chunk.head[i + 1 :]], chunk]
                return chunk.tail, True
        # wider: all of the chunk's cuts
        alone = self._pieces(chunk.text, plain)
        ends = {end: i for i, (_, end) in enumerate(alone[: _stable(alone, len(chunk.text))])}
        pieces = self._pieces(carried + chunk.text, plain)
        n = _stable(pieces, len(carried) + len(chunk.text))
        for k in range(n):
            i = ends.get(pieces[k][1] - len(carried))
            if i is not None:
                parts.append([w for w, _ in pieces[: k + 1] + alone[i + 1 : len(ends)]])
                return chunk.text[alone[len(ends) - 1][1] :], True
        parts.append([w for w, _ in pieces[:n]])
        return (carried + chunk.text)[pieces[n - 1][1] if n else 0 :], False

    def _chunk(self, text: str, plain: bool) -> Chunk:
        key = (plain, text)
        got = self.chunks.get(key)
        if got is not None:
            self.chunks.move_to_end(key)
            return got
        if plain:
            head = self._pieces(text[:HEAD], plain)
            head = head[: _stable(head, min(HEAD, len(text)))]
            first = head[-1][1] if head else 0
            words, last = _PIECE.findall(text, first), len(text)
            while words:  # behind the last piece there is only white space
                last = text.rindex(words[-1], first, last) + len(words[-1])
                if last + AHEAD <= len(text):
                    break
                last -= len(words.pop())
            tail = text[last if words else first :]
        else:
            pieces = self._pieces(text, plain)
            pieces = pieces[: _stable(pieces, len(text))]
            n = sum(end <= HEAD for _, end in pieces)
            head, words, tail = pieces[:n], [w for w, _ in pieces[n:]], text[pieces[-1][1] if pieces else 0 :]
        got = self.chunks[key] = Chunk(text, head, words, tail)
        if len(self.chunks) > CHUNKS:
            self.chunks.popitem(last=False)
        return got

    def _pieces(self, text: str, plain: bool) -> Pieces:
        if plain:
            return [(m.group(), m.end()) for m in _PIECE.finditer(text)]
        return [(" " + mapped, end) for mapped, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _encoded(self, parts: list[list[str] | Chunk], plain: bool) -> list[Encoding]:
        """The encodings of words and chunks; all words that are not known go through the library in one call."""
        known, out = self.words, []
        wanted = [p.words if isinstance(p, Chunk) else p for p in parts]
        every = set(chain.from_iterable(words for words in wanted if words))
        if new := list(every.difference(known)):
            if len(known) + len(new) > WORDS:
                known.clear()
                new = list(every)
            known.update(zip(new, self._plainly(new) if plain else map(self._mapped, new)))
        for part, words in zip(parts, wanted):
            got = _joined([known[w] for w in words]) if words is not None else part.body
            if isinstance(part, Chunk) and words is not None:
                part.body, part.words = got, None
            out.append(got)
        return out

    def _plainly(self, words: list[str]) -> list[Encoding]:
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, tokens, numbers = got.ids, got.tokens, self.numbers
        of = np.array(got.word_ids, np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        said = [numbers[i] for i in ids]
        out: list[Encoding] = [(0, "", "")] * len(words)
        for word, a, b in zip(of[starts].tolist(), starts, [*starts[1:], len(ids)]):
            out[word] = (1, said[a], tokens[a]) if b - a == 1 else (b - a, " ".join(said[a:b]), " ".join(tokens[a:b]))
        return out

    def _mapped(self, key: str) -> Encoding:
        tokens = self.tokenizer.model.tokenize(key[1:])
        return len(tokens), " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens])


def _joined(parts: list[Encoding]) -> Encoding:
    if not parts:
        return 0, "", ""
    n, ids, tokens = zip(*parts)
    if 0 in n:
        n, ids, tokens = zip(*([p for p in parts if p[0]] or [(0, "", "")]))
    return sum(n), " ".join(ids), " ".join(tokens)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(text: Column, path: str) -> Column:
    """struct(n_tokens, ids, decoded) of a whole text; null is an empty text. ids is an array of int."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        rows = [own.encode(t.as_py() or "") for t in texts]
        ids = pa.array([np.fromstring(r[1], np.int32, sep=" ") if r[1] else [] for r in rows], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[2] for r in rows], pa.string())], ["n_tokens", "ids", "decoded"])

    return text_udf(run, kind)(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of an array of ids as the file decodes it; null is an empty array, null ids are passed over."""

    def run(rows: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.decode(r.as_py() or []) for r in rows], pa.string())

    return text_udf(run, T.StringType())(ids)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by one space) and of the decoded text.

    The same encoder as encoded()'s, whose ids and texts are hashed where they are made. Null and empty
    texts have no ids; ids of documents are carried, null or repeated.
    """
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        n, ids, decoded = [], [], []
        for t in texts:
            count, i, d = own.encode(t.as_py() or "")
            n.append(count)
            ids.append(hashlib.sha256(i.encode()).hexdigest())
            decoded.append(hashlib.sha256(d.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_udf(run, kind)(F.col("text")).alias("e")).select("doc_id", "e.*")
