"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A byte-level BPE encodes each pre-token by itself, so a document's count is the sum of its
pre-tokens'. The tree's leaves are blocks of consecutive pre-tokens, its nodes sums of characters
and tokens. An edit finds its block by descending the tree; pre-tokens are cut again from the last
one that the edit can't have touched until a cut falls on an old one behind the edit, and only these
are encoded; then the sums on the way up are renewed. A leaf that an insertion has made too large is
split. trees() makes a table of trees, which edited() brings up to date with a table of edits.

How far an edit reaches back: the pattern looks at two characters at most behind the end of what it
matches (a contraction's letters, or the character after a run of white space).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonegrid.llm.common import text_udf

#: Pre-tokens of a new leaf, and of one that is split; characters read at a time in search of an old cut; characters looked at behind a match.
LEAF, FULL, READ, AHEAD = 32, 128, 256, 3
#: Pre-tokens whose counts a task keeps.
KEPT = 300_000
#: The pre-tokens of byte-level BPE with this vocabulary (fixed by its format).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
Edit = tuple[int, int, str]

#: What the query edits: addresses of mail and of hosts, and numbers of nine digits or more.
_MAIL, _NUMERIC = r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)", r"(?P<host>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<number>\b\d{9,}\b)"
_REDACT, _REDACT_NUMERIC, _DIGIT = re.compile(f"{_MAIL}|{_NUMERIC}"), re.compile(_NUMERIC), re.compile(r"\d")


def redactions(text: str) -> list[Edit]:
    """Edits (start, end, replacement) that hide personal data, in order, not overlapping."""
    if "@" in text:
        pattern = _REDACT
    elif _DIGIT.search(text):
        pattern = _REDACT_NUMERIC  # the same matches: none of the other kind begins without an @ behind it
    else:
        return []
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in pattern.finditer(text)]


class Counter:
    """Tokens of pre-tokens by one tokenizer file, those met lately remembered."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > KEPT:
                known.clear()
            new = list(dict.fromkeys(p for p in pieces if p not in known))
            words = np.array([w for w in self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False).word_ids if w is not None], np.int64)
            known.update(zip(new, np.bincount(words, minlength=len(new)).tolist()))
            return [known[p] for p in pieces]


class Tree:
    """A document's pre-tokens in blocks, with a segment tree of (characters, tokens) over them."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        pieces = PATTERN.findall(text)
        counts = counter(pieces)
        self.blocks = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self._sum([sum(map(len, b)) for b in self.blocks], [sum(c) for c in self.counts])
        self.encoded = 0

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        """Builds the nodes over leaves of these sums."""
        n = len(chars)
        self.size = 1 << (n - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.chars[self.size : self.size + n] = chars
        self.tokens[self.size : self.size + n] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def row(self) -> dict[str, object]:
        """The tree as it is kept in a table: its text, pre-tokens' lengths and counts, leaves' sizes, and every node's sums."""
        lengths = [len(p) for b in self.blocks for p in b]
        counts = [c for b in self.counts for c in b]
        return {"text": self.text, "lengths": lengths, "counts": counts, "leaves": list(map(len, self.blocks)), "chars": self.chars, "sums": self.tokens}

    @classmethod
    def of_row(cls, row: dict[str, object], counter: Counter) -> Tree:
        """A tree from its row; nothing is cut or encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        tree.blocks, tree.counts = [], []
        at = piece = 0
        for leaf in row["leaves"]:
            held = []
            for length in row["lengths"][piece : piece + leaf]:
                held.append(row["text"][at : at + length])
                at += length
            tree.blocks.append(held)
            tree.counts.append(row["counts"][piece : piece + leaf])
            piece += leaf
        tree.chars, tree.tokens = row["chars"], row["sums"]
        tree.size = len(tree.chars) // 2
        return tree

    def _split(self, at: int) -> None:
        """Makes leaves of LEAF pre-tokens out of one, drops empty ones, and renews the nodes from the leaves' sums."""
        blocks, counts, chars, tokens = [], [], [], []
        for i, (pieces, own) in enumerate(zip(self.blocks, self.counts)):
            step = LEAF if i == at else len(pieces) or 1
            for k in range(0, len(pieces), step):
                whole = step == len(pieces)
                blocks.append(pieces[k : k + step])
                counts.append(own[k : k + step])
                chars.append(self.chars[self.size + i] if whole else sum(map(len, blocks[-1])))
                tokens.append(self.tokens[self.size + i] if whole else sum(counts[-1]))
        self.blocks, self.counts = blocks, counts
        self._sum(chars, tokens)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _block(self, at: int) -> tuple[int, int]:
        """The block that holds the character at, and where the block starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters start to end; places beyond the text count as its end."""
        length = self.chars[1]
        start = max(0, min(start, length))
        end = max(start, min(end, length))
        first, begin = self._block(max(0, start - AHEAD))
        while first and begin > max(0, start - AHEAD):
            first -= 1
            begin -= self.chars[self.size + first]
        skip, held = 0, self.blocks[first]
        while skip < len(held) and begin + len(held[skip]) + AHEAD <= start:
            begin += len(held[skip])
            skip += 1
        # begin: the first cut that may not stand; from here old pre-tokens are read as text until cuts agree again.
        block, place, read, old, at = first, skip, [], {}, begin
        want = end + READ
        while True:
            while at < want and block < len(self.blocks):
                if place < len(self.blocks[block]):
                    old[at] = (block, place)
                    read.append(self.blocks[block][place])
                    at += len(read[-1])
                    place += 1
                else:
                    block, place = block + 1, 0
            done = at >= length
            was = "".join(read)
            now = was[: start - begin] + replacement + was[end - begin :]
            moved = len(replacement) - (end - start)
            pieces, cut, agreed = PATTERN.findall(now), begin, None
            for k, p in enumerate(pieces):
                if cut - moved >= end and cut >= start + len(replacement) and cut - moved in old and (done or cut - begin + AHEAD <= len(now)):
                    agreed = k, old[cut - moved]
                    break
                cut += len(p)
            if agreed or done:
                break
            want = at + 4 * (at - begin)
        new, (block, place) = (pieces[: agreed[0]], agreed[1]) if agreed else (pieces, (len(self.blocks), 0))
        counts = self.counter(new)
        self.encoded += len(new)
        rest, rest_counts = (self.blocks[block][place:], self.counts[block][place:]) if block < len(self.blocks) else ([], [])
        last = min(block, len(self.blocks) - 1)
        self.blocks[first] = self.blocks[first][:skip] + new + rest
        self.counts[first] = self.counts[first][:skip] + counts + rest_counts
        for b in range(first, last + 1):
            if b > first:
                self.blocks[b], self.counts[b] = [], []
            node = self.size + b
            self.chars[node], self.tokens[node] = sum(map(len, self.blocks[b])), sum(self.counts[b])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for node in range(low, high + 1):
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            low, high = low // 2, high // 2
        if len(self.blocks[first]) > FULL:
            self._split(first)

    def apply(self, edits: list[Edit]) -> None:
        """Applies edits whose places are all in the text as it is now; they may not overlap."""
        for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
            self.edit(start, end, new)


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


KIND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_tokens", "n_pieces", "n_edits", "n_tokens_edited", "n_encoded_again")])


def counted(text: Column, path: str, edits: Column | None = None) -> Column:
    """struct(n_tokens, n_pieces, n_edits, n_tokens_edited, n_encoded_again) of a whole text.

    edits is a column array<struct<start:int,end:int,text:string>>, places in code points of the text,
    or None for redactions(). Null texts are empty, null edits none, and null parts of an edit 0, 0, ''.
    """

    def tell(texts: pa.Array, given: pa.Array | None) -> pa.Array:
        own, out = _counter(path), []
        for i, t in enumerate(texts):
            text = t.as_py() or ""
            changes = redactions(text) if given is None else [(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in given[i].as_py() or [] if e]
            tree = Tree(text, own)
            before, pieces = tree.total, sum(map(len, tree.blocks))
            tree.apply(changes)
            out.append((before, pieces, len(changes), tree.total, tree.encoded))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], KIND.names)

    def redacted(texts: pa.Array) -> pa.Array:
        return tell(texts, None)

    def edited(texts: pa.Array, given: pa.Array) -> pa.Array:
        return tell(texts, given)

    return text_udf(redacted, KIND)(text) if edits is None else text_udf(edited, KIND)(text, edits)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the counts of each row of docs before and after redaction."""
    return docs.select("doc_id", counted(F.col("text"), path).alias("c")).select("doc_id", "c.*")


#: A tree as a column; the second of its sums is the whole text's token count.
TREE = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("lengths", "counts", "leaves")], *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("chars", "sums")]])
_TREE = pa.struct([("text", pa.string()), *[(n, pa.list_(pa.int32())) for n in ("lengths", "counts", "leaves")], *[(n, pa.list_(pa.int64())) for n in ("chars", "sums")]])


def trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and tree of each row of docs, to be written as a table and kept up to date by edited().

    A null text is an empty one, whose tree has one empty leaf; a very long text is one tree; null and
    repeated ids are carried, other columns are not, an empty table stays empty.
    """

    def build(texts: pa.Array) -> pa.Array:
        own = _counter(path)
        return pa.array([Tree(t.as_py() or "", own).row() for t in texts], _TREE)

    return _with_counts(docs.select("doc_id", text_udf(build, TREE)(F.col("text")).alias("tree")))


def edited(kept: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The table of trees after a table of edits (doc_id, start, end, text), with n_encoded: the pre-tokens encoded for it.

    Places are code points of the text as kept; those beyond it count as its end, nulls as 0, 0 and ''. A
    document's edits go from its end to its start, those of one place in falling order of their ends, then
    rising order of their texts; repeated edits are applied as often as they stand. Edits of a null or an
    unknown id change nothing; edits of a repeated id change each of its trees. Only trees with edits reach
    Python. One document's edits are held together, as its tree is.
    """
    edit = F.struct(F.coalesce("start", F.lit(0)).cast("int").alias("start"), F.coalesce("end", F.lit(0)).cast("int").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    by_doc = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    kind = T.StructType([T.StructField("tree", TREE), T.StructField("n_encoded", T.LongType())])

    def renew(rows: pa.Array, changes: pa.Array) -> pa.Array:
        own, out = _counter(path), []
        for row, change in zip(rows, changes):
            if not row.is_valid:
                out.append(None)
                continue
            tree = Tree.of_row(row.as_py(), own)
            tree.apply([(e["start"], e["end"], e["text"]) for e in change.as_py()])
            out.append({"tree": tree.row(), "n_encoded": tree.encoded})
        return pa.array(out, pa.struct([("tree", _TREE), ("n_encoded", pa.int64())]))

    touched = F.when(F.col("edits").isNotNull(), F.col("tree"))
    new = kept.select("doc_id", "tree").join(by_doc, "doc_id", "left").withColumn("new", text_udf(renew, kind)(touched, F.col("edits")))
    return _with_counts(new.select("doc_id", F.coalesce("new.tree", "tree").alias("tree"), F.coalesce("new.n_encoded", F.lit(0)).alias("n_encoded")))


def _with_counts(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", F.element_at("tree.sums", 2).alias("n_tokens"), *[c for c in kept.columns if c != "doc_id"])
