import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zonegrid.llm import bpe_chunks, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
#: Pieces that texts are made of: contractions, spaces of all kinds, marks, special tokens, other scripts.
PIECES = ["a", "Be", "'s", "'", "re", "'l", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "é", "ß", "5", "²", "Ⅷ", "!", "--", "_", "İ", "Σ", "ς", "ﬁ", "你好", "\U0001f600", "<|endoftext|>", "</w>", "—", "“", " don't", "x" * 60, " " * 30, "ab " * 15, "\x00", "Ⱥ", "ǅ"]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counts():
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def slow(words, text):
    ids = words.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), words.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def short_chunks():
    """Chunks of a few characters, so that most joins fall inside words."""
    old, bpe_chunks.MEAN = bpe_chunks.MEAN, 5
    yield bpe_chunks.Encoder(WORDS)
    bpe_chunks.MEAN = old


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_encoding(short_chunks, words, text):
    assert short_chunks.encode(text) == slow(words, text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=300))
def test_encoding_of_any_text(short_chunks, words, text):
    assert short_chunks.encode(text) == slow(words, text)


#: Scripts with and without white space, marks that combine, capitals whose lower case composes anew.
SCRIPTS = ["Привет мир, как дела? ", "你好世界这是一个很长的句子没有空格", "मस्ते दुनिया ", "안녕하세요 세계 ", "שלום עולם ", "مرحبا بالعالم ", "H\u0331\u0331 e\u0301 ", "ΣΑΣ ΟΔΟΣ ", "\U0001f600\U0001f468\u200d\U0001f469 ", "İI\u0307 ", "don't we'll ", "Ⅷ ² ½ 12345 "]


@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts(words, script, monkeypatch):
    """Long texts of one script: exact, and copies are met in the chunks kept."""
    g = random.Random(3)
    pieces = [script] + [script[i:j] for i in range(len(script)) for j in (i + 1, i + 3)]
    passage = "".join(g.choice(pieces) for _ in range(1500))
    for mean in (7, 64, 1024):
        monkeypatch.setattr(bpe_chunks, "MEAN", mean)
        encoder = bpe_chunks.Encoder(WORDS)
        for text in (passage, "front " + passage, passage[5:], passage + " <|endoftext|>x " + passage):
            assert encoder.encode(text) == slow(words, text)


def test_copies_are_encoded_once(words, monkeypatch):
    """A passage without white space, in any script, costs its copy the joins only."""
    g = random.Random(4)
    monkeypatch.setattr(bpe_chunks, "MEAN", 1024)
    for alphabet in ("你好世界这是一个很长的句子，。！", "abc,.!1"):
        passage = "".join(g.choice(alphabet) for _ in range(12_000))
        encoder = bpe_chunks.Encoder(WORDS)
        assert encoder.encode("x" + passage) == slow(words, "x" + passage)
        cut = []
        monkeypatch.setattr(encoder, "_pieces", lambda text, plain, f=encoder._pieces: cut.append(len(text)) or f(text, plain))
        assert encoder.encode("yz " + passage) == slow(words, "yz " + passage)
        assert sum(cut) < 0.35 * len(passage)


def test_long_words(words, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MEAN", 1024)
    encoder = bpe_chunks.Encoder(WORDS)
    g = random.Random(5)
    text = "".join(g.choice("abcdefghij") for _ in range(9_000)) + " end " + "".join(g.choice("你好世界") for _ in range(5_000))
    assert encoder.encode(text) == slow(words, text)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_chunks.Encoder(BYTES)


@settings(max_examples=200, deadline=None)
@given(ids=st.lists(st.integers(0, 60_000), max_size=40))
def test_decoding(short_chunks, words, ids):
    assert short_chunks.decode(ids) == words.decode(ids, skip_special_tokens=False)


def test_decoded_column(spark, words):
    from pyspark.sql import functions as F

    rows = [(1, [320, 49407, 1125]), (2, None), (3, []), (4, [None, 320])]
    got = dict(map(tuple, spark.createDataFrame(rows, "i int, ids array<int>").select("i", bpe_chunks.decoded(F.col("ids"), WORDS)).collect()))
    assert got == {1: words.decode([320, 49407, 1125], skip_special_tokens=False), 2: "", 3: "", 4: words.decode([320])}


def test_cuts_follow_content():
    g = random.Random(1)
    passage = "".join(g.choice("abcdefgh ") for _ in range(20_000))
    at = {passage[c - 20 : c] for c in bpe_chunks.cuts(passage)}
    moved = {("front matter " + passage)[c - 20 : c] for c in bpe_chunks.cuts("front matter " + passage)}
    assert len(at) > 8 and len(at & moved) >= len(at) - 1


def test_caches_are_bounded(monkeypatch, words):
    monkeypatch.setattr(bpe_chunks, "CHUNKS", 3)
    monkeypatch.setattr(bpe_chunks, "WORDS", 50)
    encoder, g = bpe_chunks.Encoder(WORDS), random.Random(2)
    for _ in range(30):
        text = " ".join("".join(g.choice("abcde") for _ in range(6)) for _ in range(400))
        assert encoder.encode(text) == slow(words, text)
        assert len(encoder.chunks) <= 3 and len(encoder.words) < 500


def test_digests(spark, sf, words, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd_docs):
        wanted = []
        for r in df.collect():
            n, ids, text = slow(words, r["text"])
            wanted.append((str(r["doc_id"]), n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in bpe_chunks.digest(df, WORDS).collect()) == sorted(wanted)
    assert bpe_chunks.digest(no_docs, WORDS).count() == 0


def test_ids_and_text(odd_docs, words):
    from pyspark.sql import functions as F

    for r in odd_docs.select("text", bpe_chunks.encoded(F.col("text"), WORDS).alias("e")).collect():
        n, ids, text = slow(words, r["text"])
        assert (r["e"]["n_tokens"], " ".join(map(str, r["e"]["ids"])), r["e"]["decoded"]) == (n, ids, text)


@settings(max_examples=300, deadline=None)
@given(text=texts, edits=st.lists(st.tuples(st.floats(0, 1), st.integers(0, 40), st.lists(st.sampled_from(PIECES), max_size=3).map("".join)), max_size=4))
def test_tree_after_edits(counts, text, edits):
    tree = token_counts.Tree(text, token_counts._counter(BYTES))
    assert tree.total == counts(text)
    for place, size, new in edits:
        start = int(place * len(text))
        end = min(len(text), start + size)
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert tree.text == text and tree.chars[1] == len(text)
        assert [p for b in tree.blocks for p in b] == token_counts.PATTERN.findall(text)
        assert tree.total == counts(text)


def test_edits_touch_little(counts):
    text = " ".join(f"word{i}" for i in range(5000))
    tree = token_counts.Tree(text, token_counts._counter(BYTES))
    tree.edit(20_000, 20_003, "changed")
    assert tree.total == counts(text[:20_000] + "changed" + text[20_003:]) and tree.encoded < 120


def test_counts_before_and_after_redaction(spark, sf, counts, odd_docs, no_docs):
    def edited(text):
        for start, end, new in reversed(token_counts.redactions(text)):
            text = text[:start] + new + text[end:]
        return text

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd_docs):
        wanted = sorted((str(r["doc_id"]), counts(r["text"] or ""), len(token_counts.redactions(r["text"] or "")), counts(edited(r["text"] or ""))) for r in df.collect())
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) for r in token_counts.report(df, BYTES).collect()) == wanted
    assert token_counts.report(no_docs, BYTES).count() == 0


def test_given_edits(spark, counts):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 3, "1")]), (2, "abc", None), (3, None, [(0, 5, "new text")]), (4, "abc", [(None, None, None), None, (9, 20, " end")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", token_counts.counted(df.text, BYTES, df.edits).alias("c")).collect()}
    assert [got[i]["n_tokens_edited"] for i in (1, 2, 3, 4)] == [counts(t) for t in ("1 2 three", "abc", "new text", "abc end")]


def test_large_insertion_splits_its_leaf(counts):
    """Later edits near a large insertion look at small leaves; sums hold at every node."""
    counter = token_counts.Counter(BYTES)
    tree, text = token_counts.Tree("one two three " * 40, counter), "one two three " * 40
    for start, end, new in [(100, 104, "word, " * 5_000), (9_000, 9_003, "x"), (50, 30_200, ""), (0, 0, "at first "), (10**9, 10**9, " at last")]:
        tree.edit(start, end, new)
        text = text[:start] + new + text[max(start, end) :]
        assert (tree.text, tree.total) == (text, counts(text))
        assert max(map(len, tree.blocks)) <= token_counts.FULL
        for i in range(1, tree.size):
            assert tree.chars[i] == tree.chars[2 * i] + tree.chars[2 * i + 1] and tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


@settings(max_examples=150, deadline=None)
@given(text=texts, edits=st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), texts), max_size=6))
def test_kept_trees_take_edits(counts, text, edits):
    """A tree that is written and read again between edits gives what counting anew gives."""
    counter = token_counts.Counter(BYTES)
    tree = token_counts.Tree(text, counter)
    for start, end, new in edits:
        tree = token_counts.Tree.of_row(tree.row(), counter)
        tree.edit(start, end, new)
        start = min(start, len(text))
        text = text[:start] + new + text[max(start, min(end, len(text))) :]
        assert (tree.text, tree.total) == (text, counts(text))


def test_table_of_trees(spark, odd_docs, no_docs, counts, tmp_path):
    """Kept as Parquet, edited twice by tables of edits; odd rows and edits have the results that edited() names."""
    columns = "doc_id long, start int, end int, text string"
    token_counts.trees(odd_docs, BYTES).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    own = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert sorted((r.n_tokens, r.tree.text) for r in kept.collect()) == sorted((counts(t), t) for _, t in own)
    first = [(1, 4, 9, "very slow"), (1, 0, 3, "A"), (3, 0, 0, "now a text"), (6, 200_000, 200_004, "!!"), (9, 2, 99, None), (9, None, None, "b"), (99, 0, 1, "x"), (None, 0, 1, "x")]
    second = [(1, 0, 1, "The"), (6, 10, 20, "other words")]
    for k, edits in enumerate((first, second)):
        token_counts.edited(kept, spark.createDataFrame(edits, columns), BYTES).write.parquet(str(tmp_path / f"kept{k}"))
        kept = spark.read.parquet(str(tmp_path / f"kept{k}"))
        for i, start, end, new in sorted(edits, key=lambda e: -(e[1] or 0)):
            own = [(d, t[: start or 0] + (new or "") + t[end or 0 :] if d == i and d is not None else t) for d, t in own]
        got = kept.collect()
        assert sorted((r.n_tokens, r.tree.text) for r in got) == sorted((counts(t), t) for _, t in own)
        touched = {e[0] for e in edits}
        assert all((r.n_encoded == 0) if r.doc_id is None or r.doc_id not in touched else r.n_encoded < 500 for r in got)
    assert token_counts.trees(no_docs, BYTES).count() == 0
    assert token_counts.edited(kept, spark.createDataFrame([], columns), BYTES).agg({"n_encoded": "sum"}).first()[0] == 0
