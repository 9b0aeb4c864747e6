import re
from collections import Counter

import numpy as np
import pytest

from zonegrid.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check_counts(df):
    got = sorted((str(r["doc_id"]), *(r[c] for c in COUNTS), r["base_failed"]) for r in outliers.judge(df).collect())
    wanted = []
    for r in df.collect():
        n = slow_counts(r["text"])
        wanted.append((str(r["doc_id"]), *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(wanted)


def test_counts(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], *(r[c] for c in COUNTS)) for r in outliers.statistics(docs).collect())
    assert got == sorted((r["doc_id"], *slow_counts(r["text"])) for r in docs.collect())
    check_counts(odd_docs)
    assert outliers.judge(no_docs).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e f g h " * 3, "x " * 30, "a b c d e f g h", " ".join(map(str, range(40))) + " z " + " ".join(map(str, range(12))), "\n".join(["same line"] * 4 + ["other", " ", "", "other "])]
    check_counts(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))


def vector(r):
    n, c = max(r["n_words"], 1), max(r["word_chars"], 1)
    return [np.log(c / n), np.sqrt(r["n_symbols"] / c), np.sqrt(r["n_dup_lines"] / max(r["n_lines"], 1)), np.sqrt(r["n_repeat_words"] / n), np.sqrt(r["n_capitals"] / c)]


def noise(r):
    n, c = max(r["n_words"], 1), max(r["word_chars"], 1)
    return [0.25 / n, 0.25 / c, 0.25 / max(r["n_lines"], 1), 2.0 / n, 0.25 / c]


def fast_mcd(x, floor, starts=200, seed=0):
    """The smallest log-determinant (with floors) over random starts of six rows, by exact steps on the h nearest rows."""
    g, h = np.random.default_rng(seed), int(np.ceil(outliers.SUBSET * len(x)))
    best = np.inf
    for _ in range(starts):
        own, last = x[g.choice(len(x), 6, replace=False)], np.inf
        while True:
            s = np.cov(own.T, bias=True) + np.diag(floor)
            now = np.linalg.slogdet(s)[1]
            if now >= last - 1e-9 and len(own) == h:
                break
            last = now if len(own) == h else np.inf
            gap = x - own.mean(0)
            own = x[np.argsort(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap), kind="stable")[:h]]
        best = min(best, last)
    return best


def made(spark):
    """Three languages; one has a large source and many small ones, one no source, one is small; every 37th document is junk."""
    g = np.random.default_rng(2)
    rows = []
    for i in range(900):
        bad = i % 37 == 0
        words = ["".join(g.choice(list("abcdefgh"), g.integers(9, 14) if bad else g.integers(2, 7))) for _ in range(g.integers(25, 90))]
        if bad:
            words = [w + "#%" for w in words]
        if i % 3 == 0:
            words[::7] = [w.capitalize() for w in words[::7]]
        lang, source = ("en", "a") if i < 400 else ("en", f"s{i % 9}") if i < 700 else ("de", None) if i < 850 else ("fr", "a")
        rows.append((i, " ".join(words) + "\nline\n" * (i % 5 == 0), lang, source, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_document_is_judged(spark):
    got = {r["doc_id"]: r for r in outliers.verdicts(outliers.statistics(made(spark))).collect()}
    assert not any(r["base_failed"] or r["distance"] is None for r in got.values())
    assert not any(got[i]["kept"] for i in range(0, 900, 37)) and all(got[i]["kept"] for i in range(900) if i % 37)


def test_determinants_against_an_independent_search(spark):
    """No group's determinant is larger than what two hundred random starts of exact steps find."""
    counted = outliers.statistics(made(spark)).collect()
    for keep in (lambda r: r["lang"] == "en", lambda r: r["lang"] == "de", lambda r: r["source"] == "s3"):
        own = [r for r in counted if keep(r)]
        x, floor = np.array(list(map(vector, own))), outliers.OVER * np.mean(list(map(noise, own)), axis=0)
        names = [*outliers._X]
        rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, " + ", ".join(f"{n} double" for n in names))
        floors = spark.createDataFrame([("g", *map(float, floor))], "g string, " + ", ".join(f"{n} double" for n in outliers._F))
        found = outliers.estimates(rows, floors).first()
        assert found["logdet"] <= fast_mcd(x, floor) + 0.08  # bins take a few rows more than h
        assert abs(found["n"] / len(x) - outliers.SUBSET) < 0.03
        m, c = np.array([found[f"m{i}"] for i in range(5)]), np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                c[i, j] = c[j, i] = found[f"c{i}{j}"]
        assert np.isclose(np.linalg.slogdet(c + np.diag(floor))[1], found["logdet"], atol=1e-6) and np.isfinite(m).all()


def test_small_groups_lean_on_their_language(spark):
    """A document is judged by its language where its source has no other one; a repeated share alone can reject."""
    g = np.random.default_rng(5)
    say = lambda n: " ".join("".join(g.choice(list("abcdefgh"), g.integers(2, 7))) for _ in range(n))
    rows = [(i, say(400), "en", "big", 1) for i in range(300)] + [(1000, say(400), "en", "lone", 1), (1001, "x" * 12 + "#%& " + say(300).replace(" ", "## "), "en", "other", 1)]
    passage = say(100)
    rows.append((1002, f"{say(320)} {passage[:250]} {say(10)} {passage[:250]}", "en", "third", 1))
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[1000]["kept"] and not got[1001]["kept"] and all(got[i]["kept"] for i in range(300))
    assert got[1002]["distance"] > 10 and not got[1002]["base_failed"]


def test_one_document(spark):
    df = spark.createDataFrame([(1, "a word " * 3 + "and more of them " + " ".join(f"w{i}" for i in range(30)), None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert outliers.judge(df).first()["kept"]


def test_labels(spark):
    """Documents labelled good stay, junk that passes the base rules goes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = outliers.judge(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.3


def test_plan_is_native(spark, sf, capsys):
    outliers.statistics(spark.read.parquet(f"{sf}/documents.parquet")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("text, words", [("\x1c\x1da b", 2), ("a\x0bb\x0cc", 3), ("a b  ", 2)])
def test_words(spark, text, words):
    df = spark.createDataFrame([(1, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert outliers.statistics(df).first()["n_words"] == words == len(WORD.findall(text))


def test_salted_joins_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = lambda r: (r["doc_id"], r["kept"], None if r["distance"] is None else round(r["distance"], 6))
    wanted = sorted(map(key, outliers.judge(docs).collect()))
    monkeypatch.setattr(outliers, "GROUPS", 0)
    assert sorted(map(key, outliers.judge(docs).collect())) == wanted
