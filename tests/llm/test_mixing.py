import math
from collections import Counter

import duckdb
import pytest

from zonegrid.llm import mixing
from zonegrid.llm.mixing import Target
from zonegrid.llm.queries import MIXTURE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("big", 600), ("mid", 120), ("small", 30), (None, 10)):
        for k in range(n):
            rows.append((i, " ".join(["w"] * (5 + (i * 7 + k) % 40)), "en", source, 1))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def weights(rows):
    return {r["source"]: r["weight"] for r in rows}


def test_entropy_target(docs):
    rows = mixing.mixture(docs, Target(entropy=0.9, repeats=None, budget=20_000, block=1000)).collect()
    w = weights(rows)
    assert math.isclose(sum(w.values()), 1) and math.isclose(-sum(x * math.log(x) for x in w.values()), 0.9 * math.log(4), rel_tol=1e-6)
    used = Counter()
    for r in rows:
        used[r["source"]] += r["n_tokens"]
    assert all(w[s] * 20_000 - 1 <= used[s] <= w[s] * 20_000 + 45 for s in w)  # a part ends inside its last document
    blocks = Counter()
    for r in rows:
        blocks[r["block"]] += r["n_tokens"]
    assert sorted(blocks) == list(range(20)) and all(700 < n < 1300 for n in blocks.values())
    for b in blocks:
        assert sorted(r["place"] for r in rows if r["block"] == b) == list(range(1, sum(r["block"] == b for r in rows) + 1))


def test_epochs(docs):
    rows = mixing.mixture(docs, Target(entropy=1.0, repeats=None, budget=40_000)).collect()
    uses = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert max(uses.values()) == 1
    none = [r for r in rows if r["source"] is None]
    last = max(r["epoch"] for r in none)
    assert last > 3 and all(uses[i, e] == 1 for i in {r["doc_id"] for r in none} for e in range(last))
    orders = [[r["doc_id"] for r in sorted(none, key=lambda r: (r["block"], r["place"])) if r["epoch"] == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1])


def test_repetition_limit(docs):
    rows = mixing.mixture(docs, Target(entropy=1.0, repeats=2.0)).collect()
    times = Counter(r["doc_id"] for r in rows)
    assert len(times) == 760 and max(times.values()) == 2  # without a budget every document is used
    sums = Counter()
    for r in rows:
        sums[r["source"]] += r["n_tokens"]
    own = Counter()
    for r in docs.collect():
        own[r["source"]] += len(r["text"].split())
    ratio = {s: sums[s] / own[s] for s in own}
    assert math.isclose(ratio["big"], 1) and max(ratio.values()) < 2.2


@pytest.mark.parametrize("target", [Target(entropy=1.0, repeats=1.5), Target(entropy=0.9, repeats=None, budget=9_000), Target(entropy=1.0, repeats=None, budget=40_000)])
def test_mixed_uses_what_mixture_does(docs, target):
    uses = Counter(r["doc_id"] for r in mixing.mixture(docs, target).collect())
    got = mixing.mixed(docs, target)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == uses


def test_target_below_the_sources_own_entropy(docs):
    """Shares grow more uneven, until the entropy is met; a repetition limit holds there too."""
    w = weights(mixing.mixture(docs, Target(entropy=0.1, repeats=None, budget=10_000)).collect())
    assert math.isclose(-sum(x * math.log(x) for x in w.values()), 0.1 * math.log(4), rel_tol=1e-3) and w["big"] > 0.97
    own = sum(len(r["text"].split()) for r in docs.where("source = 'big'").collect())
    total = sum(len(r["text"].split()) for r in docs.collect())
    w = weights(mixing.mixture(docs, Target(entropy=0.1, repeats=1.05, budget=total)).collect())
    assert math.isclose(w["big"] * total / own, 1.05, rel_tol=1e-3)


def test_share_of_the_corpus(docs):
    total = sum(len(r["text"].split()) for r in docs.collect())
    rows = mixing.mixture(docs, Target(entropy=0.9, repeats=None, share=0.5, block=1_000)).collect()
    assert 0.5 * total <= sum(r["n_tokens"] for r in rows) < 0.5 * total + 4 * 45
    assert len({r["block"] for r in rows}) == math.ceil(0.5 * total / 1000)


def crowded(spark):
    """A third of all rows has no id and one text, a third one id and texts of its own."""
    rows = [(None, "the same few words", "en", "a", 1)] * 400 + [(7, f"one id but other words {i}", "en", "a", 1) for i in range(400)] + [(100 + i, "own words " * (1 + i % 5), "en", f"s{i % 3}", 1) for i in range(400)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_repeated_ids_are_cut_one_by_one(spark):
    df, target = crowded(spark), Target(entropy=None, repeats=None, share=0.5, block=200)
    rows = mixing.mixture(df, target).collect()
    used = Counter()
    for r in rows:
        used[r["source"]] += r["n_tokens"]
    own = Counter()
    for r in df.collect():
        own[r["source"]] += len(r["text"].split())
    assert all(own[s] / 2 - 1 <= used[s] <= own[s] / 2 + 10 for s in own)
    again = mixing.mixture(df.repartition(7), target).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mixed(df, target).collect())
    assert got == Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in rows)


def test_odd_rows(odd_docs, no_docs):
    assert mixing.mixture(no_docs, Target()).count() == mixing.mixed(no_docs, Target()).count() == 0
    got = mixing.mixed(odd_docs, Target(entropy=1.0, repeats=1.25))
    assert got.columns == odd_docs.columns
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    blank = odd_docs.where("doc_id IN (3, 4, 5)")
    assert mixing.mixture(blank, Target()).count() == 0


@pytest.mark.parametrize("target", [MIXTURE, Target(entropy=0.97, repeats=None), Target(entropy=1.0, repeats=None, budget=50_000, block=3_000), Target(entropy=0.5, repeats=1.2), Target(entropy=1.0, repeats=1.1, budget=60_000)])
def test_sql(spark, sf, target):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet"), target).collect()
    rounded = lambda r: (*r[:4], round(round(r[4], 9), 8), *r[5:])
    assert sorted(map(rounded, map(tuple, rows)), key=repr) == sorted(map(rounded, c.execute(mixing.sql(target)).fetchall()), key=repr)


def test_many_sources_give_the_same(docs, monkeypatch):
    target = Target(entropy=0.9, repeats=None, budget=9_000, block=500)
    wanted, mixed = sorted(map(tuple, mixing.mixture(docs, target).collect()), key=repr), sorted(map(tuple, mixing.mixed(docs, target).collect()), key=repr)
    monkeypatch.setattr(mixing, "SOURCES", 0)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mixture(docs, target).collect()), key=repr) == wanted
    assert sorted(map(tuple, mixing.mixed(docs, target).collect()), key=repr) == mixed
