import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from zonegrid.llm import common, langid, quality, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


# Languages


def slow_bits(texts, text):
    """Code length of text under a recursive PPM with exclusion, order three, of texts."""
    n, counts = 256, {}
    read = lambda t: [0, 0, 0, *t]
    for t in texts:
        s = read(t)
        for i in range(3, len(s)):
            for order in range(4):
                counts.setdefault(tuple(s[i - order : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - order : i])][s[i]] += 1

    def chance(context, x):
        if context is None:
            return 1 / n
        known = counts.get(context, {})
        shorter = context[1:] if context else None
        if not known:
            return chance(shorter, x)
        total, kinds = sum(known.values()), len(known)
        if kinds == n:
            return known[x] / total
        if x in known:
            return known[x] / (total + kinds)
        rest = 1 - sum(chance(shorter, k) for k in known)
        return kinds / (total + kinds) * chance(shorter, x) / rest

    s = read(text)
    return sum(-math.log2(chance(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s)))


PROBES = ["abba", "", "là bad", "cab\n\nd", "a", "zq 1", "ÀÉ", "你", "Abba\0A"]


def check_bits(texts):
    model = langid.Model(texts)
    bits, sizes = model.bits(pa.array(PROBES))
    again, _ = model.bits(pa.array(PROBES))  # from the table of costs
    assert np.array_equal(bits, again) and sizes.tolist() == [len(p.encode()) for p in PROBES]
    for j, k in enumerate(model.languages):
        for i, p in enumerate(PROBES):
            assert math.isclose(bits[i, j], slow_bits(texts[k], p.encode()), rel_tol=1e-5, abs_tol=1e-4)
    every = np.arange(256, dtype=np.uint32)
    for context in (0, 0x616263, 0xFFFFFF, 0x202061):
        for tree in model.trees:
            assert math.isclose((2.0 ** -tree.bits(np.uint32(context << 8) | every)).sum(), 1, rel_tol=1e-6)


def test_code_lengths_are_exact(monkeypatch):
    """Contexts that were seen once count as well."""
    monkeypatch.setattr(langid, "_BLOCK", 7)
    check_bits({"x": [b"abracadabra", b"cabbage abba"], "y": ["déjà vu là".encode(), b"bad dad", b""]})


def test_many_languages(monkeypatch):
    """Each of 90 languages is learned, and its tree is the one that it has alone."""
    monkeypatch.setattr(langid, "TABLE", 1 << 16)
    g = np.random.default_rng(7)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x3B1, 0x3C9), *range(0x5D0, 0x5EB)]]
    words = {f"l{i:02}": ["".join(g.choice(letters, 6)) for _ in range(40)] for i in range(90)}
    say = lambda k, n: " ".join(g.choice(words[k], n)).encode()
    texts = {k: [say(k, 60) for _ in range(4)] for k in words}
    model = langid.Model(texts)
    assert model.languages == sorted(words)
    names, _ = model.predict(pa.array([say(k, 12).decode() for k in words]))
    assert names == list(words)
    alone = langid.Model({"l07": texts["l07"]})
    assert np.allclose(model.bits(pa.array(PROBES))[0][:, 7], alone.bits(pa.array(PROBES))[0][:, 0], rtol=1e-6)


def test_all_languages_of_a_table_are_learned(spark):
    rows = [(i, f"{'abcdefghij'[i % 7]}{i % 80:02} " * 30 + f"w{i % 80}x " * 20, f"l{i % 80}", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(langid.fit(df).languages) == 80
    few = langid.fit(df.where("lang IN ('l1', 'l2')"), texts=2)
    assert few.languages == ["l1", "l2"]


def test_equal_rows_are_sampled_once(spark):
    rows = [(1, "the same text " * 20, "en")] * 500 + [(2, "autre chose ici " * 20, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tree = langid.fit(df).trees[0]
    alone = langid.Model({"en": [("the same text " * 20).encode()]}).trees[0]
    assert all(np.array_equal(a, b) for a, b in zip(tree.costs, alone.costs))


def test_held_out_languages(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_languages(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 7)) and by[6]["lang_pred"] == "en"
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert langid.identify(no_docs).count() == 0
    unknown = odd_docs.withColumn("lang", odd_docs.lang.cast("string")).where("lang IS NULL")
    assert {r["lang_pred"] for r in langid.identify(unknown).collect()} == {"und"}


# Toxicity


def test_held_out_toxicity(docs, labels):
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) > 0.85 and np.mean([r["predicted"] for r in held if not r["toxic"]]) < 0.04


def test_network_by_hand():
    """Tabulated responses against a plain convolution."""
    net, words = toxicity.Network(), toxicity.Words()
    texts = ["one two three four", "a", "", "x y"]
    got = net.logits([words(t) for t in texts])
    assert np.allclose(got, [net.logits([words(t)])[0] for t in texts], rtol=1e-5)  # whatever stands beside a text
    for t, z in zip(texts, got):
        x = np.concatenate([net.rows[words(t)].sum(1), np.zeros((4, toxicity.SIZE))])
        taps, top, tap = net.taps.reshape(toxicity.SIZE, -1, toxicity.FILTERS), [], 0
        for width in toxicity.WIDTHS:
            spots = [sum(x[i + j] @ taps[:, tap + j] for j in range(width)) for i in range(max(len(words(t)), 1))]
            top.append(np.max(spots, axis=0))
            tap += width
        assert math.isclose(np.maximum(np.concatenate(top) + net.bias, 0) @ net.out + net.base, z, rel_tol=1e-4, abs_tol=1e-5)


def test_odd_toxicity(spark, odd_docs, no_docs, labels):
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.classify(odd_docs, none).collect()} == {0.0}
    own = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(1, None, None), (None, 1, 1), (2, 5, 7)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(odd_docs, own).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify(no_docs, own).count() == 0


def test_thresholds_by_language(docs, labels):
    net = toxicity.fit(docs, labels)
    assert "en" in net.thresholds and all(0 < t < 1 for t in net.thresholds.values())


# Quality


def test_held_out_quality(spark, docs, labels):
    even = labels.where("doc_id % 2 = 0")
    rows = quality.classify(docs, even).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r["accepted"] for r in rows if r["quality"] is not None and r[3] == k] for k in (1, 0))
    assert np.mean(good) > 0.985 and np.mean(bad) < 0.25


def chance(z):
    return 1 / (1 + np.exp(-z))


def test_calibration_by_brute_force():
    """No slope and shift near the fitted ones have a smaller loss."""
    g = np.random.default_rng(1)
    z = g.normal(size=400) * 3
    t, w = (g.random(400) < chance(0.4 * z - 0.7)).astype(float), g.uniform(0.5, 2, 400)
    high, low = ((w * t).sum() + 1) / ((w * t).sum() + 2), 1 / ((w * (1 - t)).sum() + 2)
    goal = np.where(t > 0, high, low)
    loss = lambda a, b: -(w * (goal * np.log(chance(a * z + b)) + (1 - goal) * np.log(1 - chance(a * z + b)))).sum()
    a, b = common.platt(z, t, w)
    assert abs(a - 0.4) < 0.15 and abs(b + 0.7) < 0.4
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-3 for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def two_views(n, seed, flip=0.0):
    """Rows whose views are independent, given the label; the second one is weak."""
    g = np.random.default_rng(seed)
    y = (g.random(n) < 0.5).astype(float)
    first = g.normal(size=(n, 30)) + 0.45 * (2 * y - 1)[:, None]
    second = g.normal(size=(n, 10)) + 0.6 * (2 * y - 1)[:, None]
    return [first.astype(np.float32), second.astype(np.float32)], y


def test_views_learn_from_each_other():
    """With few labels, what either view is sure of makes the other one better, and the blend beats both."""
    views, y = two_views(24, 1)
    model = quality.Model(views, y, np.ones(24), np.arange(24) % 3 == 0)
    probe, t = two_views(4000, 2)
    right = lambda m: [((v.logit(x) > 0) == (t > 0)).mean() for v, x in zip(m.view, probe)]
    before = right(model)
    for r in range(3):
        pool, _ = two_views(600, 10 + r)
        z = [a * v.logit(x) + b for v, x, (a, b) in zip(model.view, pool, model.calibration)]
        lessons = []
        for learner in (0, 1):
            order = np.argsort(z[1 - learner])
            sure = np.concatenate([order[:100], order[-100:]])
            lessons.append((pool[learner][sure], (z[1 - learner][sure] > 0).astype(float)))
        model.learn(lessons)
    after = right(model)
    assert after[0] > before[0] and after[1] > before[1] - 0.01
    z = np.stack([a * v.logit(x) + b for v, x, (a, b) in zip(model.view, probe, model.calibration)], 1)
    assert ((model.blended(z) > 0.5) == (t > 0)).mean() >= max(after) - 0.01


def test_few_labels_are_calibrated_out_of_sample():
    """Labelled documents that took part in training never calibrate it."""
    g = np.random.default_rng(3)
    noise = [g.normal(size=(40, 200)).astype(np.float32), g.normal(size=(40, 50)).astype(np.float32)]
    y = (np.arange(40) % 2).astype(float)
    model = quality.Model(noise, y, np.ones(40), np.zeros(40, bool))
    assert abs(model.view[0].logit(noise[0])).mean() > 1  # it knows its own rows by heart
    z = np.stack([a * v.logit(x) + b for v, x, (a, b) in zip(model.view, noise, model.calibration)], 1)
    assert abs(model.blended(z) - 0.5).mean() < 0.4
    assert quality.Model([x[:2] for x in noise], y[:2], np.ones(2), np.zeros(2, bool)).calibration == [(1.0, 0.0)] * 2


def test_exchange_by_brute_force(spark, docs, labels):
    """The pseudo-labels are those least by hash of all documents without a label that a view is sure of."""
    some, known = docs.limit(1500).cache(), labels.where("quality IN (0, 1)").select("doc_id", "quality").limit(300).cache()
    model = quality.fit(some, known, rounds=0)
    own = some.withColumn("n_chars", F.col("n_chars").cast("double"))
    rows = own.select("doc_id", *quality._COLUMNS, quality._hash().alias("h")).toArrow()
    z = model.logits(*[rows[c].combine_chunks() for c in quality._COLUMNS])
    named, h = {r["doc_id"] for r in known.collect()}, np.array(rows["h"])
    free = np.array([i not in named for i in rows["doc_id"].to_pylist()])
    limit = math.log(quality.SURE / (1 - quality.SURE))
    for taken in ([[], []], [h[:200].tolist(), []]):
        got = quality.sure_of(model, own, known, 25, taken)
        for teacher in (0, 1):
            for label in (0, 1):
                sure = free & (z[:, teacher] >= limit if label else z[:, teacher] <= -limit)
                wanted = sorted(set(h[sure].tolist()) - set(taken[1 - teacher]))[:25]
                assert [x for x, t, k in got if (t, k) == (teacher, label)] == wanted


def test_score_is_the_blend(docs, labels):
    model = quality.fit(docs, labels, most=200, rounds=1)
    rows = docs.select("text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), quality.score(model, docs, *map(F.col, quality._COLUMNS)).alias("q")).limit(700).toArrow()
    content, meta = quality._views(rows)
    z = [a * v.logit(x) + b for v, x, (a, b) in zip(model.view, (content, meta), model.calibration)]
    wanted = chance(model.blend[0] * z[0] + model.blend[1] * z[1] + model.blend[2])
    assert np.allclose(np.array(rows["q"]), wanted, atol=1e-5)


def test_long_labelled_texts(spark, monkeypatch):
    """Texts of any length are learned from, within the bound of bytes; repeated ids count once."""
    monkeypatch.setattr(quality, "BYTES", 400_000)
    rows = [(i, ("good words here " if i % 2 else "#$% bad ") * (9_000 if i < 4 else 30), "en", "s", 10) for i in range(120)] + [(7, f"again {k}", "en", "s", 9) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    sample, _ = common.labelled(df, known, "quality", 2_000, 400_000)
    assert len(set(sample["doc_id"].to_pylist())) == sample.num_rows > 60 and sum(map(len, sample["text"].to_pylist())) < 600_000
    whole, _ = common.labelled(df, known, "quality", 2_000, 1 << 30)
    assert whole.num_rows == 120 and max(map(len, whole["text"].to_pylist())) > 70_000
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(df, known).where("doc_id BETWEEN 20 AND 119").collect()}
    assert all(v == bool(i % 2) for i, v in got.items())


def test_odd_quality(spark, odd_docs, no_docs, labels):
    assert quality.classify(odd_docs, labels.limit(0)).where("accepted").count() == odd_docs.count()
    own = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(1, None, None), (None, 1, 1), (2, 5, 7)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_docs, own).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["quality"] <= 1 for r in rows)
    kept = quality.accepted(odd_docs, own)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["accepted"] for r in rows)
    assert quality.classify(no_docs, own).count() == 0


def test_views_by_hand():
    texts = pa.array(["aab\naab", None, "", "x"])
    meta = quality.metadata_view(pa.array(["en", None, "en", "en"]), pa.array([None, "s", "s", "s"]), pa.array([7, None, 3, -1]))
    assert np.allclose(meta[:, -4], np.log2([8, 1, 4, 1]) / 10) and meta[:, -3:].tolist() == [[0, 1, 0], [1, 0, 1], [0, 0, 0], [0, 0, 0]]
    assert meta[:, : 2 * quality.NAMES].sum(1).tolist() == [2, 2, 2, 2] and meta[:, 2 * quality.NAMES : -4].argmax(1).tolist() == [3, 0, 2, 0]
    content = quality.content_view(texts)
    assert math.isclose((content[0, : quality.BUCKETS] ** 2).sum(), 1, rel_tol=1e-5) and not content[1:].any()


def test_views_of_a_sample_take_little_room():
    """The driver turns a sample of texts into rows a few at a time, one long text too, as if they came one by one."""
    texts = [f"text {i} of a line\n" * 3_000 for i in range(200)] + ["long words " * 300_000, "", None]
    t = pa.table({"text": texts, "lang": ["en"] * 203, "source": ["s"] * 203, "n_chars": [1.0] * 203})
    tracemalloc.start()
    content, _ = quality._views(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * t.nbytes
    for i in (0, 63, 64, 199, 200, 201, 202):
        assert (content[i] == quality.content_view(pa.array([texts[i]], pa.string()))[0]).all()
