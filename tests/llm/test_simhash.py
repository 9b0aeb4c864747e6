import random
import re

import pytest
import xxhash

from zonegrid.llm import simhash
from zonegrid.llm.common import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check(df, got):
    rows = df.collect()
    fps = {(r["doc_id"], r["text"]): slow_fingerprint(r["text"]) for r in rows}
    classes = slow_classes(set(fps.values()))
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[classes[f]] = min(least.get(classes[f], i), i)
    wanted = sorted((str(r["doc_id"]), f"{fps[r['doc_id'], r['text']]:016x}", str(least.get(classes[fps[r["doc_id"], r["text"]]]))) for r in rows)
    assert sorted((str(a), b, str(c)) for a, b, c in map(tuple, got.collect())) == wanted


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, simhash.near_duplicates(docs))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, simhash.near_duplicates(odd_docs))
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("paired", [2, 5, 128])
def test_links_of_crowded_signatures(spark, paired):
    """Families of close fingerprints, paired off or linked by two-wildcard keys, give the same classes."""
    g = random.Random(paired)
    fps = set()
    for _ in range(6):
        base = g.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in g.sample(range(64), g.choice([1, 2, 3, 6]))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, paired)).collect()}
    got = {}
    for (f,) in signed:
        got.setdefault(roots.get(f, f), set()).add(f & (1 << 64) - 1)
    wanted = {}
    for f, c in slow_classes(fps).items():
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(500, 500)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)}


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "7", "8", "9", "None"]
    assert kept.where("doc_id = 3").first()["text"] is None
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("held", [10, 100_000])
def test_components_of_few_edges_need_few_jobs(spark, held):
    """A long chain, a star and repeated edges: joined by one task without rounds, and by many tasks and rounds alike."""
    edges = [(i, i + 1) for i in range(1, 3000)] + [(5000, 5000 + i) for i in range(1, 300)] * 2 + [(-7, 9000), (8000, 8000)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    spark.sparkContext.setJobGroup(f"held {held}", "")
    got = {r["node"]: r["root"] for r in components(df, held).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert got == {i: 1 for i in range(1, 3001)} | {i: 5000 for i in range(5000, 5300)} | {-7: -7, 9000: -7}
    if held > len(edges):
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"held {held}")) < 20


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_every_pair_of_bits(spark):
    """One family for each one or two bits that differ, and as many that differ in three: no link is lost, none is made up."""
    g = random.Random(3)
    masks = [1 << i | 1 << j for i in range(64) for j in range(i, 64)]
    near = [(f := g.getrandbits(64), f ^ m) for m in masks]
    apart = [(f := g.getrandbits(64), f ^ sum(1 << b for b in g.sample(range(64), 3))) for _ in masks]
    df = spark.createDataFrame([(signed(f),) for pair in near + apart for f in pair], "fp long")
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df).collect())
    assert got == sorted(tuple(sorted(map(signed, pair))) for pair in near)


def test_crowded_signatures_and_halves(spark):
    """Large signatures in halves that few share, and halves that many share, each with all its links."""
    g = random.Random(4)
    families = [{g.getrandbits(64)} for _ in range(5000)]
    for _ in range(40):
        base = g.getrandbits(64)
        families.append({base, *(base ^ 1 << b for b in g.sample(range(64), 4))})
    same = [g.getrandbits(16) << 16 * h for h in range(4)]
    for i in range(200):
        h = i % 4
        base = g.getrandbits(64) & ~(0xFFFF << 16 * h) | same[h]
        families.append({base, base ^ 1 << g.randrange(64) ^ 1 << g.randrange(64)})
    df = spark.createDataFrame([(signed(f),) for family in families for f in family], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, 2)).collect()}
    got = {signed(f): roots.get(signed(f), signed(f)) for family in families for f in family}
    assert got == {signed(f): min(map(signed, family)) for family in families for f in family}


def test_few_rows_move_for_a_fingerprint(spark):
    """Fingerprints are dealt out by their halves, not by their 64 signatures."""
    n = 60_000
    df = spark.range(n).selectExpr("xxhash64(id) AS fp")
    spark.sparkContext.setJobGroup("moved", "")
    assert simhash.links(df).count() == 0
    spark.sparkContext.setJobGroup("", "")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("moved") for s in tracker.getJobInfo(job).stageIds}
    ran = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s) is not None]
    assert 4 * n <= sum(s.shuffleWriteRecords() for s in ran) <= 10 * n
