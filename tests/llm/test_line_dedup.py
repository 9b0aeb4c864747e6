import hashlib

import duckdb
import pytest

from zonegrid.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def slow(rows, sites):
    where = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if line.strip(BLANK):
                where.setdefault(line.strip(BLANK), set()).add(r["source"])
    bad = {k for k, v in where.items() if len(v) >= sites}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        own = [x for x in lines if x.strip(BLANK)]
        gone = [x for x in own if x.strip(BLANK) in bad]
        text = "\n".join(x for x in lines if x.strip(BLANK) not in bad) if gone else r["text"]
        out.append((r["doc_id"], len(own), len(gone), sum(len(x.strip(BLANK)) for x in gone), None if text is None else hashlib.md5(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sites", [2, 5, 10])
def test_against_brute_force(spark, sf, sites):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, line_dedup.report(docs, sites).collect()), key=repr) == slow(docs.collect(), sites)


def test_many_sites(spark):
    rows = [(i, f"own line {i} of some length to keep\nshared by all\n \nof {i % 40}\nseen on {i % 7}", "en", f"s{i % 90}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for sites in (6, 15, 90):
        assert sorted(map(tuple, line_dedup.report(docs, sites).collect()), key=repr) == slow(docs.collect(), sites)


def test_odd_rows(odd_docs, no_docs):
    assert sorted(map(tuple, line_dedup.report(odd_docs, 2).collect()), key=repr) == slow(odd_docs.collect(), 2)
    cleaned = line_dedup.clean(odd_docs, 2)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count()
    assert line_dedup.clean(no_docs).count() == line_dedup.report(no_docs).count() == 0
    assert line_dedup.clean(odd_docs.drop("n_chars"), 2).count() == odd_docs.count()


SHARED = "a long passage that very many sites repeat " * 12


def mostly_shared(spark):
    rows = [(i, f"own {i}\n \n{SHARED}\n  {SHARED}\nsigned {i}", "en", f"s{i}", 1) for i in range(20)] + [(99, f"{SHARED}\n\n{SHARED}", "en", "s1", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_document_is_cleaned(spark):
    """Whatever the share of boilerplate in it."""
    _, docs = mostly_shared(spark)
    got = {r["doc_id"]: r for r in line_dedup.clean(docs).collect()}
    assert all(got[i]["text"] == f"own {i}\n \nsigned {i}" and got[i]["n_chars"] == len(got[i]["text"]) for i in range(20))
    assert got[99]["text"] == "" and got[99]["n_chars"] == 0
    told = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert told[99]["n_removed"] == 2 and told[99]["chars_removed"] == 2 * len(SHARED.strip())


def test_copies_may_be_spared(spark):
    rows, docs = mostly_shared(spark)
    got = {r["doc_id"]: r for r in line_dedup.clean(docs, spare_copies=True).collect()}
    assert all(got[i]["text"] == f"own {i}\n \nsigned {i}" for i in range(20))
    assert got[99]["text"] == rows[20][1] and got[99]["n_chars"] == 2


def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, line_dedup.report(docs).collect()), key=repr) == sorted(c.execute(line_dedup.SQL).fetchall(), key=repr)


def test_salted_joins_give_the_same(spark, sf, monkeypatch):
    monkeypatch.setattr(line_dedup, "HASHES", 0)
    monkeypatch.setattr(line_dedup, "INLINE", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, line_dedup.report(docs, 5).collect()), key=repr) == slow(docs.collect(), 5)


def test_many_hashes_give_the_same(spark, sf, odd_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "INLINE", 0)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        assert sorted(map(tuple, line_dedup.report(docs, 2).collect()), key=repr) == slow(docs.collect(), 2)


def test_texts_are_not_shuffled(spark, sf, capsys):
    line_dedup.report(spark.read.parquet(f"{sf}/documents.parquet"), 5).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan
