"""Cross-site line dedup by distinct-site spread, in DataFrame operations only.

Each line hash gets a HyperLogLog sketch of the sites that it occurs on; sketches merge in partial
aggregation, so a line on millions of pages moves one sketch a task. Lines clearly under the
threshold stay, lines clearly over it are boilerplate, and lines whose estimate is near it get an
exact distinct count. Boilerplate lines are then taken from every document, whatever is left of it;
a caller may choose to leave alone documents that have no other line (copies as a whole).

Up to INLINE boilerplate hashes become a set inside the plan, so texts are cleaned where they are
read; with more of them, lines are joined and their documents' texts meet them by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrid.llm.common import SALTS, cut_lineage, join_small, spare_name

#: Sites on which a line is boilerplate; half-width of the band that is counted exactly, as a share and at least.
SITES, BAND, LEAST_BAND = 10, 0.15, 2
#: log2 of a sketch's registers: 1.6 % standard error at most.
REGISTERS = 12
#: Line hashes that are broadcast (some 20 bytes each); with more of them, lines are dealt out salted.
HASHES = 1_000_000
#: Boilerplate hashes that become a set inside the plan, some 20 bytes each.
INLINE = 20_000
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column) -> Column:
    """A line's identity without the white space around it; null for a blank line."""
    own = F.btrim(line, F.lit(_BLANK))
    return F.when(own != "", F.xxhash64(own))


def _lines_of(docs: DataFrame, *kept: Column) -> DataFrame:
    return docs.select(*kept, F.explode(F.transform(_lines(F.col("text")), _hash)).alias("line")).where(F.col("line").isNotNull())


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(line) hashes that occur on at least `sites` distinct sources; a null source is a site of its own."""
    rows = _lines_of(docs, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("site"))
    band = max(LEAST_BAND, round(BAND * sites))
    spread = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))
    spread = cut_lineage(spread.select("line", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= sites - band))
    near = cut_lineage(spread.where(F.col("n") <= sites + band).select("line"))
    exact = join_small(rows, near, ["line"], HASHES, F.col("site"), "left_semi").distinct().groupBy("line").count().where(F.col("count") >= sites)
    return spread.where(F.col("n") > sites + band).select("line").unionByName(exact.select("line"))


def _marked(docs: DataFrame, bad: DataFrame, hashes: str, gone: str) -> DataFrame:
    """docs (with `hashes` of its lines) with `gone`: whether each line is one of bad's."""
    held = bad.limit(INLINE + 1).toArrow()["line"].to_pylist()
    if not held:
        return docs.withColumn(gone, F.transform(hashes, lambda h: F.lit(False)))
    if len(held) <= INLINE:
        return docs.withColumn(gone, F.expr(f"transform(`{hashes}`, h -> coalesce(h IN ({', '.join(f'{h}L' if h > -(1 << 63) else 'CAST(-9223372036854775808 AS BIGINT)' for h in held)}), false))"))
    key, found = (spare_name(docs, n) for n in ("doc_key", "doc_found"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    named = docs.withColumn(key, F.xxhash64("text", salt))  # a text tells its lines; copies of it are dealt out by id
    marked = join_small(_lines_of(named, F.col(key)), bad, ["line"], HASHES, F.col(key), "left_semi")
    marks = cut_lineage(marked.groupBy(key).agg(F.collect_set("line").alias(found)))  # no more lines than the text has
    both = named.join(marks, key, "left")
    return both.withColumn(gone, F.transform(hashes, lambda h: F.coalesce(F.array_contains(F.col(found), h), F.lit(False)))).drop(key, found)


def without_boilerplate(docs: DataFrame, sites: int = SITES, counts_as: str = "dedup", spare_copies: bool = False) -> DataFrame:
    """docs with text cleaned, and a struct (n_lines, n_removed, chars_removed, left_alone) in a new column.

    Lines are compared without the white space around them; blank lines stay and count for nothing.
    With spare_copies a document of no line but boilerplate is left alone; otherwise it keeps its blank
    lines only. A null text stays null, with no lines; repeated rows and null ids are cleaned like any other;
    a null source is a site of its own; an empty table stays empty.
    """
    lines, hashes, gone, alone = (spare_name(docs, n) for n in ("doc_lines", "doc_hashes", "doc_gone", "doc_alone"))
    df = docs.withColumn(lines, _lines(F.col("text")))
    df = df.withColumn(hashes, F.transform(lines, _hash))
    df = _marked(df, cut_lineage(boilerplate(docs, sites)), hashes, gone)
    real = F.size(F.filter(hashes, lambda h: h.isNotNull())).cast("long")
    many = F.size(F.filter(gone, lambda g: g)).cast("long")
    df = df.withColumn(alone, (many > 0) & (many == real) if spare_copies else F.lit(False))
    cut = (many > 0) & ~F.col(alone)
    chars = F.aggregate(F.zip_with(lines, gone, lambda x, g: F.when(g, F.length(F.btrim(x, F.lit(_BLANK)))).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x)
    zero = F.lit(0).cast("long")
    clean = F.when(cut, F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col(gone), i)), "\n")).otherwise(F.col("text"))
    counts = F.struct(real.alias("n_lines"), F.when(cut, many).otherwise(zero).alias("n_removed"), F.when(cut, chars).otherwise(zero).alias("chars_removed"), F.col(alone).alias("left_alone"))
    return df.withColumn(counts_as, counts).withColumn("text", clean).select(*docs.columns, counts_as)


def report(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, chars_removed and the cleaned text's md5 of each row of docs (null for a null text)."""
    own = without_boilerplate(docs.select("doc_id", "text", "source"), sites)
    return own.select("doc_id", "dedup.n_lines", "dedup.n_removed", "dedup.chars_removed", F.md5("text").alias("text_md5"))


def clean(docs: DataFrame, sites: int = SITES, spare_copies: bool = False) -> DataFrame:
    """docs with text cleaned as by without_boilerplate(), and n_chars, where docs has it, brought up to date."""
    counts = spare_name(docs, "dedup")
    own = without_boilerplate(docs, sites, counts, spare_copies)
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.col(f"{counts}.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return own.select(*docs.columns)


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL
), trimmed AS (
  SELECT doc_id, source, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines
), boilerplate AS (
  SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING COUNT(DISTINCT coalesce('=' || source, '')) >= {SITES}
), sizes AS (
  SELECT t.doc_id, SUM(CASE WHEN b.line IS NULL THEN 0 ELSE length(t.line) END) AS bad, COUNT(*) FILTER (t.line <> '') AS n_lines, COUNT(b.line) AS n_bad
  FROM trimmed t LEFT JOIN boilerplate b ON t.line = b.line GROUP BY t.doc_id
), hits AS (SELECT list(line) AS every FROM boilerplate)
SELECT d.doc_id, CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n_bad, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.bad, 0) AS BIGINT) AS chars_removed,
       md5(CASE WHEN coalesce(s.n_bad, 0) = 0 THEN d.text ELSE
           array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(h.every, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), chr(10)) END) AS text_md5
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id CROSS JOIN hits h
"""
