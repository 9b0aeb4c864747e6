"""Quality rules: robust multivariate outliers per language and source, in DataFrame operations only.

Each document gives counts (words, symbols, repeated lines, repeated eight-word windows, capitals).
Their transformed shares form a vector. The minimum-covariance-determinant estimate of centre and
scatter is sought for every language and source, every language, and all documents: from three starts
(medians and their deviations, scatter of spatial signs, a hashed fifth of the documents) concentration
steps estimate anew from the three quarters with the smallest Mahalanobis distance; the start with the
smallest determinant goes on until its determinant falls no more. Estimates are rescaled for
consistency and reweighted once. A small group's is shrunk towards its language's, and that towards
all documents', so every document is judged. Documents beyond a chi-square quantile are rejected.

Counting runs inside each row; the steps aggregate moments and histograms (so a language or source
of any size combines on the map side), and a group's Cholesky factor is a handful of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrid.llm.common import SPACE, WORD, cut_lineage, join_small, union_all

#: Windows of words that count as repeated, and the base rules' limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of a group's documents that support the estimate; steps of each start, and most steps of the best one.
SUBSET, FIRST, STEPS = 0.75, 2, 12
#: What the determinant's logarithm must fall by to go on; documents that a group's parent counts as; a start's hashed share.
GAIN, SHRINK, PART = 0.01, 50.0, 0.2
#: Coordinates have at least OVER times the variance that counting alone gives such texts.
OVER = 2.0
#: Quantiles of chi-square with five degrees of freedom: 0.5, 0.975, and 1 - 1e-6 for rejection.
MEDIAN, REWEIGHT, REJECT = 4.3515, 12.8325, 35.8882
DIMENSIONS = 5
#: Groups whose estimates (some 200 bytes each) are broadcast; with more of them, rows are dealt out salted.
GROUPS = 20_000


def _repeated_words(words: Column, n: Column) -> list[tuple[str, Column]]:
    """Columns, each on the ones before, that end in n_repeat_words."""
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    found = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows"))
    ordered = F.sort_array(F.transform(F.col("_found"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, k: F.coalesce(F.get(F.col("_ordered"), k)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(F.col("_ordered"), lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"))
    covered = F.aggregate("_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return [("_windows", windows), ("_found", found), ("_ordered", ordered), ("_at", at), ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row's whole text (null: none)."""
    df = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id", "lang", "source",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    kept = ["doc_id", "lang", "source", "n_words", "n_lines", "word_chars", "n_symbols", "n_capitals", "n_dup_lines"]
    df = df.select("*", F.size("_words").alias("_n"), F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    for name, column in _repeated_words(F.col("_words"), F.col("_n")):
        df = df.select(*kept, column.alias(name))
    return df


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_capitals") / chars),
    ]


def _noise() -> list[Column]:
    """The variance of each coordinate of a text that counting alone gives: of a mean of lengths, and of roots of shares."""
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [F.lit(0.25) / words, F.lit(0.25) / chars, F.lit(0.25) / lines, F.lit(0.25 * WINDOW) / words, F.lit(0.25) / chars]  # repeated words come by the window


_D = range(DIMENSIONS)
_PAIRS = [(i, j) for i in _D for j in range(i + 1)]
_X, _M, _F = [f"x{i}" for i in _D], [f"m{i}" for i in _D], [f"f{i}" for i in _D]
_C, _L = [f"c{i}{j}" for i, j in _PAIRS], [f"l{i}{j}" for i, j in _PAIRS]
_G = ["g", "start"]


def _levels() -> list[Column]:
    """Keys of a row's language and source, its language, and all rows; nulls are values of their own."""
    return [F.concat(F.lit("s"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("l"), F.to_json(F.struct("lang"))), F.lit("*")]


def _cut(rows: DataFrame, value: Column, share: float, width: float, also: list[str] | None = None) -> DataFrame:
    """Each group's smallest bin of `value` up to which `share` of its rows lie: (group, also, bin)."""
    by = [*_G, *(also or [])]
    bins = rows.groupBy(*by, F.floor(value / width).alias("bin")).count()
    totals = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("bins"), F.sum("count").alias("n"))
    step = lambda acc, x: F.struct((acc["left"] - x["count"]).alias("left"), F.when(acc["left"] > 0, x["bin"]).otherwise(acc["bin"]).alias("bin"))
    found = F.aggregate("bins", F.struct((F.col("n") * share).alias("left"), F.lit(0).cast("long").alias("bin")), step, lambda acc: acc["bin"])
    return totals.select(*by, found.alias("bin"))


def _moments(rows: DataFrame) -> DataFrame:
    """(g, start, n, m.., c..): count, mean and covariance of rows (g, start, x..)."""
    return rows.groupBy(*_G).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(m) for x, m in zip(_X, _M)], *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i, j in _PAIRS])


def _factored(moments: DataFrame, floors: DataFrame) -> DataFrame:
    """moments with l.., the Cholesky factor of the covariance plus the group's floors (f..), and logdet; written."""
    df = moments.join(floors, "g")
    for i, j in _PAIRS:  # row by row, so each entry needs only earlier ones
        left = F.col(f"c{i}{j}") + (F.col(f"f{i}") if i == j else F.lit(0.0)) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.col(f"f{i}") / 100)) if i == j else left / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in _D), F.lit(0.0))
    return cut_lineage(df.withColumn("logdet", logdet).select(*_G, "n", *_M, *_C, *_L, "logdet"))


def _of_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    return join_small(rows, groups, by, GROUPS, F.struct(*_X))


def _distances(rows: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group's estimate, once for each start of it."""
    kept = list(dict.fromkeys([*by, *_G])) if "start" in estimate.columns else by
    df = _of_group(rows, estimate.select(*kept, *_M, *_L), by)
    for i in _D:
        df = df.withColumn(f"z{i}", (F.col(_X[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.select(*dict.fromkeys([*rows.columns, *kept]), sum((F.col(f"z{i}") ** 2 for i in _D), F.lit(0.0)).alias("d2"))


def _log_distance() -> Column:
    return F.log(F.col("d2") + 1e-6)


def _concentrated(rows: DataFrame, estimate: DataFrame, floors: DataFrame, width: float) -> DataFrame:
    """The estimate from the SUBSET of each group's rows that are nearest by the given one."""
    judged = _distances(rows, estimate, ["g"])
    cut = cut_lineage(_cut(judged, _log_distance(), SUBSET, width))
    near = _of_group(judged, cut, _G).where(F.floor(_log_distance() / width) <= F.col("bin"))
    return _factored(_moments(near), floors)


def _starts(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """Three first estimates of each group."""
    one = rows.withColumn("start", F.lit(0))
    each = one.select(*_G, F.posexplode(F.array(*_X)).alias("i", "x"))
    bins = lambda df, name, scale: _cut(df, F.col("x"), 0.5, 0.005, ["i"]).groupBy("g").pivot("i", list(_D)).agg(F.first((F.col("bin") + 0.5) * 0.005 * scale)).withColumnsRenamed({str(i): f"{name}{i}" for i in _D})
    middle = cut_lineage(bins(each, "m", 1.0))
    apart = _of_group(one, middle, ["g"]).select(*_G, F.posexplode(F.array(*[F.abs(F.col(x) - F.col(m)) for x, m in zip(_X, _M)])).alias("i", "x"))
    spread = cut_lineage(middle.join(bins(apart, "s", 1.4826), "g").join(floors, "g").select("g", *_M, *[F.sqrt(F.col(f"s{i}") ** 2 + F.col(f"f{i}")).alias(f"s{i}") for i in _D]))
    flat = spread.select("g", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), *_M, *[(F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    scaled = _of_group(one, spread, ["g"]).select("g", F.lit(1).alias("start"), *[((F.col(x) - F.col(m)) / F.col(f"s{i}")).alias(x) for i, (x, m) in enumerate(zip(_X, _M))])
    size = F.sqrt(F.greatest(sum((F.col(x) ** 2 for x in _X), F.lit(0.0)), F.lit(1e-12)))
    signs = _moments(scaled.select(*_G, *[(F.col(x) / size).alias(x) for x in _X])).drop(*_M).join(spread, "g")
    signs = signs.select(*_G, "n", *_M, *[(F.col(f"c{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}") * DIMENSIONS).alias(f"c{i}{j}") for i, j in _PAIRS])
    part = _moments(rows.where(F.pmod(F.xxhash64(F.lit("start"), *_X), F.lit(1000)) < int(1000 * PART)).withColumn("start", F.lit(2)))
    return _factored(union_all([flat, signs, part]), floors)


def _smallest(estimates: DataFrame) -> DataFrame:
    """Each group's estimate with the smallest determinant."""
    own = [c for c in estimates.columns if c not in ("g", "logdet")]
    return cut_lineage(estimates.groupBy("g").agg(F.min(F.struct("logdet", *own)).alias("e")).select("g", *[F.col(f"e.{c}").alias(c) for c in (*own, "logdet")]))


def estimates(rows: DataFrame, floors: DataFrame, width: float = 0.01) -> DataFrame:
    """(g, start, n, m.., c.., l.., logdet): the minimum-covariance-determinant estimate of each group of rows (g, x..)."""
    now = _starts(rows, floors)
    for _ in range(FIRST):
        now = _concentrated(rows, now, floors, width)
    best = now = _smallest(now)
    for _ in range(STEPS):
        now = _concentrated(rows, now, floors, width)
        fell = now.select("g", F.col("logdet").alias("new")).join(best.select("g", F.col("logdet").alias("old")), "g").where(F.col("new") < F.col("old") - GAIN)
        more = not fell.isEmpty()
        best = _smallest(best.unionByName(now))
        if not more:
            break
    return best


def _shrunk(own: DataFrame, parents: DataFrame) -> DataFrame:
    """(key.., n, m.., c..): own's moments and SHRINK documents' worth of the parent's, as one population's; the parent's where own has none."""
    both = own.join(parents.select("parent", *[F.col(c).alias(f"p{c}") for c in (*_M, *_C)]), "parent", "left")
    n, k = F.coalesce("n", F.lit(0)), F.when(F.col("pm0").isNull(), F.lit(0.0)).otherwise(F.lit(SHRINK))
    share = F.when(n + k > 0, n / (n + k)).otherwise(F.lit(0.0))
    mix = lambda c: F.when(F.col(c).isNull(), F.col(f"p{c}")).when(F.col(f"p{c}").isNull(), F.col(c)).otherwise(share * F.col(c) + (1 - share) * F.col(f"p{c}"))
    gap = lambda i: F.coalesce(F.col(f"m{i}") - F.col(f"pm{i}"), F.lit(0.0))
    return both.select("g", *[mix(m).alias(m) for m in _M], *[(mix(f"c{i}{j}") + share * (1 - share) * gap(i) * gap(j)).alias(f"c{i}{j}") for i, j in _PAIRS])


def verdicts(counted: DataFrame) -> DataFrame:
    """counted (from statistics()) with base_failed, distance (squared; null where no document passes the base rules, and then none is kept) and kept.

    Base rules fail texts under 20 words or with over 30 % of their words in repeated windows; the
    estimates rest on the others. Null languages and sources are groups of their own; a distance that
    equals the quantile is kept.
    """
    levels = _levels()
    base = counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    own = cut_lineage(base.select("*", *[x.alias(c) for x, c in zip(_vector(), _X)], *[x.alias(c) for x, c in zip(_noise(), _F)], *[g.alias(f"g{i}") for i, g in enumerate(levels)]))
    rows = own.where(~F.col("base_failed")).select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *_X, *_F)
    floors = cut_lineage(rows.groupBy("g").agg(*[(OVER * F.avg(f)).alias(f) for f in _F]))
    if floors.isEmpty():
        return base.select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    rows = rows.select("g", *_X)
    best = estimates(rows, floors)
    judged = _distances(rows, best, ["g"])
    scale = cut_lineage(_cut(judged, _log_distance(), 0.5, 0.02).select(*_G, (F.exp((F.col("bin") + 0.5) * 0.02) / MEDIAN).alias("scale")))
    near = _of_group(judged, scale, _G).where(F.col("d2") <= REWEIGHT * F.greatest("scale", F.lit(1.0)))
    final = cut_lineage(_moments(near).drop("start"))
    named = own.select("g0", "g1", "g2").distinct()
    every = cut_lineage(final.where("g = '*'"))
    langs = named.select(F.col("g1").alias("g"), F.col("g2").alias("parent")).distinct().join(final, "g", "left")
    langs = _shrunk(langs, every.withColumnRenamed("g", "parent"))
    sources = named.select(F.col("g0").alias("g"), F.col("g1").alias("parent")).distinct().join(final, "g", "left")
    shrunk = _shrunk(sources, langs.withColumnRenamed("g", "parent"))
    above = named.select(F.col("g0").alias("g"), "g1").distinct()
    floor = above.join(floors, "g", "left").join(floors.select(F.col("g").alias("g1"), *[F.col(f).alias(f"l{f}") for f in _F]), "g1", "left").join(F.broadcast(floors.where("g = '*'").select(*[F.col(f).alias(f"a{f}") for f in _F])), how="left")
    floor = floor.select("g", *[F.coalesce(f, f"l{f}", f"a{f}").alias(f) for f in _F])
    factored = _factored(shrunk.where("m0 IS NOT NULL").select("g", F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), *_M, *_C), floor)
    judged = _distances(own, factored.withColumnRenamed("g", "g0").drop("start"), ["g0"])
    return judged.select(*base.columns, F.col("d2").alias("distance"), (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= REJECT)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept of each row of docs.

    Null and empty texts have no words and fail the base rules; very long texts count whole; ids are
    carried, null or repeated, and repeated rows have equal results; an empty table stays empty.
    """
    own = verdicts(cut_lineage(statistics(docs)))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
