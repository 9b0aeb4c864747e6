"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent
is bisected: the largest that still reaches a target entropy (above 1 where the sources' own entropy
is higher), moved towards 1 where a source would be repeated more often than a limit. A budget of
tokens is then dealt out by weight. A source whose part exceeds
its tokens is gone through in several epochs, each in its own random order (by a hash of seed, epoch
and id); the last epoch stops where the part is met. Progress through its part places each use of a
document in one of the mixture's blocks, so every block holds all sources in proportion, and inside
a block the order is random again.

The running token counts along those orders are found in two steps, over hash buckets and inside
them: no task sorts a source, as a source of n documents has about sqrt(n) buckets of sqrt(n).
Equal rows (id, source and text) are numbered, so that they are spread over buckets like any others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonegrid.llm.common import WORD, cut_lineage, join_small, spare_name

#: Share of the largest possible entropy to reach, epochs a source may take, tokens a block.
ENTROPY, REPEATS, BLOCK = 0.97, 4.0, 1_000_000
#: Sources whose plan (some 100 bytes each) is broadcast; with more of them, rows are dealt out salted.
SOURCES = 100_000
#: Sources whose shares the bisection holds on the driver.
FEW = 10_000
#: Halvings of the exponent's interval; its upper end doubles from 1 up to HIGHEST.
HALVINGS, HIGHEST = 40, 32.0
#: Entropy that may be missing by rounding.
_SLACK = 1e-12
SEED = "mix"


@dataclass(frozen=True)
class Target:
    """What the mixture aims at. entropy and repeats may each be None. The budget is in tokens, or `share`
    times the sources' own; without either the mixture is the smallest one that uses every document.
    A budget above `repeats` times all tokens can't keep the limit: sources then keep their own shares."""

    entropy: float | None = ENTROPY
    repeats: float | None = REPEATS
    budget: int | None = None
    block: int = BLOCK
    share: float | None = None

    def tokens(self, total: int) -> int | None:
        """The budget for sources of `total` tokens."""
        return self.budget if self.budget is not None or self.share is None else math.floor(self.share * total + 0.5)


def tokens(text: Column) -> Column:
    """Words of a text, the unit of budgets; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bisect(holds: Callable[[float], bool], low: float, high: float) -> float:
    """The largest x found in [low, high] for which holds, which is true up to some point."""
    if holds(high):
        return high
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent(shares: DataFrame, target: Target, budget: float | None) -> float:
    """The exponent for shares (p): a number of sums over sources.

    Up to FEW sources' shares come to the driver for that; with more of them Spark adds up.

    The entropy falls as the exponent rises from 0. The most often repeated source has the smallest
    share below exponent 1 and the largest one above; its epochs are weight times budget over tokens,
    and fall towards 1.
    """
    n, p_min, p_max, total = shares.agg(F.count("p"), F.min("p"), F.max("p"), F.max("total")).first()
    if not n:
        return 1.0

    few = [r["p"] for r in shares.select("p").collect()] if n <= FEW else None

    def sums(a: float) -> tuple[float, float]:
        if few is not None:
            return math.fsum(p**a for p in few), math.fsum(p**a * math.log(p) for p in few)
        power = F.pow("p", F.lit(a))
        return tuple(shares.agg(F.sum(power), F.sum(power * F.log("p"))).first())

    def entropy(a: float) -> float:
        z, s = sums(a)
        return math.log(z) - a * s / z

    def epochs(a: float) -> float:
        if budget is None:
            return (p_max / p_min) ** abs(1 - a)
        return budget / total * max(p_min ** (a - 1), p_max ** (a - 1)) / sums(a)[0]

    best = 1.0
    if target.entropy is not None and n > 1:
        goal = min(target.entropy, 1.0) * math.log(n) - _SLACK
        low, high = 0.0, 1.0
        while high < HIGHEST and entropy(high) >= goal:
            low, high = high, 2 * high
        best = bisect(lambda a: entropy(a) >= goal, low, high)
    if target.repeats is not None and best != 1 and epochs(best) > target.repeats:
        side = 1.0 if best > 1 else -1.0
        best = 1.0 + side * bisect(lambda x: epochs(1.0 + side * x) <= target.repeats, 0.0, abs(best - 1.0))
    return best


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """(site, own, part, weight, buckets): each source's tokens, its part of the budget and its weight.

    Sources without a token have part and weight 0. A null source is a source of its own.
    """
    totals = cut_lineage(docs.groupBy(_site(F.col("source")).alias("site")).agg(F.sum("n_tokens").alias("own"), F.count(F.lit(1)).alias("n")))
    total = totals.agg(F.sum("own")).first()[0] or 0
    shares = totals.where("own > 0").select("site", "own", (F.col("own") / F.lit(float(total))).alias("p"), F.lit(float(total)).alias("total"))
    asked = target.tokens(total)
    a = exponent(shares, target, asked)
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.col("own") / F.pow("p", F.lit(a)))).first()
    budget = float(asked) if asked is not None else (least or 0.0) * (z or 0.0)
    weight = F.when(F.col("own") > 0, F.pow(F.col("own") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    part = F.floor(weight * F.lit(budget) + 0.5)
    part = F.greatest(part, F.col("own")) if asked is None else part
    return cut_lineage(totals.select("site", "own", part.cast("long").alias("part"), weight.alias("weight"), F.greatest(F.lit(1), F.floor(F.sqrt("n"))).alias("buckets")))


def _site(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, site, n_tokens, tie, occ): docs without texts, written; tie is the text's hash, occ numbers equal rows from 0."""
    tie = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "source", _site(F.col("source")).alias("site"), tokens(F.col("text")).alias("n_tokens"), tie.alias("tie"), F.spark_partition_id().alias("pid"))
    return _numbered(cut_lineage(rows), ["doc_id", "site", "tie"], "pid", "occ").drop("pid")


def _numbered(rows: DataFrame, by: list[str], pid: str, occ: str) -> DataFrame:
    """rows (written already, pid telling the partition) with occ: the number, from 0, of a row among those equal in `by`.

    Without equal rows that is 0. Otherwise a row's number is how many earlier partitions hold plus its
    place in its own, so a row that is repeated without end is counted in as many tasks as hold it.
    """
    if rows.groupBy(*by).count().where("count > 1").isEmpty():
        return rows.withColumn(occ, F.lit(0).cast("long"))
    key, at, before = (spare_name(rows, n) for n in ("row_key", "row_at", "row_before"))
    keyed = rows.withColumn(key, F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])))
    ahead = F.sum("count").over(Window.partitionBy(key).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1))
    counts = keyed.groupBy(key, pid).agg(F.count(F.lit(1)).alias("count")).select(key, pid, F.coalesce(ahead, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(key, pid).orderBy(key)) - 1
    return keyed.withColumn(at, place).join(counts, [key, pid]).withColumn(occ, (F.col(before) + F.col(at)).cast("long")).drop(key, at, before)


def _order(epoch: Column, doc_id: Column, tie: Column, occ: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")), tie, occ.cast("string")))


def _unit(order: Column) -> Column:
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _used(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (of _rows()) by epoch, with `before`: tokens of the source that come before the use."""
    epochs = F.when(F.col("own") > 0, F.ceil(F.col("part") / F.col("own"))).otherwise(0).cast("long")
    df = join_small(rows, plan, ["site"], SOURCES, F.struct("doc_id", "tie", "occ")).withColumn("epochs", epochs).where("epochs > 0")
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).drop("epochs")
    df = df.withColumn("order", _order(F.col("epoch"), F.col("doc_id"), F.col("tie"), F.col("occ")))
    df = df.withColumn("bucket", F.floor(_unit(F.col("order")) * F.col("buckets")))
    by = ["site", "epoch", "bucket"]
    sums = df.groupBy(*by).agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy("site", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*by, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*by).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("epoch") * F.col("own") + F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return df.join(ahead, by).withColumn("before", before).where("before < part")


def mixture(docs: DataFrame, target: Target) -> DataFrame:
    """One row for each use of a document: doc_id, source, epoch, n_tokens, weight, block and place.

    place numbers a block's uses from 1. Documents that a part's end cuts off are used; the next are
    not. A document without a token (null and empty texts too) is used where its turn comes; one from a
    source without any is not. Repeated rows and null ids are documents of their own, null sources a
    source of their own; an empty table gives no rows.
    """
    rows = cut_lineage(_rows(docs))
    parts = plan(rows, target)
    blocks = max(1, math.ceil((parts.agg(F.sum("part")).first()[0] or 0) / target.block))
    used = _used(rows, parts).withColumn("block", F.floor(F.col("before") / F.col("part") * F.lit(float(blocks))))
    mixed = F.md5(F.concat_ws(":", F.lit("block"), "order", "site"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(mixed))
    return used.select("doc_id", "source", "epoch", "n_tokens", "weight", "block", place.cast("long").alias("place"))


def mixed(docs: DataFrame, target: Target) -> DataFrame:
    """docs with each row as often as the mixture uses it, in no order of blocks: mixture() tells that.

    The uses are mixture()'s, found by one cut in each source's last epoch, so texts don't move: a source's
    table of hash buckets shows the bucket where its part ends, and that bucket the last row used. Null
    ids and repeated rows are cut one by one; where rows repeat, texts do move, to be numbered. A row whose
    source has no token is not used; an empty table stays empty.
    """
    site, n, edge, tie, occ, pid = (spare_name(docs, s) for s in ("site", "epochs", "edge", "tie", "occ", "pid"))
    rows = cut_lineage(_rows(docs))
    parts = plan(rows, target)
    last = parts.where("own > 0").withColumn("whole", F.floor(F.col("part") / F.col("own")))
    spread = F.struct("doc_id", "tie", "occ")
    partial = join_small(rows.drop("source"), cut_lineage(last.where("part > whole * own")), ["site"], SOURCES, spread).withColumn("epoch", F.col("whole"))
    partial = partial.withColumn("order", _order(F.col("epoch"), F.col("doc_id"), F.col("tie"), F.col("occ"))).withColumn("bucket", F.floor(_unit(F.col("order")) * F.col("buckets")))
    by = ["site", "bucket"]
    sums = partial.groupBy(*by).agg(F.sum("n_tokens").alias("n"), F.max(F.col("part") - F.col("whole") * F.col("own")).alias("rest"))
    run = Window.partitionBy("site").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    final = sums.withColumn("ahead", F.coalesce(F.sum("n").over(run), F.lit(0))).where("ahead < rest").groupBy("site").agg(F.max(F.struct("bucket", "ahead", "rest")).alias("b")).select("site", "b.*")
    inside = Window.partitionBy("site").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    cut = join_small(partial.select("site", "bucket", "order", "n_tokens", "doc_id", "tie", "occ"), cut_lineage(final), by, SOURCES, spread).withColumn("before", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    cut = cut.where("before < rest").groupBy("site").agg(F.max("order").alias("edge"))
    cuts = cut_lineage(last.join(cut, "site", "left").select(F.col("site").alias(site), F.col("whole").alias(n), F.col("edge").alias(edge)))
    own = docs.withColumns({site: _site(F.col("source")), tie: F.md5(F.coalesce("text", F.lit("")))})
    if rows.where("occ > 0").isEmpty():
        own = own.withColumn(occ, F.lit(0).cast("long"))
    else:
        own = _numbered(cut_lineage(own.withColumn(pid, F.spark_partition_id())), ["doc_id", site, tie], pid, occ)
    df = join_small(own, cuts, [site], SOURCES, F.struct("doc_id", tie, occ))
    also = F.coalesce((_order(F.col(n), F.col("doc_id"), F.col(tie), F.col(occ)) <= F.col(edge)).cast("long"), F.lit(0))
    times = F.col(n) + also
    return df.withColumn(n, times).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def sql(target: Target) -> str:
    """DuckDB SQL for mixture() over documents: an entropy target and, if there is one, a repetition limit."""
    given = target.budget is not None or target.share is not None
    asked = target.budget if target.budget is not None else f"floor({target.share} * total + 0.5)"
    z = lambda a: f"SUM(pow(p, {a}))"
    entropy = lambda a: f"(SELECT ln({z(a)}) - {a} * SUM(pow(p, {a}) * ln(p)) / {z(a)} FROM shares)"
    epochs = lambda a: f"({asked} / total * greatest(pow(least_p, {a} - 1), pow(most_p, {a} - 1)) / (SELECT {z(a)} FROM shares))" if given else f"pow(most_p / least_p, abs(1 - {a}))"
    limit = f"{target.repeats}" if target.repeats is not None else "CAST('inf' AS DOUBLE)"
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, site, tie) - 1 AS occ FROM (
    SELECT doc_id, source, coalesce('=' || source, '') AS site, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens,
           md5(coalesce(text, '')) AS tie FROM documents)
), totals AS MATERIALIZED (
  SELECT site, CAST(SUM(n_tokens) AS BIGINT) AS own FROM docs GROUP BY site
), shares AS MATERIALIZED (
  SELECT site, own, own / CAST((SELECT SUM(own) FROM totals) AS DOUBLE) AS p FROM totals WHERE own > 0
), facts AS MATERIALIZED (
  SELECT {target.entropy} * ln(COUNT(*)) - {_SLACK} AS h, MIN(p) AS least_p, MAX(p) AS most_p, (SELECT CAST(SUM(own) AS DOUBLE) FROM totals) AS total FROM shares
), ends AS MATERIALIZED (
  SELECT coalesce(MIN(high) FILTER (e < h), {HIGHEST}) AS high FROM (SELECT CAST(high AS DOUBLE) AS high, {entropy('high')} AS e, h FROM facts, (SELECT UNNEST([{', '.join(str(float(1 << i)) for i in range(int(math.log2(HIGHEST)) + 1))}]) AS high))
), search AS (
  SELECT 0 AS i, CASE WHEN high = 1 THEN CAST(0 AS DOUBLE) ELSE high / 2 END AS low, high FROM ends
  UNION ALL
  SELECT i + 1, CASE WHEN e >= h THEN (low + high) / 2 ELSE low END, CASE WHEN e >= h THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, {entropy('((low + high) / 2)')} AS e, h FROM search, facts WHERE i < {HALVINGS})
), reached AS MATERIALIZED (
  SELECT CASE WHEN (SELECT {entropy('ends.high')} >= h FROM ends, facts) THEN (SELECT high FROM ends) ELSE low END AS a FROM search WHERE i = {HALVINGS}
), limits AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, abs(a - 1) AS high, CASE WHEN a > 1 THEN 1 ELSE -1 END AS side FROM reached
  UNION ALL
  SELECT i + 1, CASE WHEN e <= {limit} THEN (low + high) / 2 ELSE low END, CASE WHEN e <= {limit} THEN high ELSE (low + high) / 2 END, side
  FROM (SELECT i, low, high, side, {epochs('(1 + side * (low + high) / 2)')} AS e FROM limits, facts WHERE i < {HALVINGS})
), alpha AS MATERIALIZED (
  SELECT CASE WHEN {epochs('reached.a')} <= {limit} THEN reached.a ELSE 1 + side * low END AS a FROM reached, facts, limits WHERE i = {HALVINGS}
), budget AS (SELECT CAST({f'(SELECT {asked} FROM facts)' if given else '(SELECT MAX(own / pow(p, a)) * SUM(pow(p, a)) FROM shares, alpha)'} AS DOUBLE) AS b
), parts AS MATERIALIZED (
  SELECT site, own, pow(p, a) / (SELECT SUM(pow(p, a)) FROM shares) AS weight,
         CAST({'floor' if given else 'greatest'}({'' if given else 'own, floor('}pow(p, a) / (SELECT SUM(pow(p, a)) FROM shares) * b + 0.5){'' if given else ')'} AS BIGINT) AS part
  FROM shares, alpha, budget
), uses AS (
  SELECT d.*, p.own, p.part, p.weight, e.epoch, md5(concat_ws(':', '{SEED}', CAST(e.epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'), tie, CAST(occ AS VARCHAR))) AS ord
  FROM docs d JOIN parts p USING (site), LATERAL (SELECT UNNEST(range(CAST(ceil(p.part / CAST(p.own AS DOUBLE)) AS BIGINT))) AS epoch) e
), runs AS (
  SELECT *, epoch * own + coalesce(SUM(n_tokens) OVER (PARTITION BY site, epoch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM uses
), blocks AS (SELECT greatest(1, ceil(SUM(part) / CAST({target.block} AS DOUBLE))) AS n FROM parts
), placed AS (
  SELECT doc_id, source, site, epoch, n_tokens, weight, ord, CAST(floor(CAST(before AS DOUBLE) / CAST(part AS DOUBLE) * n) AS BIGINT) AS block FROM runs, blocks WHERE before < part
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, n_tokens, round(weight, 9) AS weight, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws(':', 'block', ord, site))) AS BIGINT) AS place
FROM placed
"""
