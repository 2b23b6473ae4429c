"""Mixing sources to target weights by entropy balancing.

The rates r of a source's documents minimise the entropy  sum sqrt(size) * (r log r - r + 1)  under the token constraint
sum size * r = target  and r <= cap. The minimum has the form r = min(cap, exp(lambda * sqrt(size))): documents are tilted
by the square root of their size, so a source that must grow repeats its longer texts rather, one that must shrink drops them
rather, and no length is left out (entropy with the weight 1 would tilt by the size itself and turn the mix into the
longest texts; the weight ``size`` would not tilt at all). lambda is the maximum of the convex dual; its gradient,
sum size * r - target, and its curvature are distributed sums over the documents, taken by source and size. Newton's
steps, kept inside a bracket that every step narrows, go on until the tokens of all sources meet their targets; a row for each
source is all that passes from step to step. Targets share all words by weight; what lies above ``cap`` times a source's size is
shared again (a water level found with prefix sums over the sources).

Rates, in millionths, become whole copies: each document gets floor(rate) copies, and the rest of its rate is its chance of
one more. Inside each class of sizes [2^k, 2^(k+1)) of a source documents are ordered by (hash of the id) / (chance), and the
first ones get that copy, up to the words which the chances of the class add up to: sequential Poisson sampling, whose
prefix sums run over hash buckets of each class, as many as the rows need, so a hot source is many small windows. Last, of each
class the first documents past its cut fill what is missing, largest first. Rows meet their cut by a join with a table of a
row for each source and class; texts are not shuffled.

Defined results: a null text has size 0; documents without words have taken 0 and one copy; null sources are one
source, the last; equal rows get equal copies; no rows give no rows; input columns that have the name of an output column are
replaced, any other name is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read

NEWTON_STEPS = 80
#: Relative difference from the target at which a source has settled.
SETTLED = 1e-12
#: Documents past the cut of each size class that may fill what rounding left.
FILL = 4
#: Rows that a hash bucket of a size class holds at most, were all rows in one class.
BUCKET_ROWS = 10_000
OUT = ("size", "source_size", "target", "rate", "copies", "taken")
#: Rows of a table with a row for each source, or source and size class, up to which it is broadcast; some 100 bytes each. A
#: larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a row for each source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rank = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before, all_rows = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        sizes.withColumn("w", w).withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(all_rows) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(all_rows))
    )
    return level.select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def _rate(lam: Column, size: Column, cap: float) -> Column:
    """min(cap, exp(lambda * sqrt(size))); a null lambda means the cap."""
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(lam * F.sqrt(size.cast("double")))))


def tilts(scratch: Scratch, sizes: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, lam) from documents counted by size, (source, size, n), and their sources' targets. A
    source without words, and one whose target is the cap, has no lambda."""
    x = F.sqrt(F.col("size").cast("double"))
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")  # noqa: E731  the same in any order of the rows
    share = F.col("target") / F.col("source_size")
    sizes = sizes.where("size > 0").withColumnRenamed("source", "s")
    same = F.col("s").eqNullSafe(F.col("source"))
    open_ = goals.where((F.col("source_size") > 0) & (share < cap * (1 - 1e-9)))
    # r >= 1 for all or r <= 1 for all, and sqrt(size) >= 1, so the root lies between 0 and ln(share), or 0 and ln(cap)
    state = sizes.join(_near(open_), same).groupBy("source", "source_size", "target").agg(exact(F.col("n") * F.col("size") * x).alias("spread"))
    state = state.withColumn("lo", F.least(F.log(share), F.lit(0.0))).withColumn("hi", F.when(share < 1, 0.0).otherwise(math.log(cap)))
    first = F.greatest("lo", F.least("hi", F.log(share) * F.col("source_size") / F.col("spread")))
    state = scratch.save(state.select("source", "source_size", "target", "lo", "hi", first.alias("lam"), F.lit(False).alias("settled")))
    for _ in range(NEWTON_STEPS):
        r = _rate(F.col("lam"), F.col("size"), cap)
        words = F.col("n") * F.col("size") * r
        sums = sizes.join(_near(state.where("not settled")), same).groupBy("source", "source_size", "target", "lo", "hi", "lam").agg(
            exact(words).alias("got"), exact(F.when(r < cap, words * x).otherwise(0.0)).alias("curve"),
        )
        lo, hi = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("got") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
        ends = F.abs(F.col("got") - F.col("target")) <= F.lit(SETTLED) * F.col("target")
        newton = F.col("lam") - F.try_divide(F.col("got") - F.col("target"), F.col("curve"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        ends = ends | (hi - lo <= 1e-15)
        new = sums.select("source", "source_size", "target", lo.alias("lo"), hi.alias("hi"), F.when(ends, F.col("lam")).otherwise(step).alias("lam"), ends.alias("settled"))
        old, state = state, scratch.save(state.where("settled").unionByName(new))
        scratch.drop(old)
        if not state.where("not settled").limit(1).count():
            break
    lam = state.select(F.col("source").alias("s"), F.round("lam", 10).alias("lam"))
    return scratch.save(goals.join(lam, same, "left").select("source", "source_size", "target", "lam"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) plus size, source_size, target, rate, copies and taken (= copies * size)."""
    scratch = Scratch(docs.sparkSession, "mix")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(source_col).alias("s"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("md5"), size.alias("size"))
    slim = scratch.save(rows.select("s", "md5", "size"))
    sizes = scratch.save(slim.groupBy(F.col("s").alias("source"), "size").agg(F.count("*").alias("n")))
    goals = tilts(scratch, sizes, scratch.save(source_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)), cap)
    goals = _near(goals)

    def rated(df: DataFrame) -> DataFrame:
        """Adds the whole copies, the millionths left (the chance), the size class and the place in it."""
        out = df.join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("source")
        millionths = F.least(F.lit(int(cap * 1e6)), F.floor(_rate(F.col("lam"), F.col("size"), cap) * 1e6 + 0.5)).cast("long")
        out = out.withColumn("millionths", F.when(F.col("size") > 0, millionths).otherwise(F.lit(1_000_000)))
        out = out.withColumn("whole", F.expr("millionths div 1000000").cast("int")).withColumn("chance", F.col("millionths") % 1_000_000)
        drawn = (F.conv(F.substring("md5", 1, 13), 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 52))
        turn = drawn / (F.col("chance").cast("double") / 1e6)
        place = F.lpad(F.hex(F.floor(turn / (turn + 1.0) * float(1 << 48)).cast("long")), 12, "0")
        out = out.withColumn("class", F.floor(F.log2(F.col("size") + 0.25)).cast("int"))
        return out.withColumn("h", F.when((F.col("size") > 0) & (F.col("chance") > 0), F.concat(place, "md5")))

    digits = 2
    while 16**digits * BUCKET_ROWS < sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        digits += 1
    drawn = rated(slim).where("h is not null").select("s", "class", "h", F.substring("h", 1, digits).alias("b"), "size", (F.col("chance") * F.col("size")).alias("part"))
    drawn = scratch.save(drawn)
    by_class = Window.partitionBy("s", "class")
    totals = drawn.groupBy("s", "class", "b").agg(F.sum("size").alias("n"), F.sum("part").alias("part"))
    totals = totals.select("s", "class", "b", (F.sum("n").over(by_class.orderBy("b")) - F.col("n")).alias("n0"), F.expr("sum(part) over (partition by s, class) div 1000000").alias("extra"))
    totals = scratch.save(totals.toDF("ts", "tc", "tb", "n0", "extra"))
    here = drawn.join(totals, drawn["s"].eqNullSafe(F.col("ts")) & (F.col("class") == F.col("tc")) & (F.col("b") == F.col("tb"))).drop("ts", "tc", "tb")
    inside = Window.partitionBy("s", "class", "b")
    upto = F.col("n0") + F.sum("size").over(inside.orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    run = here.withColumn("upto", upto).withColumn("own", F.sum("size").over(Window.partitionBy("s", "class", "b", "h")))
    past = F.col("upto") > F.col("extra")
    cuts = run.groupBy("s", "class").agg(F.max(F.when(~past, F.col("h"))).alias("cut"), F.coalesce(F.max(F.when(~past, F.col("upto"))), F.lit(0)).alias("got"))
    # the first documents past each cut: FILL of each bucket, of those FILL of each class
    after = run.where(past).select("s", "class", "b", "h", "own", F.row_number().over(inside.orderBy("h")).alias("k")).where(F.col("k") <= FILL)
    after = after.select("s", "class", "h", "own").distinct().withColumn("k", F.row_number().over(by_class.orderBy("h"))).where(F.col("k") <= FILL)
    after = after.groupBy(F.col("s").alias("as"), F.col("class").alias("ac")).agg(F.collect_list(F.struct("own", "h")).alias("next"))
    cuts = scratch.save(cuts.join(after, cuts["s"].eqNullSafe(F.col("as")) & (F.col("class") == F.col("ac")), "left").drop("as", "ac"))
    # FILL candidates a class and some forty classes: the array is bounded
    due = drawn.groupBy("s").agg(F.expr("sum(part) div 1000000").alias("due")).withColumnRenamed("s", "ds")
    filled = cuts.groupBy("s").agg(F.sum("got").alias("got"), F.reverse(F.array_sort(F.flatten(F.collect_list("next")))).alias("cand"))
    filled = filled.join(due, filled["s"].eqNullSafe(F.col("ds"))).withColumn("left", F.col("due") - F.col("got"))
    filled = filled.withColumn("picked", F.aggregate(
        "cand", F.struct(F.col("left").alias("left"), F.array().cast("array<string>").alias("h")),
        lambda a, x: F.when(x["own"] <= a["left"], F.struct((a["left"] - x["own"]).alias("left"), F.concat(a["h"], F.array(x["h"])).alias("h"))).otherwise(a),
    )["h"]).select(F.col("s").alias("fs"), "picked")
    plan = cuts.join(filled, cuts["s"].eqNullSafe(F.col("fs")), "left")
    plan = scratch.save(plan.select(F.col("s").alias("ps"), F.col("class").alias("pc"), "cut", F.array_intersect("picked", F.col("next.h")).alias("fill")))

    out = rated(rows)
    out = out.join(_near(plan), out["s"].eqNullSafe(F.col("ps")) & (F.col("class") == F.col("pc")), "left")
    more = (F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("fill", F.col("h")), F.lit(False))).cast("int")
    out = out.withColumn("copies", F.col("whole") + more)
    return out.select("kept.*", "size", "source_size", "target", (F.col("millionths") / F.lit(1e6)).alias("rate"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH RECURSIVE b AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1) AS w FROM b GROUP BY source),
l AS (SELECT *, 3.0 * ss / w AS ratio FROM s),
l2 AS (SELECT *, ((sum(ss) OVER ())::DOUBLE - 3.0 * coalesce(sum(ss) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM l),
l3 AS (SELECT *, first_value(CASE WHEN lv <= ratio THEN lv END IGNORE NULLS) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM l2),
g AS (SELECT source, ss, least(3.0 * ss, lev * w)::DOUBLE AS target, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM l3),
z AS (SELECT g.k, size::DOUBLE AS size, sqrt(size::DOUBLE) AS x, count(*)::DOUBLE AS n FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source WHERE size > 0 GROUP BY ALL),
o AS (SELECT k, target, CASE WHEN target < ss THEN ln(target / ss) ELSE 0.0 END AS lo, CASE WHEN target < ss THEN 0.0 ELSE ln(3.0) END AS hi FROM g WHERE ss > 0 AND target / ss < 3.0 * (1 - 1e-9)),
it(k, target, lo, hi, i) AS (SELECT k, target, lo, hi, 0 FROM o UNION ALL
  SELECT k, target, CASE WHEN got < target THEN mid ELSE lo END, CASE WHEN got < target THEN hi ELSE mid END, i + 1 FROM (
    SELECT it.k, it.target, it.lo, it.hi, it.i, (it.lo + it.hi) / 2 AS mid, sum(z.n * z.size * least(3.0, exp((it.lo + it.hi) / 2 * z.x))) AS got
    FROM it JOIN z ON it.k = z.k WHERE it.i < 60 GROUP BY it.k, it.target, it.lo, it.hi, it.i)),
m AS (SELECT k, round((lo + hi) / 2, 10) AS lam FROM it WHERE i = 60),
r AS (SELECT b.*, g.ss, g.target, CASE WHEN size = 0 THEN 1000000 WHEN lam IS NULL THEN 3000000 ELSE least(3000000, floor(least(3.0, exp(lam * sqrt(size::DOUBLE))) * 1e6 + 0.5)) END::BIGINT AS mi, floor(log2(size + 0.25))::INT AS c
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source LEFT JOIN m ON m.k = g.k),
u AS (SELECT *, mi % 1000000 AS chance, (list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 14), lambda i: (strpos('0123456789abcdef', h[i]) - 1)::BIGINT)), lambda a, d: a * 16 + d) + 1)::DOUBLE / 4503599627370496.0 AS drawn FROM r),
t AS (SELECT *, CASE WHEN size > 0 AND chance > 0 THEN lpad(printf('%X', floor(drawn / (chance::DOUBLE / 1e6) / (drawn / (chance::DOUBLE / 1e6) + 1.0) * 281474976710656.0)::BIGINT), 12, '0') || h END AS p FROM u),
d AS (SELECT *, sum(size) OVER (PARTITION BY source, c ORDER BY p) AS upto, sum(size) OVER (PARTITION BY source, c, p) AS own, (sum(chance * size) OVER (PARTITION BY source, c)) // 1000000 AS extra FROM t WHERE p IS NOT NULL),
k AS (SELECT source, c, max(p) FILTER (upto <= extra) AS cut, coalesce(max(upto) FILTER (upto <= extra), 0)::BIGINT AS got FROM d GROUP BY source, c),
n AS (SELECT source, own::BIGINT AS own, p FROM (SELECT DISTINCT source, c, p, own FROM d WHERE upto > extra) QUALIFY row_number() OVER (PARTITION BY source, c ORDER BY p) <= 4),
nl AS (SELECT source, list({'own': own, 'h': p} ORDER BY own DESC, p DESC) AS cand FROM n GROUP BY source),
due AS (SELECT source, (sum(chance * size) // 1000000)::BIGINT AS due FROM d GROUP BY source),
f AS (SELECT k.source, (any_value(due.due) - sum(got))::BIGINT AS lft, any_value(nl.cand) AS cand
  FROM k JOIN due ON k.source IS NOT DISTINCT FROM due.source LEFT JOIN nl ON nl.source IS NOT DISTINCT FROM k.source GROUP BY k.source),
e AS (SELECT source, list_reduce(list_prepend({'own': lft, 'hs': []::VARCHAR[]}, list_transform(coalesce(cand, []), lambda x: {'own': x.own, 'hs': [x.h]})),
  lambda a, x: CASE WHEN x.own <= a.own THEN {'own': a.own - x.own, 'hs': list_concat(a.hs, x.hs)} ELSE a END).hs AS hs FROM f)
SELECT t.doc_id, t.size, t.ss AS source_size, round(t.target, 6) AS target,
  ((t.mi // 1000000 + CASE WHEN coalesce(t.p <= k.cut, false) OR coalesce(list_contains(e.hs, t.p), false) THEN 1 ELSE 0 END) * t.size)::BIGINT AS taken
FROM t LEFT JOIN k ON t.source IS NOT DISTINCT FROM k.source AND t.c = k.c LEFT JOIN e ON e.source IS NOT DISTINCT FROM t.source
"""
