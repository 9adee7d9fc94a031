"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source has a target of words. Among all rates per document that meet it and stay within
``limit``, the one nearest to one copy of each document in relative entropy is
``min(limit, exp(lambda * size / mean))``, where the source's lambda solves the convex dual. Newton
iterations find all sources' lambdas together; each is one aggregate over the histogram of (source,
size), whose rows stand for all documents of that size, guarded by brackets that halve when a step would
leave them. Rates become copies without drift: sizes in falling order pass on what they have
rounded away, so that a source ends within about its smallest document of its target, and within a
size the documents that get a copy more are those of smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, n_words

#: Words taken over all words, most copies of a document, weights of the sources in order, repeating.
SHARE, LIMIT, WEIGHTS = 1.5, 2, (5, 2, 1)
#: Relative error of a source's words at which Newton iterations end, and most of them.
CLOSE, ROUNDS = 1e-6, 60
#: Least number of parts by hash into which the documents of one source and size are dealt, and documents for each part more.
PARTS, PART = 64, 200_000
#: Digits to which a lambda is rounded, so that sums in another order give the same rates.
DIGITS = 9


def source_targets(sizes: DataFrame, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, capped at ``limit`` times the size.

    The excess goes to the others by weight until none is above its cap: every target is the smaller of
    its cap and weight times one level. The level stands at the first source, in order of cap over weight,
    that it leaves uncapped. Sources are ordered by code point, null last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double")
    cap = F.col("source_size").cast("double") * limit
    t = sizes.withColumn("weight", weight).withColumn("cap", cap)
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", rest / left)
    t = t.withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def dual_rates(histogram: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``targets`` with ``tilt``: the lambda of each source; null where every document is taken ``limit`` times."""
    full = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    state = targets.withColumn("full", full).withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    state = cut(state.join(histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean")).withColumnRenamed("source", "_s"), _same(F.col("source"), F.col("_s"))).drop("_s"), "dual")
    x = F.col("size") / F.greatest("mean", F.lit(1e-9))
    free = F.col("tilt") * x < F.log(F.lit(float(limit)))
    words = F.col("n") * F.col("size") * F.when(free, F.exp(F.col("tilt") * x)).otherwise(float(limit))
    rows = histogram.select(F.col("source").alias("_s"), "size", "n").where("size > 0")
    for _ in range(ROUNDS):
        sums = rows.join(state.where("not full"), _same(F.col("_s"), F.col("source"))).groupBy("_s").agg(F.sum(words).alias("got"), F.sum(F.when(free, words * x)).alias("slope"))
        new = state.join(sums, _same(F.col("source"), F.col("_s")), "left").drop("_s")
        error = F.col("got") - F.col("target")
        new = new.withColumn("error", F.coalesce(error / F.greatest("target", F.lit(1.0)), F.lit(0.0)))
        new = new.withColumn("low", F.when(F.col("error") < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("error") > 0, F.least("high", "tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.try_divide(error, F.col("slope"))
        inside = step.isNotNull() & (step > F.coalesce("low", F.lit(float("-inf")))) & (step < F.coalesce("high", F.lit(float("inf")))) & (F.abs(step - F.col("tilt")) <= 4 + F.abs("tilt"))
        halved = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("tilt", F.when(F.abs("error") <= CLOSE, F.col("tilt")).when(inside, step).otherwise(halved))
        new = cut(new.select(*state.columns, "error"), "dual")
        worst = new.agg(F.max(F.abs("error"))).first()[0]
        drop_cut(state)
        state = new.drop("error")
        if worst is None or worst <= CLOSE:
            break
    return state.select("source", "source_size", "target", "mean", F.when(~F.col("full"), F.round("tilt", DIGITS)).alias("tilt"))


def _rounded(limit: int) -> Column:
    """Folds a source's cells, largest size first, into (size, copies): each gets its expected words and what those before it were short of."""
    # `left` holds the words still owed; a cell of n documents of one size takes a whole number of copies, at most limit * n.
    step = f"""
        aggregate(cells, cast(named_struct('owed', 0D, 'out', array()) as struct<owed: double, out: array<struct<size: bigint, copies: bigint>>>),
            (s, c) -> named_struct(
                'owed', s.owed + c.n * c.rate * c.size - c.size * least(greatest(round((s.owed + c.n * c.rate * c.size) / c.size), 0D), {limit}D * c.n),
                'out', concat(s.out, array(named_struct('size', c.size, 'copies', cast(least(greatest(round((s.owed + c.n * c.rate * c.size) / c.size), 0D), {limit}D * c.n) as bigint))))),
            s -> s.out)"""
    return F.expr(step)


def mix_sources(docs: DataFrame, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS, keep: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, rate, copies, taken.

    A null or wordless text has size 0, rate 1 and one copy, which takes no words. A null source is a source,
    the last. Rows repeated under one doc_id share a hash and are told apart by size and place alone, so their
    copies may fall on any of them. Other columns are ignored, or with ``keep`` passed on in a struct _row. An empty table gives an
    empty table.
    """
    kept = [F.struct(*docs.columns).alias("_row")] if keep else []
    docs = docs.select(*kept, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    docs = cut(docs.withColumn("hash", F.xxhash64("doc_id", "size")).withColumn("id", F.monotonically_increasing_id()), "sizes")
    rows = docs.select("id", "_row") if keep else None
    docs = docs.select("id", "doc_id", "source", "size", "hash")
    # Were all documents of one source and size, a part would still have no more than about ``PART`` of them.
    docs = docs.withColumn("part", F.pmod("hash", F.lit(PARTS + docs.count() // PART)).cast("int"))
    parts = cut(docs.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "parts")
    histogram = cut(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    known = dual_rates(histogram, cut(source_targets(sizes, share, limit, weights), "targets"), limit).withColumnRenamed("source", "_s")
    # The shorter table names every source once; Spark broadcasts it where its measured size allows.
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(limit)).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.greatest("mean", F.lit(1e-9)), F.lit(5.0))), F.lit(float(limit))))
    cells = histogram.join(known, _same(F.col("source"), F.col("_s"))).drop("_s").withColumn("rate", rate)
    # One entry per distinct size of a source, not per document.
    falling = F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "rate"))))
    folded = cells.where("size > 0").groupBy("source").agg(falling.alias("cells")).select("source", F.explode(_rounded(limit)).alias("c")).select(F.col("source").alias("_s"), F.col("c.size").alias("_size"), "c.copies")
    cells = cells.join(folded, _same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_size")), "left").drop("_s", "_size")
    cells = cut(cells.withColumn("copies", F.coalesce("copies", "n")), "cells").withColumnRenamed("source", "_s").withColumnRenamed("size", "_size").withColumnRenamed("n", "_n")
    # Copies of a cell go to its parts, and those of a part to its documents, by differences of a rounded running share.
    share_of = parts.join(cells, _same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_size"))).drop("_s", "_size")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part"))
    whole = lambda n, k, of: (n * k - n * k % of) / of
    mine = whole(F.col("copies"), upto, F.col("_n")) - whole(F.col("copies"), upto - F.col("n"), F.col("_n"))
    share_of = share_of.withColumn("mine", mine.cast("long")).select(F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("part").alias("_part"), F.col("n").alias("_n"), "mine", "source_size", "target", "rate")
    share_of = cut(share_of, "shares")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash", "doc_id", "id"))
    dealt = docs.withColumn("rank", rank).join(share_of, _same(F.col("source"), F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("part") == F.col("_part")))
    copies = (whole(F.col("mine"), F.col("rank"), F.col("_n")) - whole(F.col("mine"), F.col("rank") - 1, F.col("_n"))).cast("long")
    dealt = dealt.select("id", "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    # All of the above moves narrow rows; what is passed on meets its copies once.
    return (dealt.join(rows, "id") if keep else dealt).drop("id")
