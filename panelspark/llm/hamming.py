"""Exact top-k search for binary codes by incremental multi-index hashing.

A code, one or more 64-bit words, is cut into segments of ``WIDTH`` bits, each the key of one index. If two
codes differ in d bits, some segment of theirs differs in at most d // segments. So once every segment has
been searched up to radius r, all codes within segments * (r + 1) - 1 bits are found; radii grow one
segment at a time, and a query ends when its kth verified distance is covered. Searches carry the kth
distance so far, so that the join returns only rows that can still enter the result. Equal codes are
searched once: a code stands for its k smallest ids, a query code for all queries that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

BITS, WIDTH = 64, 16


def sign_code(vector: Column) -> Column:
    """A bit per component of a vector of any length, in words of 64: 1 where it is above 0 (null and NaN: 0). Null or empty: null."""
    bits = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), 1).otherwise(0).cast("long"))
    word = lambda k: F.aggregate(F.slice(bits, k * BITS + 1, F.lit(BITS)), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return F.when(F.size(vector) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / BITS).cast("int")), word))


def _segment(words: list[Column], i: int) -> Column:
    each = BITS // WIDTH
    return F.shiftright(words[i // each], i % each * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _apart(a: list[Column], b: list[Column]) -> Column:
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k codes nearest to each query by Hamming distance, ties by id.

    ``codes`` and ``queries`` have (id, code: long or array of longs); shorter arrays count as filled up with zeros. A query finds itself
    where it is among the codes. Null ids and codes are left out; an id repeated among the codes counts once for each row, among the queries once for each code. With
    fewer than k codes all are returned. Other columns are ignored. Empty tables give an empty table.
    """
    spark = codes.sparkSession
    listed = lambda df: F.col("code") if df.schema["code"].dataType.typeName() == "array" else F.array("code")
    codes = codes.where("id is not null and code is not null").select("id", listed(codes).alias("code"))
    queries = queries.where("id is not null and code is not null").select("id", listed(queries).alias("code"))
    words = max([x for x in (codes.agg(F.max(F.size("code"))).first()[0], queries.agg(F.max(F.size("code"))).first()[0]) if x] or [1])
    names = [f"w{j}" for j in range(words)]
    flat = lambda df: df.select("id", *(F.coalesce(F.get("code", F.lit(j)), F.lit(0)).cast("long").alias(n) for j, n in enumerate(names)))
    # A code's k smallest ids are all that can enter a result.
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    classes = flat(codes).withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(classes.withColumn("first", F.element_at("ids", 1)).withColumn("c", F.monotonically_increasing_id()), "classes")
    asked = cut(flat(queries), "asked")
    todo = cut(asked.select(*names).distinct().withColumn("q", F.monotonically_increasing_id()).withColumn("bound", F.lit(BITS * words)), "queries")
    known = todo
    total = classes.count()
    own, mine = [F.col(n) for n in names], [F.col(f"q_{n}") for n in names]
    segments = words * BITS // WIDTH
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = lambda of: F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _segment(own, i).alias("key")) for i in of)))
    index = cut(classes.select("c", "first", F.size("ids").alias("n"), *names, keys(range(segments)).alias("s")).select("c", "first", "n", *names, "s.*"), "index")
    best, done = None, []
    # Small radii find little, so all segments go at once; from there on one at a time, as each costs more.
    turns = [(r, list(range(segments))) for r in range(3)] + [(r, [i]) for r in range(3, WIDTH + 1) for i in range(segments)]
    for r, part in turns:
        # A constant, so that it is made once and not for each query.
        masks = F.split(F.lit(",".join(str(m) for m in range(1 << WIDTH) if m.bit_count() == r)), ",").cast("array<bigint>")
        # Queries are dealt out before each makes its keys; neither side of the join is broadcast, as both grow with the tables.
        probes = todo.repartition(ways, "q").withColumn("s", keys(part)).withColumn("mask", F.explode(masks))
        probes = probes.select("q", *(F.col(n).alias(f"q_{n}") for n in names), "bound", F.col("s.seg").alias("at"), F.col("s.key").bitwiseXOR(F.col("mask")).alias("probe")).hint("merge")
        # A pair is met in the first segment in order of radius, then place, so that it counts once.
        nearer = F.lit(False)
        for j in range(segments):
            d = _apart([_segment(own, j)], [_segment(mine, j)])
            nearer = nearer | ((F.col("at") != j) & ((d < r) | ((d == r) & (F.col("at") > j))))
        found = probes.join(index, (F.col("at") == F.col("seg")) & (F.col("probe") == F.col("key")) & (_apart(own, mine) <= F.col("bound")) & ~nearer)
        found = found.select("q", "c", "first", "n", _apart(own, mine).alias("distance"))
        every = found if best is None else best.unionByName(found)
        order = Window.partitionBy("q").orderBy("distance", "first")
        new = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        new = cut(new.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))), "best")
        covered = r * segments + part[-1]
        kth = new.groupBy("q").agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("kth"), (F.count("*") == total).alias("all"))
        over = F.coalesce((F.col("kth") <= covered) | F.col("all"), F.lit(False))
        state = cut(todo.drop("bound").join(kth, "q", "left").select("q", *names, F.coalesce("kth", F.lit(BITS * words)).alias("bound"), over.alias("over")), "state")
        left = state.where("not over").count()
        if not left or (r, part) == turns[-1]:
            done.append(new)
            break
        done.append(new.join(state.where("over").select("q"), "q", "left_semi"))
        todo = state.where("not over").drop("over")
        best = cut(new.join(todo.select("q"), "q", "left_semi").drop("rank", "upto"), "open")
    drop_cut(index)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    named = out.select("q", "c", "distance").join(classes.select("c", "ids"), "c").select("q", F.explode("ids").alias("id"), "distance")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    to = asked.distinct().withColumnRenamed("id", "query_id").join(known.select("q", *names), names).select("query_id", "q")
    return to.join(ranked, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("distance").cast("int").alias("distance"))
