"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors a cosine of at least ``cosine`` is a distance of at most ``eps = sqrt(2 - 2 * cosine)``,
and a projection on orthonormal axes never lengthens a distance. So vectors are sorted by their grid
cells of width eps on the leading principal axes; the sorted sequence is cut into intervals of
``INTERVAL`` vectors; pairs of intervals whose bounding boxes lie further apart than eps are skipped,
the boxes spanning the axes and the norm of what the axes leave;
the others meet in tiles of ``GROUP`` by ``GROUP`` intervals, are halved recursively with the same test, and what is left is decided by cosines in
double precision. The skipped pairs are provably too far apart, so every link is found. A tile returns
counts of links and a spanning forest of them, never the pairs, so that a dense group costs rows in
proportion to its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .graph import components

#: Vectors in an interval of the sorted sequence, vectors at which halving ends, principal axes of the grid.
INTERVAL, LEAF, AXES = 1024, 256, 8
#: Intervals in a group; a task holds the vectors of two groups.
GROUP = 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(cells: pd.Series) -> np.ndarray:
    return _unit(np.stack(cells.to_numpy()))


def _gram(dim: int):
    """Sums of products of components, a row of the matrix each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["embedding"])
                total += x.T @ x
        yield pd.DataFrame({"k": np.arange(dim), "v": [r.tobytes() for r in total]})

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Leading principal axes (columns) of all vectors' directions; the driver gets dim * dim sums."""
    sums = vectors.select("embedding").mapInPandas(_gram(dim), "k int, v binary").groupBy("k").applyInPandas(_summed, "k int, v binary").collect()
    gram = np.zeros((dim, dim))
    for row in sums:
        gram[row["k"]] = np.frombuffer(row["v"])
    _, axes = np.linalg.eigh(gram)
    return np.ascontiguousarray(axes[:, ::-1][:, :AXES])


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places of unit vectors on the axes and, last, the norm of what the axes leave; no distance grows by it."""
    p = x @ axes
    return np.concatenate([p, np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1)))[:, None]], axis=1)


def _cells(axes: np.ndarray, eps: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=list(np.floor(_matrix(pdf["embedding"]) @ axes / eps).astype(np.int32)))

    return run


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, at = TaskContext.get().partitionId(), 0
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "embedding": pdf["embedding"], "part": part, "pos": np.arange(at, at + len(pdf))})
        at += len(pdf)


def _pack(axes: np.ndarray, kind: type):
    """An interval's vectors as they came, in ``kind``, so that single precision costs 4 bytes a component and loses nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        raw = np.stack(pdf["embedding"].to_numpy())
        p = coordinates(_unit(raw), axes)
        row = (int(pdf["interval"].iloc[0]), pdf["id"].to_numpy(np.int64).tobytes(), raw.astype(kind).tobytes(), p.min(axis=0), p.max(axis=0))
        return pd.DataFrame([row], columns=["interval", "ids", "x", "lo", "hi"])

    return run


def _gap2(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    gap = np.maximum(0.0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float((gap * gap).sum())


def _close(p: np.ndarray, q: np.ndarray, most2: float, same: bool) -> Iterator[tuple[slice, slice]]:
    """Index ranges of two sequences that the boxes of their halves leave possible."""
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a or _gap2(p[a:b].min(0), p[a:b].max(0), q[c:d].min(0), q[c:d].max(0)) > most2:
            continue
        if max(b - a, d - c) <= LEAF:
            yield slice(a, b), slice(c, d)
            continue
        left = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        right = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        todo += [(*x, *y) for x in left for y in right]


def _forest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix the smallest node of its component; columns follow the rows."""
    rows, cols = m.shape
    lr, lc, far = np.arange(rows), np.arange(rows, rows + cols), rows + cols
    while True:
        nr = np.minimum(lr, np.where(m, lc, far).min(axis=1))
        nc = np.minimum(lc, np.where(m, nr[:, None], far).min(axis=0))
        if (nr == lr).all() and (nc == lc).all():
            return lr, lc
        lr, lc = nr, nc


def _tile(dim: int, axes: np.ndarray, cosine: float, most2: float, kind: type):
    """All intervals of a tile's two groups meet as far as boxes leave possible; rows and columns of links leave as counts and stars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        read = lambda t: (np.frombuffer(t.ids, np.int64), _unit(np.frombuffer(t.x, kind).reshape(-1, dim)), np.array(t.lo), np.array(t.hi))
        rows = sorted(pdf.itertuples(index=False), key=lambda t: t.interval)
        sides: dict[int, tuple] = {t.interval: (t.interval // GROUP, *read(t)) for t in rows}
        groups = sorted({g for g, *_ in sides.values()})
        for a, (g, ids, x, lo, hi) in sides.items():
            for b, (h, jds, y, low, high) in sides.items():
                # A tile of two groups holds pairs across them; one of a single group its own.
                if b < a or (len(groups) > 1 and g == h) or _gap2(lo, hi, low, high) > most2:
                    continue
                same, m = a == b, np.zeros((len(x), len(y)), dtype=bool)
                for r, c in _close(coordinates(x, axes), coordinates(y, axes), most2, same):
                    m[r, c] = x[r] @ y[c].T >= cosine
                if same:
                    m |= m.T
                    np.fill_diagonal(m, False)
                i, j = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
                if not len(i):
                    continue
                m, left, right = m[np.ix_(i, j)], ids[i], jds[j]
                lr, lc = _forest(m)
                node = np.r_[left, right]
                out.append(pd.DataFrame({"id": left, "n": m.sum(axis=1), "to": node[lr]}))
                out.append(pd.DataFrame({"id": right, "n": np.zeros(len(right), dtype=np.int64) if same else m.sum(axis=0), "to": node[lc]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "to": []}, dtype="int64")

    return run


def _links(valid: DataFrame, dim: int, count: int, cosine: float, single: bool) -> DataFrame:
    """(id, n, to): numbers of links, and stars that connect what links connect, among vectors (id, embedding) of one length."""
    spark = valid.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6  # more than rounding moves a coordinate
    axes = principal_axes(valid, dim)
    kind, wire = "id long, embedding array<double>", np.float32 if single else np.float64
    cells = valid.mapInPandas(_cells(axes, eps), kind + ", cell array<int>")
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // (64 * INTERVAL))
    ranged = cells.repartitionByRange(ways, "cell", "id").sortWithinPartitions("cell", "id")
    ranged = cut(ranged.mapInPandas(_numbered, kind + ", part int, pos long"), "ranged")
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    ranked = ranged.join(starts, "part").withColumn("rank", F.col("start") + F.col("pos")).withColumn("interval", F.floor(F.col("rank") / INTERVAL))
    packed = ranked.select("id", "embedding", "rank", "interval").groupBy("interval").applyInPandas(_pack(axes, wire), "interval long, ids binary, x binary, lo array<double>, hi array<double>")
    packed = cut(packed, "intervals")
    # Boxes overlap or adjoin on the first axis if they share one of its cells, widened by one: an equi-join finds all pairs within eps.
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    boxes = packed.select("interval", "lo", "hi", cell("lo").alias("first"), cell("hi").alias("last"))
    left = boxes.select(F.col("interval").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence("first", "last")).alias("at"))
    right = boxes.select(F.col("interval").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("at"))
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, "at").where(F.col("a") <= F.col("b")).where(far <= eps * eps).select("a", "b")
    # Tiles are pairs of groups of intervals, so that a vector travels once for each group that it meets, not for each interval.
    group = lambda c: F.floor(F.col(c) / GROUP)
    sides = pairs.select(group("a").alias("g"), group("b").alias("h"), F.explode(F.array("a", "b")).alias("interval")).distinct()
    tiles = cut(sides.join(packed, "interval").groupBy("g", "h").applyInPandas(_tile(dim, axes, cosine, eps * eps, wire), "id long, n long, to long"), "met")
    for done in (ranged, packed):
        drop_cut(done)
    return tiles


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero or that hold null or non-finite components link with nothing, and so do those of a
    null vec_id, whose component is null. Vectors of different lengths do not link; each length is a join of its own. Rows
    equal in vec_id and vector count as one vector; different vectors under one vec_id are joined each for itself, with
    a row each. A cosine equal to the threshold links. Other columns are ignored. An empty table gives an empty table.
    """
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))
    every = every.withColumn("code", F.when(fine, F.xxhash64("embedding")))
    valid = every.where("code is not null").groupBy("vec_id", "code").agg(F.first("embedding").alias("embedding"))
    valid = cut(valid.withColumn("id", F.monotonically_increasing_id()), "vectors")
    met = None
    for row in valid.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        part = _links(valid.where(F.size("embedding") == row["dim"]).select("id", "embedding"), row["dim"], row["count"], cosine, single)
        met = part if met is None else met.unionByName(part)
    if met is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = met.groupBy("id").agg(F.sum("n").alias("n"))
    named = components(met.select(F.col("id").alias("u"), F.col("to").alias("v")))
    named = valid.select("vec_id", "code", "id").join(links, "id").join(named, "id")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = cut(named.join(least, "component").select("vec_id", "code", "n", "component_id"), "named")
    found = every.select("vec_id", "code").join(named, ["vec_id", "code"], "left")
    n, component = F.coalesce(F.col("n"), F.lit(0)).cast("long"), F.coalesce("component_id", "vec_id")
    return found.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
