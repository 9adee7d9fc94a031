"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct word shingles. Two documents link when
``100 * |intersection| >= percent * |union|``; the result is every document with the smallest
doc_id that links reach from it. No link between different texts is lost, and no group of
copies is expanded into pairs:

1. One pass over the texts writes, per document, the set's size, a 128-bit signature of the set, its
   prefix (its rarest shingles, of which two linked sets share at least one) and a bitmap with a bit
   for each shingle's hash. How rare a shingle is goes by counts over all documents in a table of fixed
   size, made by a pass of its own. Equal signatures are one class from here on.
2. Classes with the same smallest shingle hash compare bitmaps: the bits in which two bitmaps differ
   bound the symmetric difference from below and so the overlap from above. Those that may link meet
   once, with their whole texts, in tiles of bounded size, where sorted arrays are intersected and
   pairs already connected are skipped. This connects nearly all of each group of near copies by
   links in proportion to its members.
3. Prefix shingles that more than one component holds in neighbouring size bands form tiles. An entry
   stays in its tile only with a partner that sizes and their places in the prefixes leave possible: two
   sets whose first shared shingle has so many members before it cannot share those. Tiles that are left
   read bitmaps; a tile larger than ``BLOCK`` is dealt out as pairs of blocks. A tile returns a spanning
   forest of the pairs that lie in different components, satisfy the size bound and pass the bitmap
   bound. Every link not yet made lies within a tree of these forests together. The texts of each tree
   meet in pairs of blocks of bounded size, where sorted arrays decide. That makes the result exact,
   whatever step 2 has left apart.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, only_ids
from .graph import components
from .shingles import mix, shingle_set

#: Bits of a small set's bitmap; larger sets have the power of two at or above their size, as a fuller bitmap tells nothing.
LEAST_BITS = 256
#: Most texts in a tile of step 2, most rows in a block.
TILE, BLOCK = 400, 4096
#: Tiles are read in lots of about so many rows, as a Python call for each small tile would cost more than its work.
TEXTS_IN_LOT, ROWS_IN_LOT, ENTRIES_IN_LOT = 200, 8192, 50_000
#: About so many entries leave a Python worker in one frame, so that its memory does not grow with a batch's texts.
ENTRIES_IN_FRAME = 32_768
#: Size bands that share a lot's key.
BANDS = 8
KEY = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a shingle's hash that name its place in the table of frequencies, slices in which the table is summed.
RANKS, SLICES = 20, 16
#: Most entries of a tile that are compared by place one with one; larger tiles go by sizes alone.
PLACED = 64


def prefix_length(n: int, percent: int) -> int:
    """Two sets of which one has n members and that link share one of the first so many of each."""
    return n - -(-percent * n // 100) + 1


def signature(a: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        x = mix(a + np.uint64(0x632BE59BD9B4E019))
        return tuple(np.array([a.sum(dtype=np.uint64), x.sum(dtype=np.uint64)]).view(np.int64).tolist())


def bitmap(a: np.ndarray) -> np.ndarray:
    size = max(LEAST_BITS, 1 << (len(a) - 1).bit_length()) if len(a) else LEAST_BITS
    bits = np.zeros(size, dtype=np.uint8)
    bits[(a & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def bitmap_rows(bitmaps: list[np.ndarray]) -> np.ndarray:
    """One row per bitmap, folded to the shortest: a bit then stands for more hashes, so the bounds still hold."""
    size = min(map(len, bitmaps))
    return np.stack([b if len(b) == size else np.bitwise_or.reduce(b.reshape(-1, size), axis=0) for b in bitmaps])


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference with which sets of n and m members still link; negative if none."""
    total = n + m
    need = -(-percent * total // (100 + percent))
    return np.where(need <= np.minimum(n, m), total - 2 * need, -1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Sorted arrays of distinct hashes, decided exactly."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _frequencies(width: int):
    """How many documents of a partition hold a shingle of each of 2**``RANKS`` hash places, in slices of compressed counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, part = np.zeros(1 << RANKS, dtype=np.uint32), TaskContext.get().partitionId()
        for pdf in batches:
            for text in pdf["text"].tolist():
                a = shingle_set(text if isinstance(text, str) else None, width)
                np.add.at(count, (a >> np.uint64(64 - RANKS)).astype(np.int64), 1)
        yield pd.DataFrame({"slice": range(SLICES), "part": part, "counts": [zlib.compress(x.astype(np.uint64).tobytes(), 1) for x in count.reshape(SLICES, -1)]})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), dtype=np.uint64) for x in pdf["counts"])
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """A rank for each of 2**``RANKS`` hash places of shingles, rising with how many documents hold one; counted over all documents.

    Partitions' counts add up in two turns, so that no task reads more than a fixed number of them at scale. The driver
    gets one table of fixed size.
    """
    each = docs.select("text").mapInPandas(_frequencies(width), "slice int, part int, counts binary")
    some = each.groupBy("slice", F.pmod("part", F.lit(1024)).alias("turn")).applyInPandas(_added, "slice int, counts binary")
    found = {r["slice"]: r["counts"] for r in some.groupBy("slice").applyInPandas(_added, "slice int, counts binary").collect()}
    count = np.concatenate([np.frombuffer(zlib.decompress(found[k]), dtype=np.uint64) for k in range(SLICES)]) if found else np.zeros(1 << RANKS, dtype=np.uint64)
    # Equal counts have equal ranks; quantiles keep the ranks within 16 bits, whatever the counts.
    ordered = np.sort(count)
    return (np.searchsorted(ordered, count).astype(np.uint64) >> np.uint64(RANKS - 16)).astype(np.uint16)


def prefix(a: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """The rarest members of a sorted set: by rank of their places, then by hash."""
    return a[np.argsort(ranks[(a >> np.uint64(64 - RANKS)).astype(np.int64)], kind="stable")[:length]]


def _digest(percent: int, width: int, ranks: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, code, text in zip(pdf["doc_id"].tolist(), pdf["code"].tolist(), pdf["text"].tolist(), strict=True):
                a = shingle_set(text if isinstance(text, str) else None, width)
                n = len(a)
                s = signature(a) if n else (0, 0)
                keep = prefix(a, ranks, prefix_length(n, percent)) if n else a
                rows.append((i, code, n, *s, int(a[0].view(np.int64)) if n else 0, keep.tobytes(), bitmap(a).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "code", "n", "s0", "s1", "lo", "prefix", "bits"]).astype({"doc_id": "Int64"})

    return run


def _bitmaps(bits: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in bits]


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def likely_trees(n: np.ndarray, bits: list[np.ndarray], percent: int, may) -> np.ndarray:
    """For each of some sets, sorted by size, the first one that bitmaps connect it to; ``may(i)`` selects earlier partners of i."""
    tree, rows = np.arange(len(n)), bitmap_rows(bits)
    for i in range(1, len(n)):
        low = np.searchsorted(n[:i], -(-percent * n[i] // 100))
        near = np.flatnonzero(may(i, low)) + low
        if len(near):
            near = near[np.bitwise_count(rows[near] ^ rows[i]).sum(axis=1) <= most_apart(n[near], n[i], percent)]
        if len(near):
            joined = np.unique(tree[near])
            tree[i] = joined[0]
            if len(joined) > 1:
                tree[:i][np.isin(tree[:i], joined)] = joined[0]
    return tree


def _likely(percent: int):
    """Within each tile, documents that bitmaps connect, with the first of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "n", "doc_id"], kind="stable")
        ids, n, bits = pdf["doc_id"].to_numpy(), pdf["n"].to_numpy(), _bitmaps(pdf["bits"])
        root = np.arange(len(ids))
        for a, b in _runs(pdf["tile"].to_numpy() ^ np.array([len(x) for x in bits], dtype=np.int64)):
            if b - a > 1:
                root[a:b] = a + likely_trees(n[a:b], bits[a:b], percent, lambda i, low: np.ones(i - low, dtype=bool))
        many = np.bincount(root, minlength=len(ids))[root] > 1
        return pd.DataFrame({"doc_id": ids[many], "root": ids[root[many]]})

    return run


def tile_links(ids: list[int], sets: list[np.ndarray], percent: int, comp: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect the members of a tile as all its links would.

    ``comp`` names what is connected already; with ``side``, the block of each member, only pairs across blocks count.
    """
    n = np.array([len(a) for a in sets])
    order = np.argsort(n, kind="stable")
    n, bits = n[order], bitmap_rows([bitmap(sets[i]) for i in order])
    comp = np.arange(len(ids)) if comp is None else comp[order].copy()
    side = np.full(len(ids), -1) if side is None else side[order]
    merged: set[int] = set()
    for i in range(1, len(ids)):
        low = np.searchsorted(n[:i], -(-percent * n[i] // 100))
        near = np.flatnonzero((comp[low:i] != comp[i]) & ((side[low:i] != side[i]) | (side[i] < 0))) + low
        near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= most_apart(n[near], n[i], percent)] if len(near) else near
        for j in near[::-1].tolist():
            if comp[j] != comp[i] and linked(sets[order[i]], sets[order[j]], percent):
                merged.add(int(comp[j]))
                merged.add(int(comp[i]))
                comp[comp == comp[j]] = comp[i]
    # Each group as a star around its smallest id, so that chains of links cost no rounds later.
    out = []
    for c in np.unique(comp[np.isin(comp, list(merged))]) if merged else ():
        members = sorted(ids[k] for k in order[comp == c])
        out += [(members[0], m) for m in members[1:]]
    return out


def _tiles(percent: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["tile", "doc_id"]).sort_values(["tile", "doc_id"])
        ids, sets = pdf["doc_id"].tolist(), [shingle_set(t, width) for t in pdf["text"].tolist()]
        comp, side = pdf["comp"].to_numpy(), pdf["side"].to_numpy()
        out = [x for i, j in _runs(pdf["tile"].to_numpy()) if j - i > 1 for x in tile_links(ids[i:j], sets[i:j], percent, comp[i:j], side[i:j])]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _forests(percent: int):
    """Spanning forests of the pairs within each tile that lie in different components and that sizes and bitmaps leave possible.

    A pair meets in the band of its smaller set and in one pair of blocks (``side``: its block, -1 where a
    block meets itself).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each = pdf["entries"].map(len).to_numpy()
        row = np.repeat(np.arange(len(pdf)), each)
        e = pd.DataFrame([x for cell in pdf["entries"] for x in cell])
        e = e.assign(row=row, doc_id=pdf["doc_id"].to_numpy()[row], n=pdf["n"].to_numpy()[row]).sort_values(["tile", "n", "doc_id"], kind="stable")
        ids, comp, n, side, home = (e[c].to_numpy() for c in ("doc_id", "comp", "n", "side", "home"))
        known, out = _bitmaps(pdf["bits"]), []
        bits, pdf = [known[r] for r in e["row"]], e
        for a, b in _runs(pdf["tile"].to_numpy()):
            c, s, h = comp[a:b], side[a:b], home[a:b]
            if (c != c[0]).any():
                tree = likely_trees(n[a:b], bits[a:b], percent, lambda i, low: (c[low:i] != c[i]) & h[low:i] & ((s[low:i] != s[i]) | (s[i] < 0)))  # noqa: B023
                at = np.flatnonzero(tree != np.arange(b - a))
                out.append(np.stack([ids[a + at], ids[a + tree[at]]], axis=1))
        both = np.concatenate([np.empty((0, 2), dtype=np.int64), *out])
        return pd.DataFrame(both, columns=["u", "v"]).drop_duplicates()

    return run


def _entries(percent: int, lots: int):
    """Prefix entries dealt by shingle and group of size bands, as arrays for each lot; frames of about ``ENTRIES_IN_FRAME`` entries."""
    step = math.log(100 / percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy(np.int64)
            band = np.floor(np.log(n) / step + 1e-9).astype(np.int64)
            count = np.array([len(x) // 8 for x in pdf["prefix"]])
            # A batch has many entries, so their arrays are narrow and go as soon as they are read.
            row = np.repeat(np.arange(len(pdf), dtype=np.int32), count)
            place = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
            key = np.frombuffer(b"".join(pdf["prefix"].tolist()), dtype=np.uint64)
            group = (band // BANDS).astype(np.int16)
            lower = np.flatnonzero((((band - 1) // BANDS) != group)[row])
            group = np.r_[group[row], group[row[lower]] - np.int16(1)]
            row, key, place = np.r_[row, row[lower]], np.r_[key, key[lower]], np.r_[place, place[lower]]
            lot, short = np.empty(len(key), dtype=np.int32), np.empty(len(key), dtype=np.uint32)
            for a in range(0, len(key), ENTRIES_IN_FRAME):
                some = slice(a, a + ENTRIES_IN_FRAME)
                with np.errstate(over="ignore"):
                    code = mix(key[some] ^ ((group[some] + 2).astype(np.uint64) * KEY))
                lot[some], short[some] = code % np.uint64(lots), code >> np.uint64(32)
            del key, lower
            order = np.lexsort((row, lot))
            ids, n = pdf["doc_id"].to_numpy(np.int64), n.astype(np.int32)
            apart = ids - pdf["comp"].to_numpy(np.int64)
            del pdf
            out, held = [], 0
            for a, b in _runs(lot[order]):
                o = order[a:b]
                r = row[o]
                out.append((int(lot[o[0]]), short[o].tobytes(), ids[r].tobytes(), apart[r].tobytes(), n[r].tobytes(), place[o].tobytes(), group[o].tobytes()))
                held += b - a
                if held >= ENTRIES_IN_FRAME or b == len(order):
                    yield pd.DataFrame(out, columns=["lot", "key", "ids", "comp", "n", "place", "group"])
                    out, held = [], 0

    return run


def possible(tile: np.ndarray, comp: np.ndarray, n: np.ndarray, home: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Entries, sorted by tile and n, with a partner of another component in their tile with which, by sizes and places, they may link.

    Were the tile's shingle the first that two sets share, they could share no more than it and what follows it
    in both. A linked pair's first shared shingle passes this test, so the pair meets there. Tiles of more than ``PLACED``
    entries are kept whole.
    """
    keep = np.zeros(len(tile), dtype=bool)
    start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.empty(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(tile)])
    keep |= np.repeat(size > PLACED, size)
    size_of = np.repeat(size, size)
    offset = np.arange(len(tile)) - np.repeat(start, size)
    for step in range(1, min(PLACED, int(size.max(initial=0)))):
        i = np.flatnonzero((offset + step < size_of) & (size_of <= PLACED))
        j = i + step
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        fits = (comp[i] != comp[j]) & home[i] & (need <= np.minimum(n[i] - place[i], n[j] - place[j]))
        keep[i[fits]] = keep[j[fits]] = True
    return keep


def _survivors(percent: int):
    """Entries of tiles (shingle, size band) that may have a partner of another component, with the tile's count of them."""
    step = math.log(100 / percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.frombuffer(b"".join(pdf[c].tolist()), dtype=kind)
        key, ids, group = read("key", np.uint32), read("ids", np.int64), read("group", np.int16)
        n, place = read("n", np.int32).astype(np.int64), read("place", np.int32).astype(np.int64)
        comp = ids - read("comp", np.int64)
        band = np.floor(np.log(n) / step + 1e-9).astype(np.int64)
        homes, guests = np.flatnonzero(band // BANDS == group), np.flatnonzero((band - 1) // BANDS == group)
        at = np.r_[homes, guests]
        home = np.arange(len(at)) < len(homes)
        with np.errstate(over="ignore"):
            tile = mix((key[at].astype(np.uint64) << np.uint64(16)) ^ ((band[at] - ~home) * 2 + 1).astype(np.uint64) * KEY).view(np.int64)
        order = np.lexsort((ids[at], n[at], tile))
        at, home, tile = at[order], home[order], tile[order]
        ids, comp, n, place = ids[at], comp[at], n[at], place[at]
        last = len(at)
        same = np.r_[(tile[1:] == tile[:-1]) & (comp[1:] == comp[:-1]), False] if last else np.empty(0, dtype=bool)
        edges = np.flatnonzero(~same)
        run_of = np.searchsorted(edges, np.arange(last))
        after = edges[run_of] + 1
        before = np.r_[-1, edges[:-1]][run_of] if last else after
        a, b = np.minimum(after, last - 1), np.maximum(before, 0)
        keep = (after < last) & (tile[a] == tile) & (n[a] * percent <= 100 * n) & home
        keep |= (before >= 0) & (tile[b] == tile) & (n * percent <= 100 * n[b])
        tile, ids, comp, n, home, place = (x[keep] for x in (tile, ids, comp, n, home, place))
        keep = possible(tile, comp, n, home, place, percent)
        tile = tile[keep]
        _, index, count = np.unique(tile, return_inverse=True, return_counts=True)
        return pd.DataFrame({"tile": tile, "doc_id": ids[keep], "comp": comp[keep], "n": n[keep], "home": home[keep], "c": count[index]})

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Null, empty or wordless texts have size 0, link with nothing and are their own component. Equal
    rows have equal results, and rows of one doc_id with different texts are joined each for itself. Rows of a null doc_id
    link like others; their component is the smallest doc_id in it, null if it has none. Texts may have any length. Other columns of ``docs`` are
    ignored. An empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("code"), text.alias("text"))
    ranks = frequency_ranks(docs, width)
    kind = "doc_id long, code long, n long, s0 long, s1 long, lo long, prefix binary, bits binary"
    digest = cut(docs.mapInPandas(_digest(percent, width, ranks), kind).withColumn("row", F.monotonically_increasing_id()), "digest")
    total = digest.count()
    # One row stands for a class of equal sets; from here on it is the class's name.
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "code", "lo"))
    reps = digest.where("n > 0").groupBy("s0", "s1", "n").agg(one.alias("one")).select("s0", "s1", "n", "one.doc_id", F.col("one.row").alias("id"), "one.code", "one.lo")
    reps = cut(reps, "reps")
    mine = digest.select(F.col("row").alias("id"), "prefix", "bits")
    lot = lambda rows, each: F.pmod("tile", F.lit(rows // each + 1))
    as_doc = lambda df: df.withColumnRenamed("id", "doc_id")

    def texts(ids: DataFrame) -> DataFrame:
        """Each class of ``ids`` with the text of the row that stands for it."""
        wanted = reps.select("id", "code").join(ids, "id")
        found = only_ids(docs.select("code", "text"), wanted.select("code"), "code")
        return found.join(wanted, "code")

    shared = reps.groupBy("lo").agg(F.count("*").alias("c")).where("c > 1")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK).cast("long"))
    meet = reps.select("id", "n", "lo").join(shared, "lo").select("id", "n", F.xxhash64("lo", part).alias("tile"))
    likely = as_doc(meet.join(mine.select("id", "bits"), "id")).withColumn("lot", lot(total, ROWS_IN_LOT)).groupBy("lot").applyInPandas(_likely(percent), "doc_id long, root long")
    likely = cut(likely.withColumnRenamed("doc_id", "id"), "likely")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / TILE).cast("long"))
    meet = likely.join(likely.groupBy("root").agg(F.count("*").alias("c")), "root").select("id", F.xxhash64("root", part).alias("tile"), F.col("id").alias("comp"), F.lit(-1).alias("side"))
    links = cut(as_doc(texts(meet)).withColumn("lot", lot(total, TEXTS_IN_LOT)).groupBy("lot").applyInPandas(_tiles(percent, width), "u long, v long"), "links")
    first = components(links).withColumnRenamed("component", "comp")

    nodes = cut(reps.select("id", "n").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "nodes")
    lots = (digest.agg(F.sum(F.length("prefix"))).first()[0] or 0) // (8 * ENTRIES_IN_LOT) + 1
    dealt = as_doc(nodes.join(mine.select("id", "prefix"), "id")).mapInPandas(_entries(percent, lots), "lot long, key binary, ids binary, comp binary, n binary, place binary, group binary")
    tiles = cut(dealt.groupBy("lot").applyInPandas(_survivors(percent), "tile long, doc_id long, comp long, n long, home boolean, c long").withColumnRenamed("doc_id", "id"), "tiles")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    at = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    dealt = tiles.withColumn("blocks", blocks).withColumn("at", at).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("at") == F.col("to"), F.lit(-1)).otherwise(F.col("at")).alias("side")
    dealt = dealt.select("id", "n", "comp", "home", F.xxhash64("tile", F.least("at", "to"), F.greatest("at", "to")).alias("tile"), side)
    # A bitmap goes once to a lot that holds its class, not once for each entry.
    dealt = dealt.withColumn("lot", lot(tiles.count(), ROWS_IN_LOT))
    entries = dealt.select("lot", "id", "n", F.struct("tile", "comp", "home", "side").alias("e")).groupBy("lot", "id", "n").agg(F.collect_list("e").alias("entries"))
    trees = components(as_doc(entries.join(mine.select("id", "bits"), "id")).groupBy("lot").applyInPandas(_forests(percent), "u long, v long"))
    sizes = trees.groupBy(F.col("component").alias("tree")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    meet = trees.withColumnRenamed("component", "tree").join(sizes, "tree").join(nodes.select("id", "comp"), "id")
    meet = meet.withColumn("at", at).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("id", "comp", F.xxhash64("tree", F.least("at", "to"), F.greatest("at", "to")).alias("tile"), side)
    more = as_doc(texts(meet)).withColumn("lot", lot(total, TEXTS_IN_LOT)).groupBy("lot").applyInPandas(_tiles(percent, width), "u long, v long")
    final = components(links.union(more))
    named = reps.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.select("s0", "s1", "n", "component").join(least, "component").select("s0", "s1", "n", "component_id"), "named")
    for done in (likely, tiles, links, nodes, reps):
        drop_cut(done)
    found = digest.select("doc_id", "n", "s0", "s1").join(named, ["s0", "s1", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
