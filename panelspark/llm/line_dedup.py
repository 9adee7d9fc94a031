"""Line deduplication by a log-template tree.

A line's tokens are its words, those with a digit masked as variable. The tree has fixed depth: token
count, then the first ``DEPTH`` tokens. A leaf holds any number of templates. A line's remaining tokens are
dealt into one segment more than the fields that it may differ in, so that two lines near enough share a
segment; lines that share one are compared, and those that differ in few enough positions are
joined. Lines joined, directly or by others, have one template, whose variables are the positions in which
they differ; any other line is its own template. A segment that more than ``BLOCK`` lines share is
narrowed: the positions in which its lines vary are dealt into one part more than the fields, and near
lines share a part again; no pair of near lines is lost, so a segment's size does not matter. A few lines
are elected before, and lines that pairs with them connect need no comparison. A template that
enough documents share is dropped from all of them but the first: ``LEAST_DOCS`` or more, ``MIN_DOCS`` at
most, and in between so many that documents times tokens reach ``WEIGHT``, so that the longer a template,
the fewer.

One pass over the texts hashes all lines; from there on only hashes move, and texts meet the places to
drop only where a line of theirs goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, drop_cut, flagged, only_ids
from .graph import components
from .shingles import byte_hashes, mix, range_hashes, word_places

#: Leading tokens of the tree, documents from which a template of any length recurs.
DEPTH, MIN_DOCS = 3, 10
#: Documents that a recurring template has at least, and documents times tokens from which a template recurs.
LEAST_DOCS, WEIGHT = 2, 40
#: Fewest tokens of a line that may be generalised, least share of positions in which two lines of a template agree, and most in which they differ.
MIN_TOKENS, CONSTANT, FIELDS = 8, 0.7, 3
#: Most lines that are compared all with all, and lines elected at once in a segment of more.
BLOCK, LEADERS = 1024, 4
#: Bins in which the codes of a position are counted, bytes of such counts held at once, the part of a position in which a segment's lines agree.
BINS, FORMS, SAME = 16, 1 << 26, 255
#: Bytes of text hashed at once, lines in a call that compares groups.
CHUNK, LINES_IN_LOT = 1 << 19, 8192
#: Lines in a batch that a pass returns.
LINES_IN_BATCH = 16_384

_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
_MASK, _LEAF = np.uint64(0x5851F42D4C957F2D), np.uint64(0xDA942042E4DD58B5)
_LINES = "row long, check int, doc_id long, pos long, leaf long, line long, n int, segments array<long>, codes binary"


def needed(tokens: Column) -> Column:
    """Documents from which a template of so many tokens recurs."""
    return F.least(F.lit(MIN_DOCS), F.greatest(F.lit(LEAST_DOCS), F.ceil(WEIGHT / tokens)))


def slack(n: np.ndarray) -> np.ndarray:
    """Positions in which two lines of n tokens that share a template may differ."""
    return np.minimum(n - np.ceil(CONSTANT * n - 1e-9).astype(np.int64), FIELDS)


def hashed_lines(raw: bytes) -> tuple[np.ndarray, ...]:
    """(line number, tokens, leaf, line, segments each, segments, codes) of the lines with words among a text's bytes.

    Segments and codes (32 bits a token) are those of lines that may be generalised, one after another.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end = word_places(data)
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    words = byte_hashes(data)(start, end)
    words[digits[end] > digits[start]] = _MASK
    number = np.cumsum(data == 10)[start]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    n = np.diff(np.r_[first, len(words)])
    of = range_hashes(words)
    with np.errstate(over="ignore"):
        leaf = mix(of(first, first + np.minimum(n, DEPTH)) + n.astype(np.uint64) * _LEAF)
        long = n >= MIN_TOKENS
        count = np.where(long, slack(n) + 1, 0)
        every = np.zeros((len(n), FIELDS + 1), dtype=np.uint64)
        parts = np.maximum(count, 1)
        at = lambda k: first + np.minimum(n, DEPTH + k * (n - DEPTH) // parts)
        for k in range(FIELDS + 1):
            on = k < count
            every[on, k] = mix(of(at(k)[on], at(k + 1)[on]) + leaf[on] * _LEAF + np.uint64(k))
    segments = every[np.arange(FIELDS + 1) < count[:, None]]
    return number[first], n, leaf, of(first, first + n), count, segments, words[np.repeat(long, n)].astype(np.uint32)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The lines of a batch of documents, hashed about ``CHUNK`` bytes at once, or a line if that is longer."""
    row, check, doc, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, side="right")))
        some = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
        # A document begins after the newlines of those before it and of the joints between them.
        begins = np.cumsum([0] + [t.count(b"\n") + 1 for t in some])
        raw = b"\n".join(some)
        base = at = 0
        while at < len(raw):
            stop = raw.find(b"\n", at + CHUNK) + 1 or len(raw)
            number, n, leaf, line, count, segments, codes = hashed_lines(raw[at:stop])
            number = number + base
            of = np.searchsorted(begins, number, side="right") - 1
            offsets = np.r_[0, np.cumsum(np.where(count > 0, n, 0) * 4)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[a + of]), pa.array(check[a + of]), doc.take(pa.array(a + of)), pa.array(number - begins[of]),
                    pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)), pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(segments.view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(codes)]),
                ],
                names=["row", "check", "doc_id", "pos", "leaf", "line", "n", "segments", "codes"],
            )
            base += raw.count(b"\n", at, stop)
            at = stop
        a = b


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Few batches of a useful size, as each costs the reader buffers of its own.
    held, rows = [], 0
    for batch in batches:
        for found in _chunks(batch):
            held.append(found)
            rows += len(found)
            if rows >= LINES_IN_BATCH:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def near_lines(codes: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """For lines of one length as rows of token codes, the first line that nearness connects each with.

    Lines of one ``tag`` are known to be connected, and are not compared.
    """
    most = int(slack(np.array([codes.shape[1]]))[0])
    _, first, place = np.unique(tag, return_index=True, return_inverse=True)
    tree = first[place]
    for i in range(1, len(codes)):
        other = np.flatnonzero(tree[:i] != tree[i])
        near = other[(codes[other] != codes[i]).sum(axis=1) <= most] if len(other) else other
        if len(near):
            joined = np.unique(np.r_[tree[near], tree[i]])
            tree[np.isin(tree, joined)] = joined[0]
    return tree


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["segment", "line"]).sort_values(["segment", "line"])
    line, tag = pdf["line"].to_numpy(), pdf["tag"].to_numpy()
    out = [np.empty((0, 2), dtype=np.int64)]
    for _, a, b, codes in _runs(pdf):
        if b - a > 1:
            tree = near_lines(codes, tag[a:b])
            on = np.flatnonzero(tree != np.arange(b - a))
            out.append(np.stack([line[a + tree[on]], line[a + on]], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["u", "v"])


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(segment, from, to, rows of token codes) of every run of one segment."""
    segment, codes = pdf["segment"].to_numpy(), pdf["codes"].tolist()
    edge = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(pdf) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(segment[a]), a, b, np.frombuffer(b"".join(codes[a:b]), dtype=np.uint32).reshape(b - a, -1)


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    return b if a is None else np.concatenate([np.minimum(a[:1], b[:1]), np.maximum(a[1:2], b[1:2]), a[2:] + b[2:]])


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For segments' lines, at each position: the least and the largest code, and how many lines have it in each bin."""
    held, size = {}, 0
    frame = lambda: pd.DataFrame({"segment": list(held), "form": [x.tobytes() for x in held.values()]})
    for pdf in batches:
        for segment, _, _, codes in _runs(pdf.sort_values("segment", kind="stable")):
            bins = [((codes * np.uint32(0x9E3779B1)) >> np.uint32(28) == k).sum(axis=0) for k in range(BINS)]
            size += 0 if segment in held else (BINS + 2) * codes.shape[1] * 8
            held[segment] = _merged(held.get(segment), np.stack([codes.min(axis=0), codes.max(axis=0), *bins]).astype(np.int64))
        if size > FORMS:
            yield frame()
            held, size = {}, 0
    if held:
        yield frame()


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """The part of each position for lines that share a segment, ``SAME`` where all agree; all ``SAME`` if that makes every pair near.

    Two near lines differ in fewer positions than there are parts, so that they agree in one part. Positions that tell most lines apart are
    spread over the parts first.
    """
    form = None
    for x in pdf["form"]:
        form = _merged(form, np.frombuffer(x, dtype=np.int64).reshape(BINS + 2, -1))
    n = form.shape[1]
    most, vary = int(slack(np.array([n]))[0]), np.flatnonzero(form[0] < form[1])
    part = np.full(n, SAME, dtype=np.uint8)
    if len(vary) > most:
        shares = form[2:, vary] / form[2:, vary].sum(axis=0)
        weight = -np.log((shares**2).sum(axis=0))
        load = [(0.0, 0, k) for k in range(most + 1)]
        for i in np.argsort(-weight, kind="stable"):
            least, count, k = min(load)
            load[load.index((least, count, k))] = (least + max(float(weight[i]), 0.0), count + 1, k)
            part[vary[i]] = k
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "part": [part.tobytes()]})


def _deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(segment, line, v): pairs of a line and an elected one near to it, and, where v is the line itself, its places in narrower segments."""
    for pdf in batches:
        pdf = pdf.sort_values("segment", kind="stable")
        out = [np.empty((0, 3), dtype=np.int64)]
        for segment, a, b, codes in _runs(pdf):
            line = pdf["line"].to_numpy()[a:b]
            part, elected = np.frombuffer(pdf["part"].iloc[a], dtype=np.uint8), pdf["elected"].iloc[a]
            most = int(slack(np.array([codes.shape[1]]))[0])
            for top in elected:
                near = line[(codes != np.frombuffer(top["codes"], dtype=np.uint32)).sum(axis=1) <= most]
                near = near[near != top["line"]]
                out.append(np.stack([np.zeros_like(near), near, np.full_like(near, top["line"])], axis=1))
            for k in np.unique(part[part != SAME]).tolist():
                at = np.flatnonzero(part == k)
                with np.errstate(over="ignore"):
                    key = mix(codes[:, at].astype(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * _LEAF).sum(axis=1, dtype=np.uint64)
                    key = mix(key + np.array([segment], dtype=np.int64).view(np.uint64) * _MASK + np.uint64(k))
                out.append(np.stack([key.view(np.int64), line, line], axis=1))
        yield pd.DataFrame(np.concatenate(out), columns=["segment", "line", "v"])


def _tiled(held: DataFrame) -> DataFrame:
    """(segment, line, tag) of segments with ``most``, the tag of most lines and their number: those lines are dealt into tiles of about ``BLOCK``, and all others meet each tile."""
    tiles = F.ceil(F.col("most.n") / BLOCK)
    tile = F.when(F.col("tag") == F.col("most.tag"), F.array(F.pmod("line", tiles))).otherwise(F.sequence(F.lit(0).cast("long"), tiles - 1))
    return held.select("segment", "line", "tag", F.explode(tile).alias("tile")).select(F.xxhash64("segment", "tile").alias("segment"), "line", "tag")


def _narrowed(members: DataFrame, codes: DataFrame, counts: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(pairs of near lines, members: segment, line, tag) such that pairs and nearness within segments connect as nearness among ``members`` does.

    No segment has more than about 2 * ``BLOCK`` lines, other than those of one tag. A larger one gives way to narrower ones, which agree in
    more positions; each varies in fewer than the one before, so this ends. Lines of one tag are connected by the pairs found so far, and are
    not compared: a segment is tiled as soon as all but ``BLOCK`` of its lines are of one tag.
    """
    labels, small, left = None, None, members.withColumn("tag", F.col("line"))
    while True:
        sizes = left.groupBy("segment").agg(F.count("*").alias("c"), F.min("tag").alias("low"), F.max("tag").alias("high"))
        big = cut(sizes.where((F.col("c") > BLOCK) & (F.col("low") < F.col("high"))).select("segment"), "big")
        if big.isEmpty():
            small = left if small is None else small.unionByName(left)
            break
        shares = left.join(big, "segment").groupBy("segment", "tag").agg(F.count("*").alias("n")).groupBy("segment").agg(F.max(F.struct("n", "tag")).alias("most"), F.sum("n").alias("c"))
        shares = cut(shares.select("segment", "most", (F.col("c") - F.col("most.n") > BLOCK).alias("wide")), "shares")
        rest = left.join(big, "segment", "left_anti").unionByName(_tiled(left.join(shares.where("not wide"), "segment")))
        rest = cut(rest, "rest")
        small = rest if small is None else small.unionByName(rest)
        if shares.where("wide").isEmpty():
            break
        voters = cut(left.join(shares.where("wide"), "segment").join(codes, "line").join(counts.select("line", "docs"), "line"), "voters")
        # Lines that most others of the segment are not connected with are elected first, then those of most documents.
        first = (F.col("tag") != F.col("most.tag")) | (F.col("most.n") == 1)
        tops = voters.groupBy("segment", F.pmod("line", F.lit(LEADERS)).alias("seat")).agg(F.max(F.struct(first.alias("first"), "docs", "line", "codes")).alias("top"))
        tops = tops.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("top.line", "top.codes"))).alias("elected"))
        parts = voters.select("segment", "codes").mapInPandas(_forms, "segment long, form binary").groupBy("segment").applyInPandas(_split, "segment long, part binary")
        plans = cut(tops.join(parts, "segment"), "plans")
        dealt = cut(voters.join(plans, "segment").select("segment", "line", "codes", "part", "elected").mapInPandas(_deal, "segment long, line long, v long"), "dealt")
        for done in (voters, plans):
            drop_cut(done)
        found = dealt.where("line <> v").select(F.col("line").alias("u"), "v")
        labels = components(found if labels is None else found.unionByName(labels.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        tagged = dealt.where("line = v").select("segment", "line").join(labels, F.col("line") == F.col("id"), "left")
        left = cut(tagged.select("segment", "line", F.coalesce("component", "line").alias("tag")), "left")
        drop_cut(dealt)
    return None if labels is None else labels.select(F.col("id").alias("u"), F.col("component").alias("v")), small


def similar_lines(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(u, v): lines that share a template, as a table of edges.

    ``lines`` has leaf, line, n, segments, codes for each line of each document, ``counts`` (leaf, line, n,
    docs) each line once. A leaf with one line, or with fewer documents than recur, has nothing to join.
    """
    leaves = counts.where(F.col("n") >= MIN_TOKENS).groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("all"), F.first("n").alias("n"))
    busy = cut(leaves.where((F.col("lines") > 1) & (F.col("all") >= needed(F.col("n")))).select("leaf"), "busy")
    long = flagged(lines.where(F.col("n") >= MIN_TOKENS), busy, "leaf", "_busy").where("_busy")
    each = long.select("line", F.explode("segments").alias("segment"))
    # Most segments have one line; minima combine before the shuffle, so that copies of a line cost one row a partition.
    shared = cut(each.groupBy("segment").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("segment"), "shared")
    members = cut(only_ids(each, shared, "segment").distinct(), "members")
    codes = only_ids(lines.where(F.col("n") >= MIN_TOKENS).select("line", "codes"), members.select("line").distinct(), "line")
    codes = cut(codes.groupBy("line").agg(F.first("codes").alias("codes")), "codes")
    found, members = _narrowed(members, codes, counts)
    apart = members.groupBy("segment").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high").select("segment")
    meet = members.join(apart, "segment").join(codes, "line").withColumn("lot", F.pmod("segment", F.lit(members.count() // LINES_IN_LOT + 1)))
    edges = meet.groupBy("lot").applyInPandas(_compare, "u long, v long")
    return edges if found is None else edges.unionByName(found)


def line_templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines: row, check, doc_id, pos, line, n; recurring: line, template, first) for ``docs`` (row, check, doc_id, text).

    ``line`` is the hash of a masked line; ``first`` the row that keeps its template.
    """
    lines = cut(docs.select("row", "check", "doc_id", "text").mapInArrow(_hash_lines, _LINES), "lines")
    # An upper bound of a line's documents: exact for one, and else too high only by lines repeated within documents.
    met = lines.groupBy("line").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.count("*").alias("times"), F.min("row").alias("low"), F.max("row").alias("high"))
    counts = cut(met.select("line", "leaf", "n", F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("times")).alias("docs")), "counts")
    joined = components(similar_lines(lines, counts)).withColumnRenamed("id", "line")
    templates = counts.join(joined, "line", "left").select("line", F.coalesce("component", "line").alias("template"), "docs", "n")
    # Templates whose lines are in too few documents, though counted too high, do not recur; most of prose goes here.
    busy = templates.groupBy("template").agg(F.sum("docs").alias("all"), F.first("n").alias("n")).where(F.col("all") >= needed(F.col("n"))).select("template")
    templates = cut(templates.select("line", "template", "n").join(busy, "template"), "templates")
    held = cut(only_ids(lines.select("row", "doc_id", "line"), templates.select("line"), "line").join(templates, "line").select("row", "doc_id", "template", "n").distinct(), "held")
    reached = held.groupBy("template").agg(F.count("*").alias("docs"), F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    recurring = reached.where(F.col("docs") >= needed(F.col("n"))).select("template", F.col("first.row").alias("first"))
    recurring = cut(templates.select("line", "template").join(recurring, "template"), "recurring")
    for done in (templates, held):
        drop_cut(done)
    return lines.select("row", "check", "doc_id", "pos", "line", "n"), recurring


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def one(t: str | None, g: np.ndarray) -> str | None:
        g = set(g.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) if g else t

    return pd.Series([one(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and n_lines, n_dropped added.

    Null text stays null; it and empty text have no lines. Blank lines stay. A line stays wherever the first
    document of its template has it, the one of smallest doc_id, null last. Rows equal in doc_id and
    text are one document and treated alike. Texts and lines may have any length. Columns n_lines and n_dropped
    that ``docs`` already has are replaced; any other column, whatever its name, passes through. An empty table gives an
    empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    doc = F.col("d.doc_id").cast("long")
    packed = docs.select(F.struct(*docs.columns).alias("d")).select("d", F.xxhash64(doc, text).alias("row"), F.hash(text).alias("check"))
    lines, recurring = line_templates(packed.select("row", "check", doc.alias("doc_id"), text.alias("text")))
    hit = only_ids(lines.select("row", "check", "pos", "line"), recurring.select("line"), "line").join(recurring.select("line", "first"), "line").where("row <> first")
    hit = cut(hit.groupBy("row", "check").agg(F.collect_set("pos").alias("gone")), "hit")
    # Only texts with something to drop are shuffled; the others pass where they lie.
    parted = flagged(packed, hit.select("row"), "row", "maybe")
    none = F.array().cast("array<long>")
    met = parted.where("maybe").join(hit, ["row", "check"], "left").select("d", F.coalesce("gone", none).alias("gone"))
    kept = parted.where("not maybe").select("d", none.alias("gone"))
    # A line with words is a match from its first character that is no white space.
    n_lines = F.coalesce(F.regexp_count(F.col("d.text").cast("string"), F.lit(r"[^\x20\x09-\x0D][^\n]*+")), F.lit(0)).cast("long")
    shorter = F.pandas_udf(_without, StringType())(F.col("d.text").cast("string"), F.col("gone"))
    columns = lambda new: [(new if c == "text" else F.col("d")[c]).alias(c) for c in docs.columns]
    dropped = F.size("gone").cast("long").alias("n_dropped")
    return kept.select(*columns(F.col("d.text")), n_lines.alias("n_lines"), dropped).unionByName(met.select(*columns(shorter), n_lines.alias("n_lines"), dropped))
