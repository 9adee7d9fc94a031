"""Spans of regular expressions in DataFrame operations: leftmost, non-overlapping, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SPANS = "array<struct<start: bigint, stop: bigint, word: string, gap: string>>"


#: Matches that one fold handles; folds of folds keep the cost of many matches near linear.
CHUNK = 256


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though ``use`` names it often or within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """Every match as (start, stop, word: the match, gap: the text between it and the match before it).

    The text is split at the matches, so that lengths of gaps and matches in turn give the places.
    """
    pairs = let(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word")))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["gap"])
        stop = begin + F.length(p["word"])
        return F.struct(stop.cast("long").alias("at"), F.concat(s["out"], F.array(F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop"), p["word"].alias("word"), p["gap"].alias("gap")))).alias("out"))

    def chunk(s: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(s["at"].alias("at"), F.array().cast(SPANS).alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    def chunks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) + CHUNK - 1) / CHUNK).cast("int")), lambda k: F.slice(p, k * CHUNK + 1, F.lit(CHUNK)))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(let(pairs, chunks), start, chunk, lambda s: F.flatten(s["out"]))


def spans_where(text: Column, maybe: Column, pattern: str) -> Column:
    """``spans`` where the cheaper test ``maybe`` holds, which every match implies; none elsewhere."""
    return F.when(maybe, spans(text, pattern)).otherwise(F.array().cast(SPANS))


def joined(found: Column) -> Column:
    """kind:start:stop of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
