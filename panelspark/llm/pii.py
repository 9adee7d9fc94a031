"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Patterns of fixed form (e-mail, IP, card, phone) give seeds, each with the whole text of its span. The one to
``CONTEXT`` words before a seed and those after it, in lower case, are lexical patterns; a pattern next to enough
different seeds of one kind enters a graph with all the identifier-like words (those with a digit or an @) next to it
anywhere; number words with single spaces between them are one. Patterns and instances score each other in turn: a pattern
by the share of all occurrences of its words that have confident instances beside them, an instance by the chance that not all of
its patterns err, of which those that share the nearest word count as the best one. Instances of
confident patterns that no form covers are added as spans of the kind; spans of fixed form always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .spans import SPACE, joined, let, spans_where

#: Different seeds that make a word a pattern, score from which patterns and instances count, rounds of scoring.
SEEDS, CONFIDENT, ROUNDS = 5, 0.6, 4

#: Most words of a pattern, on either side.
CONTEXT = 3

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where its first run of characters does, or where the match before it ended; runs are possessive, so that long runs cost linear time.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of number words with single spaces between, as in phones and cards, or a word with a digit or an @.
_NUMBER = r"[+().-]*+[0-9][0-9().+-]*+"
SHAPED = rf"(?<![^{SPACE}])(?:{_NUMBER}(?:\x20{_NUMBER})++(?![^{SPACE}])|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)"
_TRIM = r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$"


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    """Whether digits of 13 to 19 places pass the Luhn check."""
    digits = F.reverse(_digits(word))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _small(word: Column) -> Column:
    """Whether all four parts are at most 255, however many digits they have."""
    return F.forall(F.split(word, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def fixed_forms(text: Column) -> Column:
    """(rank of kind, start, kind, stop, word) of all spans of fixed form, in order."""
    every = (
        spans_where(text, text.contains("@"), EMAIL),
        F.filter(spans_where(text, text.rlike(r"[0-9]\.[0-9]"), IP), lambda s: _small(s["word"])),
        F.filter(spans_where(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD), lambda s: _luhn(s["word"])),
        F.filter(spans_where(text, text.rlike(r"\+[0-9]"), PHONE), lambda s: F.length(_digits(s["word"])).between(9, 15)),
    )
    named = [F.transform(found, lambda s: F.struct(F.lit(r).alias("rank"), s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"), s["word"].alias("word"))) for r, (k, found) in enumerate(zip(KINDS, every, strict=True))]
    return F.concat(*named)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{SPACE}]+"), lambda w: w != "")


def _contexts(words: Column, side: str) -> Column:
    """The one, two, ... ``CONTEXT`` words of an array nearest to its end (L) or start (R), each joined by spaces behind the side's letter; of no words: the letter and a space (L), none (R)."""
    near = (lambda k: F.slice(words, -k, k)) if side == "L" else (lambda k: F.slice(words, 1, k))
    some = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(CONTEXT))), lambda k: F.concat(F.lit(side + " "), F.array_join(near(k), " ")))
    return F.when(F.size(words) > 0, some).otherwise(F.array(F.lit("L  ")) if side == "L" else F.array().cast("array<string>"))


def _shaped(text: Column) -> Column:
    """Identifier-like words with the patterns before and after each."""
    last = lambda words: F.slice(words, F.greatest(F.size(words) - CONTEXT + 1, F.lit(1)), CONTEXT)
    first = lambda words: F.slice(words, 1, CONTEXT)

    def named(cells: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            back = F.slice(cells, F.greatest(i - CONTEXT + 1, F.lit(1)), F.least(i, F.lit(CONTEXT)))
            before = F.concat(F.flatten(F.transform(back, lambda x: F.concat(x["last"], x["own"]))), s["last"])
            after = F.flatten(F.transform(F.slice(cells, i + 2, F.lit(CONTEXT)), lambda x: F.concat(x["first"], x["own"])))
            patterns = F.concat(let(let(before, last), lambda w: _contexts(w, "L")), let(let(after, first), lambda w: _contexts(w, "R")))
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.regexp_replace(s["word"], _TRIM, "").alias("instance"), patterns.alias("patterns"))

        return F.filter(F.transform(cells, one), lambda x: x["start"].isNotNull())

    def cell(s: Column) -> Column:
        return let(_words(s["gap"]), lambda w: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["word"].alias("word"), last(w).alias("last"), first(w).alias("first"), let(_words(F.coalesce(s["word"], F.lit(""))), first).alias("own")))

    found = spans_where(text, text.rlike("[0-9@]"), SHAPED)
    null = F.lit(None)
    # What follows the last one is a cell without a word.
    rest = lambda f: F.substring(text, F.coalesce(F.get(f, F.size(f) - 1)["stop"], F.lit(0)).cast("int") + 1, F.length(text))
    tail = lambda f: F.struct(null.cast("long").alias("start"), null.cast("long").alias("stop"), null.cast("string").alias("word"), rest(f).alias("gap"))
    cells = let(found, lambda f: F.when(F.size(f) > 0, F.transform(F.concat(f, F.array(tail(f))), cell)))
    return F.coalesce(let(cells, named), F.array().cast("array<struct<start: bigint, stop: bigint, instance: string, patterns: array<string>>>"))


def marked(found: DataFrame) -> DataFrame:
    """One row per identifier-like word of ``found`` (row, base, shaped): row, start, stop, instance, patterns, covered, seed_kind.

    A word is covered if a base span overlaps it, and a seed of the kind of the first that opens in it, whose text is then
    the instance. Spans and words meet sorted by start, so that a text with many of both costs no more than sorting them.
    """
    spans = found.select("row", F.inline("base")).select("row", "start", "stop", "kind", "word", F.lit(None).cast("array<string>").alias("patterns"), F.lit(0).alias("is_word"))
    words = found.select("row", F.inline("shaped")).select("row", "start", "stop", F.lit(None).cast("string").alias("kind"), F.col("instance").alias("word"), "patterns", F.lit(1).alias("is_word"))
    every = spans.unionByName(words)
    up = Window.partitionBy("row").orderBy("start", F.desc("is_word")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), "is_word").rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(F.col("is_word") == 0, F.col("stop"))).over(up)
    at = F.last(F.when(F.col("is_word") == 0, F.struct("start", "kind", "word")), ignorenulls=True).over(down)
    every = every.withColumn("before", before).withColumn("at", at).where("is_word = 1")
    opens = F.coalesce(F.col("at.start") < F.col("stop"), F.lit(False))
    covered = opens | F.coalesce(F.col("before") > F.col("start"), F.lit(False))
    return every.select("row", "start", "stop", F.when(opens, F.col("at.word")).otherwise(F.col("word")).alias("instance"), "patterns", covered.alias("covered"), F.when(opens, F.col("at.kind")).alias("seed_kind"))


def graph_scores(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of (pattern, kind) and of (instance, kind) from edges (pattern, kind, instance, seed, n) and totals (pattern, total)."""
    edges = cut(edges, "edges")
    conf = edges.groupBy("instance", "kind").agg(F.max(F.col("seed").cast("double")).alias("conf"))
    for _ in range(rounds):
        scores = edges.join(conf, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("conf")).alias("good")).join(totals, "pattern")
        scores = cut(scores.select("pattern", "kind", F.least(F.col("good") / (F.col("total") + 1), F.lit(0.999)).alias("score")), "patterns")
        # Longer contexts hold the shorter ones, so that those with one nearest word are not independent.
        nearest = F.when(F.col("pattern").startswith("R"), F.concat(F.lit("R "), F.substring_index(F.expr("substring(pattern, 3)"), " ", 1))).otherwise(F.substring_index("pattern", " ", -1))
        best = edges.join(scores, ["pattern", "kind"]).groupBy("instance", "kind", nearest.alias("end")).agg(F.max("seed").alias("seed"), F.max("score").alias("score"))
        conf = best.groupBy("instance", "kind").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("conf"))
        conf = cut(conf.select("instance", "kind", F.when(F.col("seed"), 1.0).otherwise(F.col("conf")).alias("conf")), "instances")
    return scores, conf


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs`` (doc_id, text).

    Counts and digest are those of the fixed forms; ``spans`` also lists the ``n_added`` spans by context. A
    null text counts as empty. Repeated rows are scanned each. Texts may have any length and any number of matches. Other columns, whatever their names, are
    ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.select("doc_id", fixed_forms(F.col("text")).alias("base"), _shaped(F.col("text")).alias("shaped")).withColumn("row", F.monotonically_increasing_id())
    found = cut(found, "found")
    words = marked(found).where("not covered or seed_kind is not null").withColumn("pattern", F.explode("patterns")).drop("patterns")
    words = cut(words, "words")
    seeds = words.where(F.col("seed_kind").isNotNull())
    patterns = seeds.groupBy("pattern", F.col("seed_kind").alias("kind")).agg(F.countDistinct("instance").alias("support")).where(F.col("support") >= SEEDS).select("pattern", "kind")
    patterns = cut(patterns, "patterns")
    # A context on either side is a run of words; every run in the texts is met at its first word, which few words are.
    # A pattern without words is that of identifiers that open a text.
    sought = patterns.select(F.expr("substring(pattern, 3)").alias("run"), F.expr("substring(pattern, 1, 2)").alias("side"), "pattern").distinct()
    heads = sought.where("run <> ' '").select(F.substring_index("run", " ", 1).alias("w0")).distinct()
    shifted = lambda w: F.arrays_zip(w.alias("w0"), *(F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))).alias(f"w{k}") for k in range(1, CONTEXT)))
    rows = docs.select(_words(F.col("text")).alias("w")).select(F.inline(shifted(F.col("w")))).toDF(*(f"w{k}" for k in range(CONTEXT))).join(heads, "w0")
    runs = F.array(*(F.concat_ws(" ", *(F.col(f"w{k}") for k in range(n + 1))) for n in range(CONTEXT)))
    # A text's last words begin no longer runs.
    whole = F.array(*(F.col(f"w{n}").isNotNull() for n in range(CONTEXT)))
    every = rows.select(F.explode(F.filter(F.zip_with(runs, whole, lambda r, x: F.when(x, r)), lambda r: r.isNotNull())).alias("run"))
    open_ended = docs.where(F.col("text").rlike(f"[^{SPACE}]")).select(F.lit(" ").alias("run"))
    counted = every.join(sought.select("run").distinct(), "run").unionByName(open_ended).groupBy("run").agg(F.count("*").alias("total"))
    totals = sought.join(counted, "run").select("pattern", "total")
    edges = words.join(patterns, "pattern").where("not covered or seed_kind = kind").groupBy("pattern", "kind", "instance").agg(F.max(F.col("covered")).alias("seed"), F.count("*").alias("n"))
    scores, conf = graph_scores(edges, cut(totals, "totals"))
    good = conf.where(F.col("conf") >= CONFIDENT).join(edges.where("not seed").select("pattern", "kind", "instance"), ["instance", "kind"]).join(scores.where(F.col("score") >= CONFIDENT), ["pattern", "kind"])
    best = good.select("pattern", "instance", "kind", "score")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    hits = words.where("not covered").join(best, ["pattern", "instance"]).groupBy("row", "start", "stop", "instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    added = hits.select("row", F.struct(rank.alias("rank"), F.col("start"), F.col("kind"), F.col("stop"), F.col("instance").alias("word")).alias("s")).groupBy("row").agg(F.collect_list("s").alias("added"))
    both = found.select("doc_id", "base", "row").join(added, "row", "left")
    both = both.withColumn("all", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(added.schema["added"].dataType)))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return both.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
