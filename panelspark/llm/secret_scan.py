"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text is a version under some path. A version's address is the SHA-256 of its content; a ledger
holds (blob, rules, found) for each blob that a version of the rules has scanned. A scan reads only
pairs of blob and rules that the ledger lacks, each blob once however many paths hold it, appends them to the ledger,
and joins findings back to all paths. Rules come in packs; a pack's address is the SHA-256 of its text, so that a
changed pack makes every blob unseen again under it, and only under it. Texts are scanned where they
lie: what moves are addresses, and the texts of the few rows that may repeat a blob or be in the ledger.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flagged, run_dir
from .spans import joined, spans_where

#: A kind, what a text with a match contains, the pattern, and the part whose length counts with its least.
Rule = tuple[str, str, str, int, int]
BASE: tuple[Rule, ...] = (
    ("assign", r"(?i)password|passwd|secret|token|api_?key", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 0, 16),
)
#: Published formats of keys and tokens: PEM headers, prefixed tokens of code hosts, chat and payment services, signed web tokens, credentials in addresses and headers.
FORMATS: tuple[Rule, ...] = (
    ("pem", r"-----BEGIN", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----", 0, 1),
    ("prefixed", r"gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk_live_|rk_live_|AIza", r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})", 0, 1),
    ("signed", r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1),
    ("address", r"://", r"[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D/:@]{1,64}:([^\x20\x09-\x0D/:@]{1,256})@", 1, 6),
    ("bearer", r"(?i)bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]{20,}+)", 1, 20),
)
#: Packs in the order in which kinds are listed.
PACKS: tuple[tuple[Rule, ...], ...] = (BASE, FORMATS)
RULES = BASE


def rules_address(rules: tuple = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def findings(text: Column, rules: tuple = RULES, first: int = 0) -> Column:
    """(start, rank of kind, kind, stop) of every secret, in order; ranks count from ``first``."""
    parts = []
    for rank, (kind, maybe, pattern, group, least) in enumerate(rules, first):
        found = F.filter(spans_where(text, text.rlike(maybe), pattern), lambda s: F.length(F.regexp_extract(s["word"], pattern, group)) >= least)  # noqa: B023
        parts.append(F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"))))  # noqa: B023
    return F.array_sort(F.concat(*parts))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(versions with ``blob`` and ``found`` in place of ``text``, rows to append to the ledger).

    ``versions`` has a text column and any others. A null text is the empty blob. Rows with equal texts have
    equal findings. A blob without findings is in the ledger with an empty array, so it is not read again.
    """
    address = rules_address(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = F.xxhash64(*(c for c in versions.columns if c != "text"))
    addressed = versions.withColumn("text", text).withColumn("blob", F.sha2(F.col("text"), 256)).withColumn("_path", path)
    places = cut(addressed.drop("text"), "places")
    one = places.groupBy("blob").agg(F.min("_path").alias("_path"))
    seen = None
    if ledger is not None:
        seen = ledger.where(F.col("rules") == address).select("blob", "found")
        one = one.join(seen.select("blob"), "blob", "left_anti")
    # Every other row repeats a blob or is known: its text is not scanned. The rows that the filter flags wrongly decide the join.
    other = places.select("blob", "_path").distinct().join(one, ["blob", "_path"], "left_anti").withColumn("_row", F.xxhash64("blob", "_path"))
    parted = flagged(addressed.select("blob", "_path", "text").withColumn("_row", F.xxhash64("blob", "_path")), other, "_row", "_maybe")
    fresh = parted.where("not _maybe").select("blob", "text").unionByName(parted.where("_maybe").join(one.hint("shuffle_hash"), ["blob", "_path"], "left_semi").select("blob", "text"))
    fresh = fresh.select("blob", F.lit(address).alias("rules"), findings(F.col("text"), rules, first).alias("found"))
    # Wholly equal rows share a path: both are read, one stays.
    fresh = cut(fresh.dropDuplicates(["blob"]), "ledger")
    known = fresh.select("blob", "found")
    if seen is not None:
        known = known.unionByName(seen)
    known = known.where(F.size("found") > 0)
    none = F.array().cast(fresh.schema["found"].dataType)
    return places.drop("_path").join(known, "blob", "left").withColumn("found", F.coalesce("found", none)), fresh


class Ledger:
    """A ledger kept as files in a folder that all executors see; each scan appends to it."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.kind = "blob string, rules string, found array<struct<start: bigint, rank: int, kind: string, stop: bigint>>"

    def read(self) -> DataFrame:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(self.path)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("blob", "rules", "found").write.mode("append").parquet(self.path)


def scan_increment(versions: DataFrame, ledger: Ledger, packs: tuple = PACKS) -> DataFrame:
    """``versions`` with ``found`` of all packs; the ledger gains the pairs of blob and pack that it lacked.

    A span of a later pack that overlaps one of an earlier pack is left out, as the place is reported already.
    """
    known, columns, first = versions, [c for c in versions.columns if c != "text"], 0
    out = None
    for rules in packs:
        found, fresh = scan(known, ledger.read(), rules, first)
        ledger.append(fresh)
        found = found.select(*columns, "blob", "found")
        if out is None:
            out = found
        else:
            # One set of findings a blob, so that repeated rows do not multiply.
            more = found.where(F.size("found") > 0).select("blob", F.col("found").alias("_more")).dropDuplicates(["blob"])
            apart = F.filter("_more", lambda m: ~F.exists("found", lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"])))
            out = out.join(more, "blob", "left").withColumn("found", F.when(F.col("_more").isNull(), F.col("found")).otherwise(F.array_sort(F.concat("found", apart)))).drop("_more")
        first += len(rules)
    return out


def secret_spans(docs: DataFrame, ledger: Ledger | None = None, increments: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    The versions come in ``increments``, dealt by a hash of doc_id, each scanned against the ledger that those before
    it have written; without a ledger a new one is begun. Counts and digest are those of the base pack; ``spans`` lists all
    packs' findings by start. A null text counts as empty. Repeated rows have a row each. Texts may have any length. Other columns are ignored. An empty
    table gives an empty table.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(increments))
    found = None
    for k in range(increments):
        part = scan_increment(versions.where(turn == k), ledger)
        found = part if found is None else found.unionByName(part)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *(count(r[0]) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"))
