"""Best-fit packing by a configuration linear program.

Documents become token ids (an end id after each); only those longer than ``capacity`` are cut. Pieces
matter by length alone, so the program works on the histogram of lengths: a configuration is a
multiset of lengths that fits a sequence, and the program covers every length's count by as few
configurations as possible. Multiplicative weights solve it: each length has a price, a knapsack dynamic
program finds the most valuable configurations at these prices, and prices of lengths that are behind
in coverage grow. Coverage is rounded down to whole pieces, and the few pieces left are packed best-fit
decreasing, again on the histogram. The driver holds histogram and configurations (both bounded by ``capacity``), never pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rounds of multiplicative weights, each with one knapsack; levels to which coverage rises in turn.
ROUNDS, LEVELS = 96, 8
#: Growth of the weight of a length behind in a round, share of the best value that a configuration may lack.
STEP, NEAR = 0.002, 0.001
#: What a piece costs in tokens, to prefer configurations of few pieces among equally full ones.
EACH = 0.01
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 400_000

#: Characters for which the shortcut below provably does what the tokenizer does: white space, printable ASCII, Latin letters.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-įı-ſ]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+")


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, remembered by word.

    The tokenizer splits lower-cased text into words and encodes each alone, so its ids are those of the
    words in order. Texts with characters outside ``_OTHER``'s range or with the spelling of a special token go to
    the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: For words alone: their bytes are spelt out here, and the id that ends a word shows where the next begins.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = Sequence([]), WhitespaceSplit()
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: "".join(x for x, _ in split.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x180)}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if _OTHER.search(text) or any(s in text for s in self.special):
                out[i] = self._whole(text)
            else:
                split[i] = _PIECE.findall(text.lower())
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words = self.words
        new = list({w for found in split.values() for w in found if w not in words})
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            ids = np.array(self.plain.encode(" ".join(part).translate(self.spelt), add_special_tokens=False).ids, dtype="<u4")
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            words.update((w, raw[i:j]) for w, i, j in zip(part, [0, *stop[:-1].tolist()], stop.tolist(), strict=True))
        for i, found in split.items():
            out[i] = b"".join([words[w] for w in found])
        return out


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _pieces(path: str, capacity: int, end: int):
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, part, seen = word_ids(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for pdf in batches:
            rows = []
            texts = pdf["text"].tolist()
            for at in range(0, len(texts), 256):
                for doc, raw in zip(pdf["doc_id"].tolist()[at : at + 256], ids.batch([t if isinstance(t, str) else "" for t in texts[at : at + 256]]), strict=True):
                    raw += last
                    total = len(raw) // 4
                    for k, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        rows.append((doc, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, int(seen[length])))
                        seen[length] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]).astype({"doc_id": "Int64"})

    return run


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, took): the greatest value that fits each room, and a length that an optimal filling of it takes (0: none)."""
    capacity = len(price) - 1
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(price > 0)[::-1]  # of equal values the one with the longest piece
    gain = price[lengths]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        a = int(np.searchsorted(-lengths, -c))
        if a < len(lengths):
            value = gain[a:] + best[c - lengths[a:]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], took[c] = value[k], lengths[a + k]
    return best, took


def filling(took: list[int], room: int, left: np.ndarray, first: int) -> list[int]:
    """``first`` and the lengths of an optimal filling of the room beside it; a length that ``left`` no longer has gives way to the longest that it has."""
    out, used = [first], {first: 1}
    while room > 0:
        x = took[room]
        if not x:
            room -= 1
            continue
        if used.get(x, 0) >= left[x]:
            have = left[: room + 1].copy()
            for y, n in used.items():
                if y <= room:
                    have[y] -= n
            fits = np.flatnonzero(have > 0)
            if not len(fits):
                break
            x = int(fits[-1])
        out.append(x)
        used[x] = used.get(x, 0) + 1
        room -= x
    return out


def configuration_program(count: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], float]:
    """(configurations with how many sequences take each, a lower bound of the sequences that any packing needs).

    The covering program asks that every length's count be covered. Its dual prices lengths so that no configuration is
    worth more than 1; the knapsack gives the worth of the best, and so from any prices a bound. Coverage rises
    in ``LEVELS`` equal steps, rounded down to whole pieces, so that amounts are whole too. In a round one knapsack
    yields for every length behind the level the best configuration that holds it; those within ``NEAR`` of the
    best of all are taken as often as none of their lengths passes the level. Weights of lengths still behind grow by
    the factor ``exp(STEP)``, so that the next round's configurations prefer them.
    """
    capacity = len(count) - 1
    need, lengths = count.astype(np.int64), np.arange(capacity + 1)
    made = np.zeros_like(need)
    amounts: dict[tuple[int, ...], int] = {}
    worth = np.where(need > 0, lengths, 0).astype(float)
    bound = float((need * worth).sum() / knapsack(worth)[0][capacity]) if need.any() else 0.0
    for level in range(1, LEVELS + 1):
        target, weight = need * level // LEVELS, np.ones(capacity + 1)
        for _ in range(max(1, rounds // LEVELS)):
            behind = np.flatnonzero(made < target)
            if not len(behind):
                break
            # A length at its level has no price until the next one; each piece costs a little, so that configurations have few.
            price = np.where(made < target, lengths * weight - EACH, 0.0)
            best, took = knapsack(price)
            bound = max(bound, float((need * price).sum() / best[capacity]))
            steps, before, left = took.tolist(), made, target - made
            for x in behind[np.argsort(-price[behind], kind="stable")].tolist():
                if not left[x] or price[x] + best[capacity - x] < (1 - NEAR) * best[capacity]:
                    continue
                chosen = filling(steps, capacity - x, left, x)
                if sum(chosen) >= capacity * (1 - NEAR):
                    kept, times = np.unique(chosen, return_counts=True)
                    n = int((left[kept] // times).min())
                    amounts[tuple(sorted(chosen))] = amounts.get(tuple(sorted(chosen)), 0) + n
                    left[kept] -= n * times
            made = target - left
            if (made == before).all():
                break
            weight[made < target] *= np.exp(STEP)
    return [(np.array(c), n) for c, n in amounts.items()], bound


def pack_histogram(count: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations with how many sequences take each; together they hold exactly ``count`` pieces of each length."""
    left = count.astype(np.int64).copy()
    out, _ = configuration_program(left, rounds)
    for chosen, n in out:
        np.subtract.at(left, chosen, n)
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Fills one sequence shape after another: the longest piece left, then always the longest that still fits, repeated while pieces last."""
    capacity = len(left) - 1
    left = left.copy()
    out = []
    while left.any():
        room, chosen = capacity, {}
        while room:
            fits = np.flatnonzero(left[: room + 1])
            while len(fits) and left[fits[-1]] <= chosen.get(int(fits[-1]), 0):
                fits = fits[:-1]
            if not len(fits):
                break
            longest = int(fits[-1])
            chosen[longest] = chosen.get(longest, 0) + 1
            room -= longest
        n = min(int(left[x]) // t for x, t in chosen.items())
        for x, t in chosen.items():
            left[x] -= n * t
        out.append((np.repeat(list(chosen), list(chosen.values())), n))
    return out


def _placed(keys: np.ndarray, first: np.ndarray, each: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    """Sequence and offset of a piece by its rank among pieces of its length; a plan row holds ``each`` of them per sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["before"].to_numpy() + pdf["nth"].to_numpy()
            row = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            over = rank - first[row]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence[row] + over // each[row], offset=offset[row] + (over % each[row]) * length)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each; a null doc_id stays null.
    Other columns are ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.mapInPandas(_pieces(tokenizer, capacity, end), kind + ", part int, nth long"), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("c")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("c").alias("c")).collect():
        histogram[row["length"]] = row["c"]
    plan, used, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for chosen, n in pack_histogram(histogram):
        offset = 0
        for length, times in zip(*np.unique(chosen, return_counts=True), strict=True):
            plan.append(((int(length) << 44) + int(used[length]), int(used[length]), int(times), sequence, offset))
            used[length] += n * times
            offset += int(length * times)
        sequence += n
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    before = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    return known.mapInPandas(_placed(*rows.T), kind + ", sequence_id long, offset long")
