"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens' spans come from the byte lengths of their ids, and an
interval join of token spans with section spans (both sorted, so a binary search) gives each section its
tokens. A token that crosses a boundary goes, by an explicit rule, to the section with most of its
characters (``most``, ties to the earlier one) or to the one where it starts (``start``). Every token
counts once, so sections add up to the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose token lengths a Python worker remembers at most.
REMEMBERED = 400_000


class TokenLengths:
    """Byte lengths of the tokens of a text, remembered by the words into which the tokenizer splits it."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype="<u2")
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}

    def of(self, text: str) -> np.ndarray:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words, out = self.words, []
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                got = words[w] = self.sizes[self.encoding.encode_ordinary(w)].tobytes()
            out.append(got)
        return np.frombuffer(b"".join(out), dtype="<u2").astype(np.int64)


def attribute(lengths: np.ndarray, raw: bytes, rule: str = "most") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, end, tokens) of each line of a text's bytes; a line holds the newline that ends it."""
    data = np.frombuffer(raw, dtype=np.uint8)
    stops = np.r_[np.flatnonzero(data[:-1] == 10) + 1, len(data)]
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first, last = np.searchsorted(stops, starts, side="right"), np.searchsorted(stops, ends - 1, side="right")
    if rule == "most":
        for t in np.flatnonzero(first != last):
            edges = chars[np.r_[starts[t], stops[first[t] : last[t]], ends[t]]]
            first[t] += int(np.diff(edges).argmax())
    return chars[np.r_[0, stops[:-1]]], chars[stops], np.bincount(first, minlength=len(stops))


_loaded: dict[str, TokenLengths] = {}


def _counts(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:
            _loaded[path] = TokenLengths(path, pattern)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                if raw:
                    start, stop, n = attribute(_loaded[path].of(text), raw, rule)
                    rows.append(pd.DataFrame({"doc_id": doc, "section": np.arange(len(n)), "start": start, "stop": stop, "tokens": n}))
                else:
                    rows.append(pd.DataFrame({"doc_id": [doc], "section": 0, "start": 0, "stop": 0, "tokens": 0}))
                if len(rows) >= 512:
                    yield pd.concat(rows).astype({"doc_id": "Int64"})
                    rows = []
            if rows:
                yield pd.concat(rows).astype({"doc_id": "Int64"})

    return run


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "most") -> DataFrame:
    """doc_id, section (line from 0), start, stop (code points), tokens for every line of every row of ``docs`` (doc_id, text).

    A null or empty text has one empty section. Repeated rows are counted each. Other columns are ignored. An
    empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(_counts(ranks_path, pattern, rule), "doc_id long, section int, start long, stop long, tokens long")
