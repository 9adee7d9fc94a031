"""Quality classification by positive-unlabelled learning.

Trusted positives are a bounded sample of the rows labelled good; the unlabelled text is every document.
With the share ``prior`` of good text, the risk of a scorer f under the logistic loss is

    prior * mean over positives of loss(f)  +  max(0, mean over all of loss(-f) - prior * mean over positives of loss(-f)),

whose second term, the risk on bad text, is estimated without bad examples and kept non-negative. The
prior is estimated from the same two kinds of text: a scorer that tells half of the positives from all
text ranks both the other half and all text, and the least ratio of their shares above a score bounds the
prior from above, since good text alone already has that share. The scorer is linear in bounded
statistics of the text, their squares and the shares of hashed words. Every step sums risk, gradient and curvature over
all documents where their statistics lie; the driver sees only these sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import byte_hashes, word_places

#: Most trusted positives, steps, weight of the ridge, score from which a document counts as good.
POSITIVES, STEPS, RIDGE, GOOD = 20_000, 12, 3e-3, 0.7
#: Places of hashed words and the weight of their ridge.
PLACES, WORD_RIDGE = 32, 1.0
#: Scores at which shares are compared for the prior, least share of positives above a score that counts, standard errors allowed for.
BINS, LEAST, ERRORS = 400, 0.2, 1.0
#: Bytes of text whose statistics are taken at once.
CHUNK = 1 << 18

_CLASSES = np.zeros(256, dtype=np.int64)
_CLASSES[[*range(97, 123)]] = 1
_CLASSES[[*range(65, 91)]] = 2
_CLASSES[[*range(48, 58)]] = 3
_CLASSES[[32, *range(9, 14)]] = 4
_CLASSES[[*map(ord, ".,;:'\"()?-")]] = 5
_CLASSES[[*map(ord, "!")]] = 6
_CLASSES[[*map(ord, "#$%&*@^~|<>{}[]\\/=+_`")]] = 7
_CLASSES[128:] = 8
N_STATISTICS = 16
WIDTH = N_STATISTICS + PLACES
D = 1 + 2 * N_STATISTICS + PLACES


def statistics(texts: list[str | None]) -> np.ndarray:
    """Bounded statistics of whole texts, a row each; a text without words has zeros but for the one that marks it."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raws])
    data = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)  # a newline ends each text
    m, of = len(raws), np.repeat(np.arange(len(raws)), size + 1)
    kinds = np.bincount(of * 9 + _CLASSES[data], minlength=9 * m).reshape(m, 9).astype(float)
    kinds[:, 4] -= 1
    start, end = word_places(data)
    doc, word = of[start], byte_hashes(data)(start, end)
    n = np.bincount(doc, minlength=m)
    some, each, length = n > 0, np.maximum(n, 1), np.maximum(size, 1)
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    edge = np.flatnonzero(np.r_[len(d) > 0, (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
    times, home = np.diff(np.r_[edge, len(d)]), d[edge]
    most = np.zeros(m)
    np.maximum.at(most, home, times)
    again = np.flatnonzero((doc[1:] == doc[:-1]) & (word[1:] == word[:-1]))
    # Capital letters of Latin scripts: ASCII, and the second byte of those up to U+00DE.
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    capitals = kinds[:, 2] + np.bincount(of[latin], minlength=m)
    out = np.zeros((m, WIDTH))
    # Shares of the kinds of characters, spread out near 0, where most of their meaning lies.
    out[:, :8] = np.sqrt(kinds[:, [2, 3, 4, 5, 6, 7, 8, 0]] / length[:, None])
    out[:, 8] = np.bincount(home, minlength=m) / each
    out[:, 9] = np.sqrt(most / each)
    out[:, 10] = np.sqrt(np.bincount(home, weights=times.astype(float) ** 2, minlength=m)) / each
    out[:, 11] = np.minimum(size / each / 20, 1.0)
    out[:, 12] = np.bincount(doc[again], minlength=m) / each
    out[:, 13] = capitals / length
    out[:, 14] = np.log1p(n) / 12
    place = np.bincount(doc * PLACES + (word >> np.uint64(40)).astype(np.int64) % PLACES, minlength=m * PLACES).reshape(m, PLACES)
    out[:, N_STATISTICS:] = np.sqrt(place / each[:, None])
    out[~some] = 0
    out[~some, 15] = 1
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """A constant, the statistics, their squares and the words' shares."""
    return np.concatenate([np.ones((len(x), 1)), x[:, :N_STATISTICS], x[:, :N_STATISTICS] ** 2, x[:, N_STATISTICS:]], axis=1)


def _read(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t if isinstance(t, str) else None for t in pdf["text"]]
        stop = np.cumsum([len(t or "") for t in texts])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + CHUNK, side="right")))
            x = statistics(texts[a:b]).astype(np.float32)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "x": [r.tobytes() for r in x]}).astype({"doc_id": "Int64"})
            a = b


def _total(run):
    """Sums over a partition as one row, with one of 64 numbers under which rows are added up."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                got = run(expanded(_read(pdf["x"])))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() % 64], "v": [total.tobytes()]})

    return each


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    found = rows.select("x").mapInPandas(_total(run), "g int, v binary").groupBy("g").applyInPandas(_added, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in found), np.zeros(size))


def _sums(weights: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    """Number, sums of loss(-f), its gradient and its curvature."""

    def run(z: np.ndarray) -> np.ndarray:
        z = (z - centre) / scale
        f = z @ weights
        p = 1 / (1 + np.exp(-f))
        return np.concatenate([[len(z), np.logaddexp(0, f).sum()], z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    return run


def _moments(z: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])


def _above(weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, at: np.ndarray):
    """How many rows score at or above each of some values, in rising order."""

    def run(z: np.ndarray) -> np.ndarray:
        f = np.sort(((z - centre) / scale) @ weights)
        return np.r_[len(f), len(f) - np.searchsorted(f, at, side="left")].astype(float)

    return run


def _scaling(every: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    m = _summed(every, _moments, 1 + 2 * D)
    n = max(m[0], 1)
    centre, scale = m[1 : D + 1] / n, np.sqrt(np.maximum(m[D + 1 :] / n - (m[1 : D + 1] / n) ** 2, 0))
    centre[0], scale[0] = 0, 1
    scale[scale < 1e-6] = 1
    return centre, scale


def _pull(ridge: float) -> np.ndarray:
    return np.r_[0, np.full(2 * N_STATISTICS, ridge), np.full(PLACES, WORD_RIDGE)]


def _separate(every: DataFrame, positives: np.ndarray, centre: np.ndarray, scale: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights of the logistic scorer that tells positives from all text, each kind with weight one half."""
    z, w, pull = (expanded(positives) - centre) / scale, np.zeros(D), _pull(ridge)
    for _ in range(steps):
        s = _summed(every, _sums(w, centre, scale), 2 + D + D * D)
        n = max(s[0], 1)
        p = 1 / (1 + np.exp(-(z @ w)))
        gradient = s[2 : 2 + D] / n - z.T @ (1 - p) / len(z)
        curve = s[2 + D :].reshape(D, D) / n + (z * (p * (1 - p))[:, None]).T @ z / len(z)
        move = np.linalg.solve(curve + np.diag(pull + 1e-9), gradient + pull * w)
        w = w - move * min(1.0, 4.0 / max(np.abs(z @ move).max(initial=0), 1e-9))
        if np.abs(move).max() < 1e-3:
            break
    return w


def estimated_prior(every: DataFrame, positives: np.ndarray, centre: np.ndarray, scale: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> float:
    """The share of good text among all text, from positives and unlabelled text alone.

    Every second positive trains a scorer against all text, the others measure it. For every score, all text has at
    least prior times the positives' share above it; so the least ratio of the two shares bounds the prior, and reaches it where bad
    text has none. Shares of few positives are noisy: a share of positives is taken lower by its standard error.
    """
    if len(positives) < 4:
        return 0.5
    w = _separate(every, positives[::2], centre, scale, steps, ridge)
    f = np.sort(((expanded(positives[1::2]) - centre) / scale) @ w)
    at = np.unique(np.quantile(f, np.linspace(0, 1 - LEAST, BINS)))
    got = _summed(every, _above(w, centre, scale, at), 1 + len(at))
    share = (len(f) - np.searchsorted(f, at, side="left")) / len(f)
    error = np.sqrt(np.maximum(share * (1 - share), 0.0) / len(f))
    ratio = got[1:] / max(got[0], 1) / np.maximum(share - ERRORS * error, 1e-9)
    return float(np.clip(ratio.min(), 0.01, 0.99))


def train(every: DataFrame, positives: np.ndarray, prior: float | None = None, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights, centre, scale, prior) that minimise the non-negative risk by damped Newton steps; without a prior it is estimated.

    The minimum lies where the estimated risk on bad text is still positive, or where it reaches 0: beyond, the
    clamp holds it there while only chance differences between positives and all text are fitted. A
    step that would cross that edge by more than the estimate's standard error is halved until it does not, and is the last.
    """
    centre, scale = _scaling(every)
    prior = estimated_prior(every, positives, centre, scale, steps, ridge) if prior is None else prior
    zp = (expanded(positives) - centre) / scale
    w, pull = np.zeros(D), _pull(ridge)
    before, halved = w, False
    for _ in range(steps):
        s = _summed(every, _sums(w, centre, scale), 2 + D + D * D)
        n = max(s[0], 1)
        f = zp @ w
        losses = prior * np.logaddexp(0, f)
        bad = s[1] / n - losses.mean()
        if bad < -losses.std() / np.sqrt(len(f)):  # the term is clamped from here on
            w, halved = (w + before) / 2, True
            continue
        if halved:
            break
        # loss(f) - loss(-f) = -f: the positives' part of the whole risk is linear.
        gradient = s[2 : 2 + D] / n - prior * zp.mean(axis=0)
        curve = s[2 + D :].reshape(D, D) / n
        before = w
        move = np.linalg.solve(curve + np.diag(pull + 1e-9), gradient + pull * w)
        size = np.abs(zp @ move).max(initial=0)
        w = w - move * min(1.0, 4.0 / max(size, 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    # At the minimum scores average to the prior; after an early end the constant still has to see to that.
    for _ in range(6):
        s = _summed(every, _sums(w, centre, scale), 2 + D + D * D)
        n = max(s[0], 1)
        off = s[2] / n - prior
        if abs(off) < 1e-3:
            break
        w = w - np.eye(D)[0] * np.clip(off / max(s[2 + D] / n, 1e-3), -3, 3)
    return w, centre, scale, prior


def _scored(w: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = ((expanded(_read(pdf["x"])) - centre) / scale) @ w
                # Rounded, as a product's last bits depend on the rows that share its batch.
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.round(1 / (1 + np.exp(-np.clip(f, -40, 40))), 12)}).astype({"doc_id": "Int64"})

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = POSITIVES, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), as ``labels`` (doc_id, quality) mark quality.

    Labels are read only where crc32(doc_id as text) mod 4 is not 2, and of those only rows labelled 1: the ``limit`` with
    the smallest hash of doc_id are the trusted positives. A null or empty text has statistics of its own and a score like
    any other; texts may have any length; a null doc_id is not held out. Without a positive every score is 0.5, and repeated rows score
    alike. Other columns are ignored. An empty table gives an empty table.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = cut(docs.mapInPandas(_statistics, "doc_id long, x binary"), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1 and doc_id is not null").where(~held)
    trusted = every.join(known.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(limit).select("x").toPandas()
    if len(trusted):
        w, centre, scale, _ = train(every, _read(trusted["x"]))
        scores = every.mapInPandas(_scored(w, centre, scale), "doc_id long, score double")
    else:
        scores = every.select("doc_id", F.lit(0.5).alias("score"))
    return scores.select("doc_id", held.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= good).cast("int"))
