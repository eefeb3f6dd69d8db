"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of
all vote patterns (at most 3^10, counted over all documents) estimates each labeller's accuracy on good and on bad texts, and so a
posterior for each pattern. A linear scorer over hashed character trigrams and hashed statistics is then trained on the
posteriors of a bounded sample, and scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

BUCKETS = 1 << 16
ASCII = np.arange(256)
UPPER = (ASCII >= 65) & (ASCII <= 90)
LETTER = UPPER | ((ASCII >= 97) & (ASCII <= 122)) | (ASCII >= 128)
DIGIT = (ASCII >= 48) & (ASCII <= 57)
SYMBOL = np.isin(ASCII, np.frombuffer(b"#$%&*@^_~<>{}[]\\=+`|", np.uint8))
BANG = ASCII == ord("!")
LOWER = LETTER & ~UPPER
STOP = np.isin(ASCII, np.frombuffer(b".,;:?", np.uint8))
#: Of each statistic: the bound beyond which a labeller calls a text bad, and good (None: never), and whether high is bad.
STATS = {
    "symbols": (0.05, None, True),
    "capitals": (0.5, None, True),
    "bangs": (0.03, None, True),
    "digits": (0.3, None, True),
    "shingles": (0.5, None, False),
    "lines": (0.6, None, False),
    "plain": (0.7, 0.9, False),
    "short": (0.08, 0.15, False),
    "echoes": (0.1, None, True),
    "runs": (0.2, None, True),
}


def statistics(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by STATS, NaN where there is nothing to go by; bytes and offsets."""
    data, off = B.buffer_of(column)
    n = len(off) - 1

    def share(table: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        count = np.diff(np.concatenate([[0], np.cumsum(table[data])])[off])
        whole = np.diff(off) if of is None else np.diff(np.concatenate([[0], np.cumsum(of[data])])[off])
        return np.where(whole > 0, count / np.maximum(whole, 1), np.nan)

    starts, ends, first = B.words(data, off)
    words = np.diff(first)
    hashes = B.word_hashes(data, starts, ends, 21)
    at = B.inside(first, 3)
    total = np.maximum(words - 2, 0)
    owner = np.repeat(np.arange(n), total)
    window = B.window_hashes(hashes, 3, 22)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((window, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (window[order][1:] != window[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n)
    texts = column.to_pylist()
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    out = np.full((n, len(STATS)), np.nan)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = share(SYMBOL), share(UPPER, LETTER), share(BANG), share(DIGIT)
    out[:, 4] = np.where(total >= 10, distinct / np.maximum(total, 1), np.nan)
    out[:, 5] = [len(set(x)) / len(x) if len(x) >= 4 else np.nan for x in lines]
    # plain: a letter, then lower-case letters, then a stop or not; short: such a word of at most three bytes
    odd = np.concatenate([[0], np.cumsum(~LOWER[data])])
    last = ends - STOP[data[ends - 1]] if len(ends) else ends
    plain = (last > starts) & LETTER[data[starts]] & (odd[last] == odd[np.minimum(starts + 1, last)])
    counts = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    enough = words >= 10
    out[:, 6] = np.where(enough, counts(plain) / np.maximum(words, 1), np.nan)
    out[:, 7] = np.where(enough, counts(plain & (last - starts <= 3)) / np.maximum(words, 1), np.nan)
    # echoes: words equal to the one before; runs: to one of the four before
    again = np.zeros((4, len(hashes)), bool)
    for k in range(1, 5):
        again[k - 1, k:] = hashes[k:] == hashes[:-k]
        edge = B.ranges(first[:-1], np.minimum(words, k))
        again[k - 1, edge] = False
    out[:, 8] = np.where(enough, counts(again[0]) / np.maximum(words, 1), np.nan)
    out[:, 9] = np.where(enough, counts(again.any(axis=0)) / np.maximum(words, 1), np.nan)
    return out, data, off


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 nothing."""
    out = np.full(stats.shape, -1, np.int8)
    for j, (bad, good, high) in enumerate(STATS.values()):
        s = stats[:, j]
        out[(s > bad) if high else (s < bad), j] = 0
        if good is not None:
            out[(s < good) if high else (s > good), j] = 1
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpattern(p: np.ndarray, n: int) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(n) % 3).astype(np.int8) - 1


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good texts, and for each labeller the chances of its votes (bad, good, nothing) on bad and on good texts.

    Expectation-maximisation with votes that are independent given the class. Labellers start out right in four of five votes, and
    a prior of ten votes like that keeps one that never speaks where it is.
    """
    share = 0.8
    start = np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])
    chance = np.tile(start, (v.shape[1], 1, 1))
    for _ in range(rounds):
        p = posterior(v, share, chance)
        share = float(np.clip((p * count).sum() / max(count.sum(), 1), 0.001, 0.999))
        for c, weight in enumerate(((1 - p) * count, p * count)):
            n = np.stack([(weight[:, None] * (v == k)).sum(axis=0) for k in (0, 1, -1)], axis=1) + 10 * start[c]
            chance[:, c] = n / n.sum(axis=1, keepdims=True)
    return share, chance


def posterior(v: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """Chance that a text with these votes is good."""
    log = np.log(chance)[np.arange(v.shape[1])[None, :], :, v.astype(np.int64)].sum(axis=1)
    return 1 / (1 + np.exp(log[:, 0] - log[:, 1] + np.log((1 - share) / share)))


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that starts at each place but the last two."""
    d = data.astype(np.uint32)
    h = (d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int32)


def stat_buckets(stats: np.ndarray) -> np.ndarray:
    """A bucket for each statistic: its number and which twentieth of its range it lies in, or that it is missing."""
    step = np.where(np.isnan(stats), 31, np.clip(np.nan_to_num(stats) * 20, 0, 20).astype(int))
    return (B.mix64((np.arange(stats.shape[1]) * 64 + step + (1 << 32)).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, column) -> np.ndarray:
        stats, data, off = statistics(column)
        sums = np.zeros(len(off) - 1)
        for lo in range(0, max(len(data) - 2, 0), B.STEP):
            w = np.concatenate([[0.0], np.cumsum(self.weights[grams(data[lo : lo + B.STEP + 2])])])
            a = np.clip(off[:-1] - lo, 0, len(w) - 1)
            b = np.clip(np.maximum(off[1:] - 2, off[:-1]) - lo, 0, len(w) - 1)
            sums += w[b] - w[a]
        n = np.maximum(np.diff(off) - 2, 0)
        z = self.bias + sums / np.maximum(n, 1) * GAIN + self.weights[stat_buckets(stats)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: A sampled text brings up to so many trigram buckets to the driver: 33 KB, so `sample` texts some 100 MB at most. Scoring sums over all.
MOST_GRAMS = 4096
#: A text's trigram shares are small; this brings their sum near that of the statistics.
GAIN = 20.0


def train(rows: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets by full-batch Adam over sparse rows."""
    w, b = np.zeros(BUCKETS), 0.0
    if not len(target):
        return Scorer(w, b)
    index, value = np.concatenate(rows), np.concatenate(shares)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[index] * value, len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(target)
        g = np.append(np.bincount(index, value * error[owner], BUCKETS) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return Scorer(w, b)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in B.slices(whole, 0)):
        p, n = np.unique(pattern(votes(statistics(batch.column(0))[0])), return_counts=True)
        yield pa.record_batch([pa.array(p), pa.array(n.astype(np.int64))], ["pattern", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in B.slices(whole, 0)):
        stats, data, off = statistics(batch.column(0))
        extra = stat_buckets(stats)
        rows = []
        for i in range(batch.num_rows):
            part = data[off[i] : off[i + 1]]
            k, n = np.unique(grams(part), return_counts=True) if len(part) > 2 else (np.zeros(0, np.int64), np.zeros(0))
            value = n / max(n.sum(), 1) * GAIN
            if len(k) > MOST_GRAMS:  # some of them, by a hash, stand for all
                some = np.sort(np.argsort(B.mix64(k.astype(np.uint64) + np.uint64(len(part))))[:MOST_GRAMS])
                k, value = k[some], value[some] * (value.sum() / value[some].sum())
            rows.append((np.concatenate([k, extra[i]]).astype("<i4").tobytes(), np.concatenate([value, np.ones(extra.shape[1])]).astype("<f4").tobytes()))
        yield pa.record_batch([pa.array(pattern(votes(stats))), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column(1)], ["pattern", "index", "share", "draw"])


def fit_quality(docs: DataFrame, text: str = "text", sample: int = 3000) -> Scorer:
    """EM over the votes on all texts, then the scorer on `sample` distinct ones of them, or all (a hash of the text decides which).

    Rows and bytes that reach the driver are bounded: 1.2 times `sample` rows of up to MOST_GRAMS buckets.
    """
    base = docs.select(F.col(text).cast("string").alias("text"))
    counted = base.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    v = unpattern(np.array([r["pattern"] for r in counted], np.int64), len(STATS))
    n = np.array([r["n"] for r in counted], np.float64)
    share, chance = estimate(v, n)
    draw = F.pmod(F.xxhash64("text", F.lit("quality")), F.lit(1 << 40))
    # copies of one text have one draw: each distinct text is used once, and the distinct texts set the rate, whatever they repeat
    texts = base.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0]
    some = base.where(draw < int(min(1.0, 1.2 * sample / max(texts, 1)) * (1 << 40))).distinct().withColumn("draw", draw)
    rows = some.mapInArrow(_features, "pattern long, index binary, share binary, draw long").collect()
    # the smallest draws, so that reruns agree
    rows = sorted(rows, key=lambda r: (r["draw"], r["index"], r["share"]))[:sample]
    target = posterior(unpattern(np.array([r["pattern"] for r in rows], np.int64), len(STATS)), share, chance)
    return train([np.frombuffer(r["index"], "<i4") for r in rows], [np.frombuffer(r["share"], "<f4").astype(float) for r in rows], target)


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.5, sample: int = 3000) -> DataFrame:
    """doc_id, quality, kept: one row for each row of docs; kept if the scorer gives at least `least`.

    A null text is empty; all empty texts get the same score, from the bias and the missing statistics. The corpus statistics
    cover all rows; the scorer is trained on `sample` distinct texts, or on all if they are fewer. Ids are passed on as they are, null and repeated ones
    too; equal texts get equal scores. A very long text is scored whole. Columns other than id and text, whatever their names, are not
    read. An empty table gives no rows. Jobs run while the plan is built.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, text, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, 1)):
            yield pa.record_batch([batch.column(0), pa.array(scorer.value.score(batch.column(1)))], ["doc_id", "quality"])

    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, quality double").withColumn("kept", F.col("quality") >= least)
