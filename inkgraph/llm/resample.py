"""Importance resampling towards a target: documents are drawn by hashed n-gram likelihood ratios and Gumbel noise.

A document is scanned once: a ring keeps the running zlib states of the last n starts, and each word extends them by a space and itself, so the
checksum of every run of 1 to n words falls out without building the run. Checksums modulo a number of buckets are the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._cluster import cut
from .divergence import pieces

#: Digits, letters (A-Z lower-cased) and bytes of other characters; all else is a space.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Ring:
    """Running states of the runs that end at the last word, by the length of the run."""

    def __init__(self, n: int):
        self.last: list[int | None] = [None] * n

    def feed(self, words: list[bytes]) -> Iterator[list[int]]:
        """States of all runs that end at one of the next words: those of one word, then of two, and so on up to n."""
        spaced = [b" " + w for w in words] if len(self.last) > 1 else []
        states: list[int | None] = list(map(crc32, words))
        for k, before in enumerate(self.last):
            if not words:
                return
            self.last[k] = states[-1]
            yield [x for x in states if x is not None] if None in states[: k + 1] else states
            if k + 1 < len(self.last):
                states = [None if s is None else crc32(w, s) for w, s in zip(spaced, [before, *states[:-1]], strict=True)]


def _buckets(text: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of a text, piece by piece."""
    ring = Ring(n)
    for words in pieces(text, WORD):
        runs = [np.fromiter(x, np.int64, len(x)) for x in ring.feed(words)]
        yield len(words), np.concatenate([*runs, np.zeros(0, np.int64)]) % buckets


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in (part for whole in batches for part in slices(whole, column)):
        yield batch, [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _histogram(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            for text in texts:
                for _, x in _buckets(text, n, buckets):
                    total += np.bincount(x, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def histogram(texts: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; each task sends a number a bucket, and so many reach the driver."""
    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_histogram(n, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + b)) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _weigh(n: int, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 2):
            out = np.zeros((3, len(texts)), np.int64)
            for i, text in enumerate(texts):
                for words, x in _buckets(text, n, len(gain)):
                    out[:, i] += words, len(x), gain[x].sum()
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(x) for x in out]], ["doc_id", "noise", "n_words", "n_features", "weight"])

    return run


def _number(first: dict[int, int], drawn: int):
    """Numbers the rows of each range from where it begins; those beyond the draw get none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = first[batch.column(0)[0].as_py()] + seen + 1 + np.arange(batch.num_rows)
            seen += batch.num_rows
            yield pa.record_batch([*batch.columns[1:], pa.array(at, mask=at > drawn)], [*batch.schema.names[1:], "rank"])

    return run


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters; features are all runs of 1 to n words, joined by a space, repeats
    counted, by their crc32 modulo `buckets`. A bucket's gain compares its share in the texts of target with that in docs (see `gains`), a
    document's weight is the sum of its features' gains, its score the weight plus Gumbel noise drawn from `seed` and its id. Of the
    documents with `least_words` words or more, `percent` per cent (rounded down) with the highest scores are drawn; rank is 1, 2, 3 ... in that
    order, null for the others. Ties go to the smaller id (null last), then to the smaller number of features; rows equal in all are ranked in any order.

    A null or empty text has no features and weight 0. Very long texts are scanned whole, piece by piece. A null id draws its noise from an
    empty one; rows that repeat an id are documents of their own. Empty docs give no rows; an empty target is a uniform one. Columns other than
    id and text, whatever their names, are not read. Jobs run while the plan is built.
    """
    gain = gains(histogram(docs, text, n, buckets), histogram(target, text, n, buckets))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("long").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((draw + 0.5) / 4294967296.0))).cast("long")
    base = docs.select(F.col(id).cast("long").alias("doc_id"), noise.alias("noise"), F.col(text).cast("string").alias("text"))
    weighed = base.mapInArrow(_weigh(n, gain), "doc_id long, noise long, n_words long, n_features long, weight long")
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("row"))
    # ranges of the total order; the last key parts rows that are equal otherwise
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    ranged = cut(cut(scored).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "doc_id", "n_features", "weight", "score", "able"))
    sizes = sorted((r["range"], r["n"], r["able"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect())
    first, at = {}, 0
    for k, size, _ in sizes:  # a number a partition
        first[k] = at
        at += size
    drawn = percent * sum(x[2] for x in sizes) // 100
    return ranged.drop("able").mapInArrow(_number(first, drawn), "doc_id long, n_features long, weight long, score long, rank long")
