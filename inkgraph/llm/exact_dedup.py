"""Exact dedup by content-defined chunk recipes.

A text, without its white space, is cut where a rolling hash of 32 bytes hits a pattern. Chunks get
identifiers; a job that compares the bytes of all chunks with one identifier proves that each stands for
one byte string (else the identifiers are drawn anew with another seed). A document is then its ordered
list of identifiers, and equal lists are equal texts: a document's bytes move once, as chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._cluster import cut, join_groups

WINDOW, MEAN_BITS, LONGEST = 32, 11, 1 << 16


def solid(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without white space, and offsets."""
    data, off = B.buffer_of(column)
    keep = ~B.SPACE[data]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def cuts(data: np.ndarray, off: np.ndarray, mean_bits: int = MEAN_BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and for each text the index of its first chunk (one more at the end).

    A cut depends on the 32 bytes before it alone, which lie in the text. Gaps over `longest` are split evenly
    from their start. An empty text has no chunk.
    """
    table = (B.mix64(np.arange(256, dtype=np.uint64) + np.uint64(99)) >> np.uint64(32)).astype(np.uint32)
    found = []
    for lo in range(0, len(data), B.STEP):
        h = table[data[max(0, lo - WINDOW + 1) : lo + B.STEP]]
        factor, width = 0x01000193, 1
        while width < WINDOW:
            h[width:] += h[:-width] * np.uint32(factor)
            factor, width = factor * factor % (1 << 32), width * 2
        hit = np.flatnonzero((h >> np.uint32(32 - mean_bits)) == 0) + max(0, lo - WINDOW + 1) + 1
        found.append(hit[hit > lo])
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    at = at[at - off[np.searchsorted(off, at, "left") - 1] >= WINDOW]
    ends = np.union1d(at, off[1:][np.diff(off) > 0])
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > longest:
        big = np.flatnonzero(gaps > longest)
        more = [np.arange(ends[i] - gaps[i] + longest, ends[i], longest) for i in big]
        ends = np.union1d(ends, np.concatenate(more))
    return ends, np.searchsorted(ends, off, "right")


def _names(seed: int, size: int):
    return lambda b: xxhash.xxh3_128_digest(b, seed=seed)[:size]


def _chunks(text: str, seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _names(seed, size)
        for batch in (part for whole in batches for part in B.slices(whole, 0)):
            data, off = solid(batch.column(0))
            ends, _ = cuts(data, off)
            view, seen, lo = memoryview(data), set(), 0
            for hi in ends.tolist():
                seen.add((name(view[lo:hi]), bytes(view[lo:hi])))
                lo = hi
            if seen:
                yield pa.record_batch([pa.array([x[i] for x in seen], pa.binary()) for i in (0, 1)], ["name", "chunk"])

    return run


def _recipes(seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _names(seed, size)
        for batch in (part for whole in batches for part in B.slices(whole, 1)):
            data, off = solid(batch.column(1))
            ends, first = cuts(data, off)
            view, starts, sha, recipe = memoryview(data), np.concatenate([[0], ends]).tolist(), [], []
            for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                sha.append(hashlib.sha256(view[a:b]).hexdigest())
                recipe.append(b"".join([name(view[starts[k] : starts[k + 1]]) for k in range(i, j)]))
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), points, pa.array(sha), pa.array(recipe, pa.binary())], ["doc_id", "points", "text_sha256", "recipe"])

    return run


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", name_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal if they are the same without space and 0x09-0x0D. Of equal texts the one with the most code
    points stays, then the smallest id. A null text is empty; empty texts and those of white space alone are equal.
    A null id counts as larger than any other. Rows that repeat an id: all that equal the one that stays are kept.
    A very long text is cut whole. An empty table gives no rows. Columns other than id and text, whatever their names, are not read.
    Jobs run while the plan is built.
    """
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seed = 0
    while True:
        named = base.select("text").mapInArrow(_chunks("text", seed, name_bytes), "name binary, chunk binary")
        clash = named.groupBy("name", "chunk").count().groupBy("name").count().where("count > 1")
        if not clash.head(1):
            break
        seed, name_bytes = seed + 1, min(16, name_bytes * 2)
    recipes = cut(base.mapInArrow(_recipes(seed, name_bytes), "doc_id long, points long, text_sha256 string, recipe binary"))
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("low"))).alias("best")
    groups = recipes.groupBy("recipe").agg(best, F.count("*").alias("group_size"))
    out = join_groups(recipes, groups, "recipe", "group_size")
    keep: Column = F.bitwise_not("best.low")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(keep) & (F.col("points") == F.col("best.points"))).alias("kept"),
        "text_sha256",
    )
