"""SimHash near-dedup by meet-in-the-middle ball hashing.

Each distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius
meet at a variant, and the fingerprints at one variant are all within the radius of each other; so linking
each to the smallest there loses no connection and emits no pairs. A variant of 64 bits at half radius 1 is
met by 65 fingerprints at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._cluster import components, cut, join_groups

U64 = np.uint64
ONES = U64(0x0101010101010101)


def bit_counts(h: np.ndarray, owner_starts: np.ndarray) -> np.ndarray:
    """For each group h[start:next start] (none empty) how often each of the 64 bits is set; column i is bit i.

    Bytes of a 64-bit word count eight bits at once, over runs of 255 values at most.
    """
    sizes = np.diff(np.append(owner_starts, len(h)))
    runs = (sizes + 254) // 255
    first = np.concatenate([[0], np.cumsum(runs)])
    lead = np.repeat(owner_starts, runs) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], runs))
    out = np.empty((len(owner_starts), 64), np.int64)
    for bit in range(8):
        sums = np.add.reduceat((h >> U64(bit)) & ONES, lead)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, bit::8] = np.add.reduceat(lanes, first[:-1], axis=0)
    return out


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of all shingles of a text; A-Z are lower-cased."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined, hash64 = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) < width:
        return [hash64(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1])
    return [hash64(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    out = np.zeros(len(texts), U64)
    held: list[np.ndarray] = []
    owner: list[int] = []
    n = 0

    def settle() -> None:
        nonlocal n
        if held:
            sizes = np.array([len(x) for x in held])
            counts = bit_counts(np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            bits = (2 * counts > sizes[:, None]).astype(U64)
            out[owner] = (bits << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
        held.clear()
        owner.clear()
        n = 0

    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, width, seed):
            held.append(np.array(hashes, U64))
            owner.append(i)
            n += len(hashes)
            if n > 1 << 19:
                settle()
    settle()
    return out


def _prints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, 1)):
            got = fingerprints(batch.column(1).to_pylist(), width, seed)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "print"])

    return run


def ball(value: Column, radius: int) -> Column:
    """All values within `radius` (0, 1 or 2) bits of a long."""
    flips = [0] + [1 << i for i in range(64)] * (radius > 0) + [(1 << i) | (1 << j) for i in range(64) for j in range(i)] * (radius > 1)
    return F.transform(F.lit(np.array(flips, U64).view(np.int64).tolist()), lambda x: value.bitwiseXOR(x))


def link_prints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) both ways: distinct fingerprints `print` within the radius that connect whatever is connected."""
    half = radius // 2
    if radius % 2 or half > 2:
        raise ValueError("the radius is 0, 2 or 4")
    # as many tasks as the variants need, however few partitions the fingerprints lie in
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // (1 << 14)))
    spread = prints.repartition(tasks, "print").select("print", F.explode(ball(F.col("print"), half)).alias("variant"))
    met = spread.groupBy("variant").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.count("*").alias("n"))
    met = met.where("low <> high").select("variant", "low")
    pair = spread.join(met, "variant").where("print <> low").select(F.col("print").alias("a"), F.col("low").alias("b"))
    pair = pair.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()
    return pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Shingles are `width` words, a shorter text is one shingle, a text without words (also null) has fingerprint zero,
    which links like any other. component_id is the smallest id reachable over links of at most `radius` bits; null
    ids are ignored unless a component has no other. Rows that repeat an id stay. A very long text is read whole. There are no ties: of equal
    smallest ids all are the component's. An empty table gives no rows. Columns other than id and text, whatever their names, are not read.
    Jobs run while the plan is built.
    """
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = cut(base.mapInArrow(_prints(width, seed), "doc_id long, print long"))
    prints = cut(made.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    links = cut(link_prints(prints.select("print"), radius))
    start = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    label = components(cut(start), links)
    named = prints.join(label.withColumnRenamed("node", "print"), "print", "left").select("print", "first", "copies", F.coalesce("label", "print").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    groups = join_groups(named, lowest, "label", "members").select("print", "copies", "component_id")
    out = join_groups(made, groups, "print", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
