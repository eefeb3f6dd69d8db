"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles, in powers of two. An item may miss some of its shingles in a document that
contains it; with t the most that an item of its partition may miss, its sketch is its 2 t + 1 smallest shingle hashes, or all, and a
document that contains it must hold as many of these as the sketch has beyond what this item may miss. The search thus loses nothing,
however long the document is. Each document looks up all its shingles in a bit table of the sketches, whose size has a bound
whatever the benchmark's; what it finds is joined with the sketches by hash, and pairs with enough of a sketch are verified by
exact containment of the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._cluster import cut

WIDTH, LEAST = 5, 0.8
GAP = np.array([not (chr(b).isascii() and chr(b).isalnum() or b >= 0x80) for b in range(256)])
#: Each hash sets as many bits of the table as there are factors.
FACTORS = B.mix64(np.arange(3, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
#: Texts found to be contaminated are broadcast up to this number.
SMALL = 1 << 15


class Texts:
    """Words of texts: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""

    def __init__(self, column, width: int):
        data, self.off = B.buffer_of(column)
        self.data, self.width = B.LOWER[data], width
        self.starts, self.ends, self.first = B.words(self.data, self.off, GAP)
        size = np.diff(self.first)
        words = B.word_hashes(self.data, self.starts, self.ends, 11)
        at = B.inside(self.first, width)
        hashes = B.window_hashes(words, width, 12)[at] if len(at) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(size)), np.maximum(size - width + 1, 0))
        short = np.flatnonzero((size > 0) & (size < width))
        whole = [B.window_hashes(words[self.first[i] : self.first[i + 1]], int(size[i]), 12 + int(size[i]))[0] for i in short.tolist()]
        self.owner = np.concatenate([owner, short])
        self.hash = np.concatenate([hashes, np.array(whole, np.uint64)])

    def shingles(self, i: int) -> set[bytes]:
        """The shingles of text i; a text of fewer words is one shingle, one without words has none."""
        raw = self.data[self.off[i] : self.off[i + 1]].tobytes()
        a, b = self.first[i], self.first[i + 1]
        words = [raw[s:e] for s, e in zip((self.starts[a:b] - self.off[i]).tolist(), (self.ends[a:b] - self.off[i]).tolist(), strict=True)]
        if len(words) < self.width:
            return {b" ".join(words)} if words else set()
        return {b" ".join(words[k : k + self.width]) for k in range(len(words) - self.width + 1)}


def _sketches(width: int, share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, 1)):
            t, out = Texts(batch.column(1), width), []
            order = np.argsort(t.owner, kind="stable")
            edges, no = np.searchsorted(t.owner[order], np.arange(batch.num_rows + 1)), batch.column(0).to_pylist()
            for i in np.flatnonzero(np.diff(edges)).tolist():
                own, n = np.unique(t.hash[order[edges[i] : edges[i + 1]]]), len(t.shingles(i))
                part = n.bit_length()
                sketch = own[: 2 * math.floor(((1 << part) - 1) * (1 - share)) + 1]
                need = max(1, len(sketch) - math.floor(n * (1 - share)))
                out.append((sketch.view(np.int64), np.full(len(sketch), no[i]), np.full(len(sketch), part), np.full(len(sketch), need)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in columns], ["hash", "no", "part", "need"])

    return run


def _words(bits: int):
    """Words of a table of 2^bits bits in which each hash sets a bit for each of FACTORS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([(hashes * factor) >> np.uint64(64 - bits) for factor in FACTORS])
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "set"])

    return run


def _probe(width: int, bits: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, 1)):
            t = Texts(batch.column(1), width)
            hit = np.arange(len(t.hash))
            for factor in FACTORS:
                at = (t.hash[hit] * factor) >> np.uint64(64 - bits)
                hit = hit[(table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
            owner, hashes = t.owner[hit], t.hash[hit]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            owner, hashes = owner[fresh], hashes[fresh]
            who, lead = np.unique(owner, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(lead, len(owner)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), lists], ["doc_id", "text", "hits"])

    return run


def _verify(width: int, share: Fraction):
    """doc_id, key, items, text: the pairs of a text and one of its items that hold, with n_shared and n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in B.slices(whole, 3)):
            flat = batch.column(2).flatten()
            texts, items, rows = Texts(batch.column(3), width), Texts(flat.field("item_text"), width), []
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
            for i, end in enumerate(ends.tolist()):
                own = texts.shingles(i)
                for k in range(ends[i - 1] if i else 0, end):
                    want = items.shingles(k)
                    if (shared := len(own & want)) >= share * len(want):
                        rows.append((i, k, shared, len(want)))
            at, of, *n = (pa.array([r[k] for r in rows], pa.int64()) for k in range(4))
            yield pa.record_batch([batch.column(0).take(at), flat.field("item_id").take(of), batch.column(1).take(at), *n], ["doc_id", "item_id", "key", "n_shared", "n_shingles"])

    return run


def _met(hits: DataFrame, sketches: DataFrame) -> DataFrame:
    """hits (row, hash) with the sketches (hash, ...) that have this hash.

    Hashes with over a thousandth of all hits are fewer than a thousand; their sketches are broadcast, if not too many items have such a hash, and
    the rest is shuffled. What is hot in both is left to the planner's splits.
    """
    sizes = hits.groupBy("hash").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = cut(sizes.where(F.col("count") > max(total // 1000, 100)).select("hash"))
    spread = cut(sketches.join(F.broadcast(hot), "hash", "left_semi"))
    if not 0 < spread.limit(SMALL + 1).count() <= SMALL:
        return hits.join(sketches, "hash")
    few = F.broadcast(spread)
    return hits.join(few, "hash").unionByName(hits.join(F.broadcast(hot), "hash", "left_anti").join(sketches, "hash"))


def _found(base: DataFrame, benchmark: DataFrame, item: str, item_text: str, width: int, least: float, most_bits: int) -> DataFrame:
    """doc_id, item_id, key, n_shared, n_shingles for a table of (doc_id, text); key is the text's SHA-256."""
    share, spark = Fraction(str(least)), base.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_text <> ''")
    items = cut(items.withColumn("no", F.monotonically_increasing_id()))
    sketches = cut(items.select("no", "item_text").mapInArrow(_sketches(width, share), "hash long, no long, part long, need long"))
    bits = max(6, min(most_bits, (256 * sketches.count()).bit_length()))
    words = sketches.select("hash").mapInArrow(_words(bits), "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)  # 16 MB at most
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    probed = base.mapInArrow(_probe(width, bits, spark.sparkContext.broadcast(table)), "doc_id long, text string, hits array<long>")
    probed = cut(probed.withColumn("row", F.monotonically_increasing_id()))
    met = _met(probed.select("row", F.explode("hits").alias("hash")), sketches).groupBy("row", "part", "no").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    pairs = met.where("n >= need").select("row", "no").join(items, "no")
    # a row a text, with the items it has enough hashes of: no more than its hashes are in sketches
    lists = pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    whole = probed.select("row", "doc_id", "text").join(lists, "row").select("doc_id", F.sha2("text", 256).alias("key"), "items", "text")
    return whole.mapInArrow(_verify(width, share), "doc_id long, item_id long, key string, n_shared long, n_shingles long")


def contained_items(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = LEAST, most_bits: int = 27) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: the pairs in which a document has at least `least` of an item's shingles.

    A shingle is `width` words; a text of fewer words is one shingle, so such an item is found in texts of just these words.
    Null and empty texts have no shingles and match nothing. A very long text is searched whole. Rows that repeat an id are rows of their own,
    of documents and of items; null ids are passed on. A share of exactly `least` counts. Empty tables give no rows. Columns other than
    these, whatever their names, are not read. Jobs run while the plan is built. Over 2^most_bits / 256 hashes in all sketches the bit table
    lets more through; the result is the same.
    """
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = _found(base, benchmark, item, item_text, width, least, most_bits)
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, least: float = LEAST, most_bits: int = 27) -> DataFrame:
    """The rows of docs that contain no item, all columns as they are; see contained_items. Rows of equal text share their fate."""
    base = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bad = cut(_found(base, benchmark, item, item_text, width, least, most_bits).select(F.col("key").alias("_contaminated")).distinct())
    few = F.broadcast(bad) if bad.count() <= SMALL else bad
    return docs.join(few, F.sha2(docs[text].cast("string"), 256) == few["_contaminated"], "left_anti")
