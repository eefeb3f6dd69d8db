"""Source divergence audit: how far the word shares of the sources of a language lie apart, pair by pair and term by term.

Counts of kept terms by (language, source) are packed into one vector a source and vocabulary chunk. A language's sources are cut into blocks; a
tile is a pair of blocks, and the packed vectors of a block are replicated to all tiles of its row and column. A tile's
task goes through successive vocabulary chunks and adds up its pair submatrix; sums over stripes of chunks are added at the end, exactly.

A term that no source of a tile has adds the same number to a pair each time, so a chunk costs its occurring terms only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import slices
from ._cluster import cut, join_groups

#: Letters (A-Z lower-cased) and bytes of other characters; all else is a space.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries a task holds before it passes counts on; bytes of a text split at once.
HELD, PIECE = 1 << 19, 1 << 20
#: Groups a block, terms a chunk (about), chunks a stripe.
BLOCK, CHUNK, STRIPE = 32, 4096, 4


def pieces(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, i = text.translate(table), 0
    while i < len(text):
        j = text.find(b" ", i + PIECE)
        j = len(text) if j < 0 else j
        yield text[i:j].split()
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences, documents; a row without a term says that a group occurs."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    names = ["lang", "source", "term", "n", "docs"]

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), count in n.items():
            terms, seen = list(count), docs[lang, source]
            columns = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([None, *terms], pa.binary()).cast(pa.string())]
            yield pa.record_batch([*columns, pa.array([0, *count.values()], pa.int64()), pa.array([0, *map(seen.__getitem__, terms)], pa.int64())], names)
        n.clear()
        docs.clear()

    for batch in (part for whole in batches for part in slices(whole, 2)):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            count, seen = n.setdefault((lang, source), Counter()), set()
            for terms in pieces(text, TERM):
                count.update(terms)
                seen.update(terms)
            docs.setdefault((lang, source), Counter()).update(seen)
        if sum(map(len, n.values())) > HELD:
            yield from flush()
    yield from flush()


def share(count, total, v):
    """1 + floor(1000000000 * (count + 1) / (total + v)), three digits at a time: exact below 9 * 10^15, as columns or as arrays."""
    columns = isinstance(count, Column)
    whole = (lambda a, b: F.call_function("div", a, b)) if columns else (lambda a, b: a // b)
    of, rest, out = total + v, count + 1, 0
    for _ in range(3):
        digits = whole(rest * 1000, of)
        out, rest = out * 1000 + digits, rest * 1000 % of
    return out + 1


def distance(p, q):
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q) if isinstance(p, Column) else (p - q) ** 2 // q


class Tile:
    """The pair submatrix of two blocks of groups (or one with itself) over the chunks of a stripe."""

    def __init__(self, lo: int, hi: int, rows: pa.RecordBatch, block: int):
        self.lo, self.hi = lo, hi
        self.source = rows.column("source").to_pylist()
        place = rows.column("place").to_numpy()
        self.at = {int(x): i for i, x in enumerate(place)}
        self.total, self.v = rows.column("total").to_numpy()[:, None], int(rows.column("v")[0].as_py())
        low = place // block == lo
        self.others = [np.flatnonzero(low if lo == hi or not low[i] else ~low) for i in range(len(place))]
        self.none = share(np.zeros((len(place), 1), np.int64), self.total, self.v) if self.v else np.ones((len(place), 1), np.int64)
        self.sums = np.zeros((len(place), len(place)), np.int64)

    def add(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """One chunk: (place, term ids, counts) of the groups that have some of its terms."""
        ids, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        count = np.zeros((len(self.source), len(ids)), np.int64)
        count[np.repeat([self.at[r[0]] for r in rows], [len(r[1]) for r in rows]), at] = np.concatenate([r[2] for r in rows])
        p = share(count, self.total, self.v)
        for i, others in enumerate(self.others):
            if len(others):
                self.sums[i, others] += (distance(p[i][None, :], p[others]) - distance(self.none[i], self.none[others])).sum(axis=1)

    def rows(self, lang: str, first: bool) -> pa.RecordBatch:
        """lang, source, item, value; the first stripe brings what terms add that no group has."""
        i = np.repeat(np.arange(len(self.source)), [len(x) for x in self.others])
        j = np.concatenate([*self.others, np.zeros(0, np.int64)]).astype(np.int64)
        value = self.sums[i, j]
        if first:
            value = value + self.v * distance(self.none[i, 0], self.none[j, 0])
        used = (i != j) & ((value != 0) | first)
        names = np.array(self.source, object)
        return pa.record_batch([pa.array([lang] * int(used.sum()), pa.string()), pa.array(names[i[used]], pa.string()), pa.array(names[j[used]], pa.string()), pa.array(value[used])], ["lang", "source", "item", "value"])


def _tiles(block: int):
    """Rows of a tile and stripe follow one another: first its groups (chunk -1), then its chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, chunk, held = None, None, -1, []

        def chunk_ends() -> None:
            if held:
                tile.add(held)
                held.clear()

        groups: list[pa.RecordBatch] = []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "lo", "hi", "stripe", "chunk", "place")), strict=True))
            ids, counts = (batch.column(c) for c in ("ids", "counts"))
            for i, (*now, c, place) in enumerate(keys):
                if now != key:
                    if groups:
                        tile, groups = Tile(key[1], key[2], pa.Table.from_batches(groups).combine_chunks(), block), []
                    if tile is not None:
                        chunk_ends()
                        yield tile.rows(key[0], key[3] == 0)
                    key, tile, chunk = now, None, -1
                if c < 0:
                    groups.append(batch.slice(i, 1).select(["source", "place", "total", "v"]))
                    continue
                if tile is None:
                    tile, groups = Tile(key[1], key[2], pa.Table.from_batches(groups).combine_chunks(), block), []
                if c != chunk:
                    chunk_ends()
                    chunk = c
                held.append((place, ids[i].values.to_numpy(zero_copy_only=False), counts[i].values.to_numpy(zero_copy_only=False)))
        if groups:
            tile = Tile(key[1], key[2], pa.Table.from_batches(groups).combine_chunks(), block)
        if tile is not None:
            chunk_ends()
            yield tile.rows(key[0], key[3] == 0)

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200, block: int = BLOCK, chunk: int = CHUNK, stripe: int = STRIPE) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its distance from each other source of the language (part `pair`, all
    of them), and the `top` terms that it has more of than its language (part `term`).

    Terms are runs of ASCII letters (A-Z lower-cased) and non-ASCII characters; a language keeps those in at least `least` of its rows. A
    term's share p is 1 + floor(10^9 (count + 1) / (all counts + number of kept terms)), in the source or, for q of part `term`, in the
    language; for q of part `pair` in the other source. A term's value is floor((p - q)^2 / q), a pair's the sum over all kept terms, 0
    if there are none. Ranks go by value, then by item in order of its bytes. All is exact up to 9 * 10^15 counted terms.

    Null text, language and source count as empty. Very long texts are split piece by piece, read whole. Rows that repeat are documents of their
    own. An empty table gives no rows. Columns other than these three, whatever their names, are not read. Jobs run while the plan is built.
    The pairs of a language's sources are the result, so their number is the square of the sources'.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(as_text(lang).alias("lang"), as_text(source).alias("source"), as_text(text).alias("text"))
    raw = base.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # dealt once by language and term: counts of a term's sources and sums over them need no other exchange
    each = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("row", F.monotonically_increasing_id())
    term = Window.partitionBy("lang", "term")
    each = each.select("lang", "source", "term", "n", "row", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("term_n"), F.min("row").over(term).alias("id"))
    each = cut(each.where(f"docs >= {int(least)} or term is null").select("lang", "source", "term", "n", "term_n", "id", (F.col("row") == F.col("id")).alias("lead")))
    kept = each.where("term is not null")

    of = Window.partitionBy("lang")
    groups = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.expr("cast(lead and term is not null as long)")).alias("leads"), F.count("term").alias("rows"))
    groups = groups.select("lang", "source", "total", "rows", F.sum("total").over(of).alias("lang_total"), F.sum("leads").over(of).alias("v"), F.count("*").over(of).alias("n_groups"), (F.row_number().over(of.orderBy("source")) - 1).cast("long").alias("place"))
    groups = cut(groups)
    chunks = max(1, -(-(groups.agg(F.max("v")).first()[0] or 0) // chunk))
    stripes = -(-chunks // stripe)

    known = join_groups(kept, groups.select("lang", "source", "total", "lang_total", "v", "rows"), ["lang", "source"], "rows")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("term_n"), F.col("lang_total"), F.col("v"))
    own = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    packed = kept.groupBy("lang", "source", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("id", "n")).alias("pairs"))
    meta = groups.select("lang", "source", "place", "total", "v", "n_groups", "rows")
    vectors = join_groups(packed, meta, ["lang", "source"], "rows").select("lang", "source", "place", "total", "v", "n_groups", "chunk", F.expr(f"chunk div {stripe}").alias("stripe"), F.col("pairs.id").alias("ids"), F.col("pairs.n").alias("counts"))
    nothing = F.array().cast("array<long>")
    present = meta.select("lang", "source", "place", "total", "v", "n_groups", F.lit(-1).cast("long").alias("chunk"), F.explode(F.expr(f"sequence(0L, {stripes - 1}L)")).alias("stripe"), nothing.alias("ids"), nothing.alias("counts"))
    mine, other = F.expr(f"place div {block}"), F.explode(F.expr(f"sequence(0L, (n_groups - 1) div {block})"))
    tiles = vectors.unionByName(present).select("*", mine.alias("mine"), other.alias("other"))
    tiles = tiles.select("lang", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "stripe", "chunk", "place", "source", "total", "v", "ids", "counts")
    tile = ["lang", "lo", "hi", "stripe"]
    parts = tiles.repartition(*tile).sortWithinPartitions(*tile, "chunk", "place").mapInArrow(_tiles(block), "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms).withColumn("rank", F.col("rank").cast("int"))
