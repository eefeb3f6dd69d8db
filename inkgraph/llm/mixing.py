"""Mixing sources to target weights, in DataFrame functions only.

The words of a source lie end to end in order of a bucket (a hash of the id) and the id, and are packed into blocks of fixed
length. Each output shard draws its source counts from the multinomial law with the sources' slots as weights: each of its slots draws a
source. Totals would so be left to chance, and could pass what a source may give; so a source's draws beyond its slots are void, and
what it still lacks after all shards goes to settling shards at the end, about the square root of all slots. A shard's slots
of a source are a range of that source's slot numbers; a pseudorandom permutation (swap-or-not, which needs no table and no power of
two) maps each slot number to a block, and blocks are joined by index. A pass over a source uses each of its blocks once; the last
pass stops at the target, its last slot cut to length.

Running sums go by (source, bucket), then over the buckets of a source, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import cut

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ROUNDS = 32


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str) -> Column:
    return F.filter(F.split(F.col(text), GAP), lambda w: w != "")


def permuted(index: Column, n: Column, key: list[Column]) -> Column:
    """A permutation of 0 .. n - 1 that depends on key."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pivot"), r, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit("side"), r, F.greatest(x, other), *key) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """skey, source_size, target for a table of (skey, source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. The level at which the sum of min(cap * size, level * weight) is
    `share` of all sizes is what resharing the excess by weight comes to. One task handles all sources: a row for each.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    upto = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("total", share * F.sum("source_size").over(everything))
    t = t.withColumn("after", F.sum("weight").over(everything) - F.sum("weight").over(upto))
    t = t.withColumn("full", F.sum("most").over(upto) + F.col("ratio") * F.col("after") <= F.col("total") * (1 + 1e-12))
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    t = t.withColumn("level", F.try_divide(F.col("total") - spent, free))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return t.select("skey", "source_size", target.alias("target"))


def shard_counts(plan: DataFrame, slots: int, per_shard: int, seed: int, cells: int = 4096) -> DataFrame:
    """skey, shard, count, start: how many slots of each source a shard has, and the first of their numbers, for a table of (skey, slots).

    Slot d of all belongs to shard d div per_shard and draws a number below the sum of slots; the source that holds this number in a
    list of all sources is found by joining on one of `cells` equal parts. Shards from the last drawn one on settle what is lacking.
    """
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)
    width = max(1, -(-slots // cells))
    held = plan.select("skey", F.sum("slots").over(upto).alias("to"), "slots").withColumn("from", F.col("to") - F.col("slots"))
    held = held.withColumn("cell", F.explode(F.sequence(F.expr(f"from div {width}"), F.expr(f"(to - 1) div {width}"))))
    draws = plan.sparkSession.range(slots).select(F.expr(f"id div {per_shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(slots, 1))).alias("drawn"))
    drawn = draws.withColumn("cell", F.expr(f"drawn div {width}")).join(held.select("skey", "from", "to", "cell"), "cell").where("from <= drawn and drawn < to")
    counts = drawn.groupBy("skey", "shard").agg(F.count("*").alias("count"))
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(plan.select("skey", "slots"), "skey")
    counts = counts.withColumn("count", F.least("count", F.col("slots") - F.col("start"))).where("count > 0").select("skey", "shard", "count", "start")
    given = counts.groupBy("skey").agg(F.sum("count").alias("given"))
    short = plan.select("skey", "slots").join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - given - 1) div {per_shard}")))
    short = short.withColumn("piece", piece).withColumn("start", F.col("given") + F.col("piece") * per_shard)
    last = -(-slots // per_shard)
    return counts.unionByName(short.select("skey", (F.col("piece") + last).alias("shard"), F.least(F.lit(per_shard), F.col("slots") - F.col("start")).alias("count"), "start"))


class Mix:
    """What mix_sources returns.

    rows: doc_id, source, size, source_size, target for each row of docs, with its row number `rid`.
    spans: shard, slot, source, pass_no, block, rid, doc_id, word_from, n: which words of which document fill a slot of a shard.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame, spans: DataFrame, columns: tuple[str, str, str]):
        self.docs, self.rows, self.spans, self.columns = docs, rows, spans, columns

    def taken(self) -> DataFrame:
        """rows with `taken`, the number of words the mix has of each, repeats counted."""
        used = self.spans.groupBy("rid").agg(F.sum("n").alias("taken"))
        return self.rows.join(used, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))

    def texts(self) -> DataFrame:
        """shard, slot, source, doc_id, word_from, n, text: the spans with their words, joined by single spaces.

        Texts are shuffled once, by id; a document's spans are no more than the blocks it reaches into, twice. Rows that repeat
        an id, a source and a text are the same here.
        """
        id, text, source = self.columns
        keys = [F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), skey(source).alias("skey")]
        full = self.docs.select(*keys, F.col(text).cast("string").alias("text")).dropDuplicates(["doc_id", "hash", "skey"])
        piece = F.struct("shard", "slot", "word_from", "n")
        by_doc = self.spans.groupBy("doc_id", "hash", "skey").agg(F.collect_list(piece).alias("spans"))
        same = by_doc["doc_id"].eqNullSafe(full["doc_id"]) & (by_doc["hash"] == full["hash"]) & (by_doc["skey"] == full["skey"])
        joined = full.join(by_doc, same).select(full["doc_id"], full["skey"], words("text").alias("words"), "spans")
        cut_out = F.transform("spans", lambda s: F.struct(s["shard"].alias("shard"), s["slot"].alias("slot"), s["word_from"].alias("word_from"), s["n"].alias("n"), F.array_join(F.slice("words", (s["word_from"] + 1).cast("int"), s["n"].cast("int")), " ").alias("text")))
        out = joined.select("doc_id", "skey", F.explode(cut_out).alias("s"))
        return out.select("s.shard", "s.slot", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)).alias("source"), "doc_id", "s.word_from", "s.n", "s.text")


def skey(source: str) -> Column:
    """A key that is never null: `v` and the source, or `n`."""
    return F.coalesce(F.concat(F.lit("v"), F.col(source).cast("string")), F.lit("n"))


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 512, shard_words: int = 1 << 22, buckets: int | None = None, seed: int = 1) -> Mix:
    """Plan a mix of docs whose sources hold `weights` of `share` of all words, none more than `cap` (at most 2) times its size.

    Words are `[^\\x20\\x09-\\x0D]+`; a null text has none, a null source is a source of its own and sorts last. A source takes
    round(target) words; each of its documents is used at most once in a pass, and there are at most two passes. The result
    depends on ids, sources, sizes and `seed` alone, not on the order or partitioning of rows; rows of equal id, source and size
    may trade places. Sources of equal weight and size are told apart by their names. A very long text is packed whole. Columns other
    than id, text and source, whatever their names, are not read. A table without words, or an empty one, gives no spans. A running sum
    goes over the rows of one of `buckets` parts of a source, about 20,000 rows of all. Jobs run while the plan is built.
    """
    buckets = buckets or max(1024, docs.count() // 20_000)
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), skey(source).alias("skey"), n_words(text).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    base = cut(base.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).withColumn("rid", F.monotonically_increasing_id()))
    part = base.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = cut(part.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))))
    sizes = part.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    goal = cut(targets(sizes, weights, share, cap))

    size, full = F.col("source_size"), F.floor(F.col("source_size") / block)
    plan = goal.withColumn("take", F.least(F.round("target").cast("long"), (2 * size).cast("long"))).where("source_size > 0 and take > 0")
    plan = plan.withColumn("full", full.cast("long")).withColumn("blocks", F.ceil(size / block).cast("long"))
    plan = plan.withColumn("passes", F.expr("take div source_size")).withColumn("rest", F.col("take") - F.col("passes") * size)
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    plan = cut(plan)
    words_, slots_ = (x or 0 for x in plan.agg(F.sum("take"), F.sum("slots")).first())
    per_shard = max(1, -(-slots_ // max(1, -(-words_ // shard_words))))

    counts = cut(shard_counts(plan, slots_, per_shard, seed))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-slots_ // (1 << 14)))
    slots = counts.join(plan, "skey").repartition(tasks, "skey", "shard").withColumn("number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)))
    slots = slots.withColumn("pass_no", F.least(F.expr("number div blocks"), "passes")).withColumn("index", F.col("number") - F.col("pass_no") * F.col("blocks"))
    shuffled = permuted(F.col("index"), F.greatest("full", F.lit(1)), [F.lit(seed), F.col("skey"), F.col("pass_no")])
    slots = slots.withColumn("block", F.when(F.col("index") < F.col("full"), shuffled).otherwise(F.col("index")))
    # words of the slot's block that it takes: all, but for the last slot of the last pass
    limit = F.when(F.col("pass_no") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("index") * block))
    slots = slots.select("skey", "shard", F.xxhash64(F.lit(seed), "skey", "number").alias("slot"), "pass_no", "block", limit.cast("long").alias("limit"))

    inside = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.where("size > 0").withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(part.select("skey", "bucket", "base"), ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    pieces = placed.select("rid", "doc_id", "hash", "skey", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    from_ = F.greatest(F.col("block") * block, "start")
    to = F.least(F.col("block") * block + block, F.col("start") + F.col("size"))
    pieces = pieces.select("rid", "doc_id", "hash", "skey", "block", (from_ - F.col("start")).alias("word_from"), (to - from_).alias("words"), (from_ - F.col("block") * block).alias("at"))
    n = F.least("words", F.col("limit") - F.col("at"))
    # slots are many, though they come from few counts: never a broadcast
    spans = pieces.join(slots.hint("merge"), ["skey", "block"]).withColumn("n", n).where("n > 0")
    spans = spans.select("shard", "slot", "skey", "pass_no", "block", "rid", "doc_id", "hash", "word_from", "n")
    rows = base.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, "skey")
    return Mix(docs, rows.select("rid", "doc_id", "source", "size", "source_size", "target"), spans, (id, text, source))
