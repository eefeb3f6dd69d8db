"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else is a gap; n-grams of 1 to 3 characters of the gapped text are hashed. The
model is a matrix of log probabilities, buckets by languages, fitted on a bounded sample of the labelled rows and broadcast in blocks
whose size is known (2^16 rows, at most BLOCK columns). Texts are scored whole, a batch at a time, in numpy; what blocks
find is merged, as the best language is a maximum and the posterior a sum over all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import STEP, U64, mix64, slices
from ._cluster import cut

BUCKETS, ORDERS, BLOCK = 1 << 16, (1, 2, 3), 200
LETTERS = re.compile(r"[^\W\d_]+")
#: What LETTERS takes for letters besides the Unicode categories L: fractions, circled and other numbers.
NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
BLANK = dict.fromkeys(map(ord, NUMBERS), " ")
UNDETERMINED = "und"


def letters(text: str | None) -> str:
    """The runs of letters of a text, lower-cased, with a space between them."""
    low = (text or "").lower()
    if not low.isascii() and not NUMBERS.isdisjoint(low):
        low = low.translate(BLANK)
    return " ".join(LETTERS.findall(low))


def _points(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of what `letters` gives, and offsets. A run of other characters is one gap; each text has a gap before and two
    after it, so no n-gram reaches into another text, and two gaps stand before the first.
    """
    joined = "  " + "".join(f" {t}  " for t in low)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    return points, np.concatenate([[2], 2 + np.cumsum([len(t) + 3 for t in low])])


def gram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place from order - 1 on."""
    h = points[order - 1 :].copy()
    for k in range(1, order):
        h = h * U64(0x110001) + points[order - 1 - k : len(points) - k]
    return (mix64(h + U64(order << 58)) >> U64(48)).astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of n-gram counts by language, one row for each language a task has seen."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
        for lang, part in frame.groupby("lang"):
            total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for text in part["text"]:
                points, _ = _points([letters(text)])
                for n in ORDERS:
                    total += np.bincount(gram_buckets(points, n)[3 - n :], minlength=BUCKETS)
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"])


def _pack(rows: pa.Table) -> pa.Table:
    """The counts of one language, at most a row a bucket, as one vector."""
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return pa.table({"lang": rows.column("lang")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})


class Model:
    def __init__(self, languages: list[str], log: np.ndarray, prior: np.ndarray):
        self.languages, self.log, self.prior = languages, log, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log posterior up to a constant, texts by languages, over all n-grams of whole texts, given by `letters`."""
        points, off = _points(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for lo in range(2, len(points), STEP):
            part = points[lo - 2 : lo + STEP]
            owners = np.arange(np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, min(lo + STEP, len(points)), "left"))
            cut = np.maximum(off[owners] - lo, 0)
            for n in ORDERS:
                bucket = gram_buckets(part, n)[3 - n :]
                for k in range(len(self.languages)):
                    out[owners, k] += np.add.reduceat(self.log[k][bucket], cut, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The best language of each text, its log posterior up to a constant, and the sum of all relative to it; `und`, -inf and 0 without letters."""
        low = [letters(t) for t in texts]
        known = [i for i, t in enumerate(low) if t]
        lang, best, total = [UNDETERMINED] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
        if known and self.languages:
            got = self.scores([low[i] for i in known])
            best[known] = got.max(axis=1)
            total[known] = np.exp(got - got.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k in zip(known, got.argmax(axis=1).tolist(), strict=True):
                lang[i] = self.languages[k]
        return lang, best, total


def fit(docs: DataFrame, id: str, text: str, lang: str, learn, per_language: int = 500, alpha: float = 0.1, block: int = BLOCK) -> Iterator[Model]:
    """A model for each block of languages, in order of their names, each with its own job; one without languages if there is none.

    Fitted on about `per_language` labelled rows a language, those with the smallest hash of id and text. Copies have hashes of their own, so a
    text that a third of all rows repeat cannot fill the sample or stay out of it. `learn` is a boolean column. Rows with a null or
    empty text or a null language teach nothing. Half a MB a language reaches the driver, a block at a time.
    """
    rows = docs.where(learn).select(F.col(id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text <> ''")
    shares = cut(rows.groupBy("lang").count())
    total, last = shares.agg(F.sum("count")).first()[0] or 0, None
    while True:
        rest = shares if last is None else shares.where(F.col("lang") > last)
        counts = rest.orderBy("lang").limit(block).collect()
        if not counts and last is not None:
            return
        languages = [r["lang"] for r in counts]
        log = np.zeros((len(languages), BUCKETS))
        if counts:
            # a hash below its share of the range keeps a bounded sample in one pass, without a sort
            chance = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
            sample = rows.where(F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30))
            learned = sample.select("lang", "text").mapInArrow(_learn, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            for r in learned.groupBy("lang").applyInArrow(_pack, "lang string, counts binary").collect():
                log[languages.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
        log = np.log((log + alpha) / (log.sum(axis=1, keepdims=True) + alpha * BUCKETS))
        yield Model(languages, log.astype(np.float32), np.log([r["count"] / total for r in counts]))
        if len(counts) < block:
            return
        last = languages[-1]


GUESS = "struct<lang:string,best:double,total:double>"


def _guess(model, text: int, before: int | None):
    """The batch with a column GUESS at its end: the model's, merged with that at `before`, which it replaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            lang, best, total = model.value.predict(batch.column(text).to_pylist())
            columns, names = list(batch.columns), list(batch.schema.names)
            if before is not None:
                old = batch.column(before)
                was, was_best, was_total = old.field("lang").to_pylist(), old.field("best").to_numpy(zero_copy_only=False), old.field("total").to_numpy(zero_copy_only=False)
                top = np.maximum(best, was_best)
                with np.errstate(invalid="ignore"):
                    total = np.where(np.isneginf(top), 0.0, total * np.exp(best - top) + was_total * np.exp(was_best - top))
                lang = [a if x > y else b for a, b, x, y in zip(lang, was, best, was_best, strict=True)]  # ties: the block before
                best = top
                del columns[before], names[before]
            guess = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(best), pa.array(total)], ["lang", "best", "total"])
            yield pa.RecordBatch.from_arrays([*columns, guess], [*names, GUESS_NAME])

    return run


GUESS_NAME = "_guess"


def guessed(rows: DataFrame, text: str, models: Iterator[Model]) -> DataFrame:
    """rows with a column `_guess` of all models; between two blocks of languages rows are cut, so that one block is held at a time."""
    sc, first = rows.sparkSession.sparkContext, True
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {GUESS_NAME} {GUESS}"
    at = rows.columns.index(text)
    for model in models:
        rows = rows if first else cut(rows)
        rows = rows.mapInArrow(_guess(sc.broadcast(model), at, None if first else len(rows.columns) - 1), schema)
        first = False
    return rows


def posterior():
    """The score of `_guess`: 0 where nothing could be said."""
    return F.when(F.col(f"{GUESS_NAME}.total") > 0, 1 / F.col(f"{GUESS_NAME}.total")).otherwise(F.lit(0.0))


def held_out(id: str):
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    The model learns from text and lang of rows that are not held out and have both. lang_pred is a learned language, or
    `und` with score 0 if the text is null or has no letter, or if nothing could be learned. score is the posterior. Ties go
    to the language that sorts first. Ids are passed on as they are, null and repeated ones too; a null id is not held out. A letter is a
    character of the Unicode categories L. A very long text is scored whole. An empty table gives no rows. Columns other than
    these, whatever their names, are not read. Any number of languages is scored, `block` of them at a time. Jobs run while the plan is built.
    """
    models = fit(docs, id, text, lang, ~held_out(id), per_language, block=block)
    base = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return guessed(base, "text", models).select("doc_id", "held_out", F.col(f"{GUESS_NAME}.lang").alias("lang_pred"), posterior().alias("score"))


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5, per_language: int = 500, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is determined with a score of at least `least`.

    What `language_id` says of nulls, empty and very long texts, ties, repeated rows and empty tables holds here: texts without letters go, all copies of
    a row share its fate. A column named `_guess` raises an error; other names do not matter.
    """
    if GUESS_NAME in docs.columns:
        raise ValueError(f"a column is named {GUESS_NAME}")
    models = fit(docs, id, text, lang, ~held_out(id), per_language, block=block)
    known = guessed(docs, text, models).where((F.col(f"{GUESS_NAME}.lang") != UNDETERMINED) & (posterior() >= least))
    return known.select(*[F.col(f"`{c}`") for c in docs.columns])
