import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from inkgraph.llm import langid as L
from inkgraph.llm.decontaminate import contained_items, decontaminate
from inkgraph.llm.quality import STATS, estimate, quality
from inkgraph.llm.token_count import Counter as TokenCounter
from inkgraph.llm.token_count import Transducer, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts_for_tokens():
    rnd = random.Random(1)
    parts = ["  ", " ", "   ", "a", "b", "the", "e", "\n", "\t", "é", "日", "本", "ﬁ", "Ａ", "x", "1", "22", "<s>", "</s>", "<0x0A>", "▁", "▁▁", "\x00", "𐍈", "😀", "'s", "ing", "tion", "　", "I", "AA", "==", "----", "."]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    return out + [" " * n for n in range(40)] + ["a" * n for n in range(1, 40)] + ["x" * 5000 + " " * 3000 + "y z" * 1000, "tion" * 3000]


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = texts_for_tokens() + [r.text for r in docs.limit(60).collect()]
    want = [len(x) for x in sp.encode(texts)]
    assert TokenCounter(MODEL).count(texts).tolist() == want
    assert TokenCounter(MODEL, word=3, kept=500).count(texts).tolist() == want  # nearly all by chunk maps
    machine = Transducer(MODEL, entries=1 << 16)  # forgets its states again and again
    some = texts[:200] + texts[-3:]
    assert machine.count(some, chunk=16).tolist() == [len(x) for x in sp.encode(some)]


def test_token_rows(odd):
    got = {(r.doc_id, r.n_bytes, r.over_limit) for r in token_counts(odd, MODEL).collect()}
    assert (900, 0, False) in got and (905, 50_000, True) in got
    assert token_counts(odd, MODEL).count() == odd.count() and token_counts(odd.limit(0), MODEL).count() == 0


def test_language_id(spark, both):
    got = L.language_id(both).join(both.select("doc_id", "lang", "text").distinct(), "doc_id").collect()
    known = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[900].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert L.language_id(both.limit(0)).count() == 0
    marks = {c for c in map(chr, range(0x110000)) if L.letters(c)}
    import unicodedata

    assert {"½", "²", "Ⅷ", "①", "१", "_", "̈"}.isdisjoint(marks) and all(unicodedata.category(c)[0] == "L" or any(unicodedata.category(x)[0] == "L" for x in c.lower()) for c in marks)
    none = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ①")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    assert {(r.lang_pred, r.score) for r in L.language_id(none).collect()} == {("und", 0.0)}
    kept = L.keep_identified(both)
    assert kept.columns == both.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})


def test_scores_equal_plain_sums(docs):
    (m,) = L.fit(docs, "doc_id", "text", "lang", ~L.held_out("doc_id"), 20)
    texts = [r.text for r in docs.limit(4).collect()] + ["ab", "é"]
    step, L.STEP = L.STEP, 37
    try:
        got = m.scores([L.letters(t) for t in texts])
    finally:
        L.STEP = step
    for i, t in enumerate(texts):
        p, _ = L._points([L.letters(t)])
        want = m.prior + sum(m.log[:, b].astype(float) for n in L.ORDERS for b in L.gram_buckets(p, n)[3 - n :])
        assert got[i] == pytest.approx(want)


def shingles(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


@pytest.mark.parametrize("most_bits", [26, 6])
def test_contained_items_equal_brute_force(spark, both, most_bits):
    rnd = random.Random(4)
    words = [f"k{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice((3, 5, 9, 10, 14, 30, 60))))) for i in range(40)] + [(50, None), (51, ""), (52, "a b c")]
    made = []
    for i, t in items[:40]:
        w = t.split()
        for d, drop in enumerate((0, 1, 2, 4)):  # some copies fall short
            k = [x if rnd.random() > drop / 20 else "zz" for x in w]
            cut = rnd.randint(0, len(k))
            made.append((2000 + 4 * i + d, " ".join(["pad"] * 300 + k[:cut] + (["pad"] * 5 if d == 3 else []) + k[cut:] + ["pad"] * 300)))
    df = both.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for r in df.collect():
        own = shingles(r.text)
        for i, t in items:
            s = shingles(t)
            if s and 5 * len(own & s) >= 4 * len(s):
                want[(r.doc_id, i, len(own & s), len(s))] += 1
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in contained_items(df, bench, most_bits=most_bits).collect())
    assert got == want and len(want) > 20
    kept = decontaminate(df, bench, most_bits=most_bits)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {k[0] for k in want}
    assert contained_items(df, bench.limit(0)).count() == 0 and contained_items(df.limit(0), bench).count() == 0
    assert decontaminate(df, bench.limit(0)).count() == df.count()


def test_estimate_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    right = np.array([0.9, 0.8, 0.7, 0.85])
    v = np.where(rng.random((20_000, 4)) < right, good[:, None], ~good[:, None]).astype(np.int8)
    v[rng.random(v.shape) < 0.3] = -1
    share, chance = estimate(v, np.ones(len(v)))
    assert share == pytest.approx(0.8, abs=0.03)
    got = chance[:, 1, 1] / (chance[:, 1, 0] + chance[:, 1, 1])
    assert got == pytest.approx(right, abs=0.04)


def test_quality_on_labels(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs).withColumnRenamed("quality", "score").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97
    clean = [r for r in got if r.quality == 1]
    assert sum(r.kept for r in clean) / len(clean) > 0.99
    assert quality(odd).count() == odd.count() and quality(odd.limit(0)).count() == 0 and len(STATS) == 10


def test_any_number_of_languages_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    words = [["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(6)] for _ in range(300)]
    rows = [(k * 4 + n, " ".join(rng.choice(words[k], 12)), f"l{k:03d}") for k in range(300) for n in range(4)] + [(5000, None, "l001"), (5001, "12 34", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {n: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.language_id(df, block=n).collect()} for n in (1000, 200, 100)}
    assert got[1000] == got[200] == got[100] and len(got[200]) == len(rows)
    assert got[200][5000] == got[200][5001] == ("und", 0.0)
    assert sum(got[200][i][0] == lang for i, _, lang in rows[:1200]) > 1150
    kept = {n: sorted(r.doc_id for r in L.keep_identified(df.withColumn("score", L.F.lit(1)), block=n).collect()) for n in (1000, 100)}
    assert kept[1000] == kept[100] and 5000 not in kept[100]


def test_a_shingle_in_every_document_and_many_items(spark):
    from inkgraph.llm.decontaminate import contained_items

    common = "all rights reserved by the owner of this page"
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    docs = [(k, f"{common} {own(k)}") for k in range(400)] + [(400 + k, f"{own(k)} {common} {own(k + 1000)}") for k in range(5)]
    items = [(k, f"{common} {own(k)}") for k in range(0, 40, 2)] + [(100, common), (101, common)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = sorted((d, i, len(shingles(x) & shingles(y))) for d, x in docs for i, y in items if 5 * len(shingles(x) & shingles(y)) >= 4 * len(shingles(y)))
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in contained_items(df, bench).collect())
    assert got == want and len(want) > 800
