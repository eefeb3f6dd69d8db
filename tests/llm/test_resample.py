import hashlib
import math
import re
from zlib import crc32

import pytest

from inkgraph.llm.divergence import PIECE
from inkgraph.llm.resample import WORD, Ring, _buckets, resample


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, n, buckets):
    w = words(text)
    return [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for out, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text, n, buckets):
                out[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + buckets)) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text, n, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("case", [{}, {"n": 3, "buckets": 500, "percent": 60, "least_words": 1, "seed": 7}])
def test_draw_equals_plain_one(spark, both, case):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(0, None)], "item_id long, text string"))
    docs = both.dropDuplicates()
    got = sorted((tuple(r) for r in resample(docs, target, **case).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = {"least" if k == "least_words" else k: v for k, v in case.items()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **want)


def test_runs_go_on_from_piece_to_piece():
    text = " ".join(f"w{i % 977}" for i in range(PIECE // 3))
    assert len(text) > PIECE
    got = sorted(int(b) for _, x in _buckets(text.encode(), 3, 1000) for b in x)
    assert got == sorted(features(text, 3, 1000))
    ring = Ring(2)
    assert [x for part in ([b"a"], [], [b"b"]) for x in ring.feed(part)] == [[crc32(b"a")], [], [crc32(b"b")], [crc32(b"a b")]]
    assert bytes([65]).translate(WORD) == b"a" and b"_-\x7f".translate(WORD) == b"   "


def test_ranks_are_whole_with_ties_and_empty_tables(spark, odd, clashing):
    target = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert resample(odd.limit(0), target).count() == 0 and resample(odd, target.limit(0)).count() == odd.count()
    same = spark.createDataFrame([(5, "a b c d e " * 5)] * 300 + [(6, None)], "doc_id long, text string")
    got = [r["rank"] for r in resample(same, target, percent=50).collect()]
    assert sorted(x for x in got if x) == list(range(1, 151)) and len(got) == 301
    want = plain([(r.doc_id, r.text) for r in clashing.collect()], ["the cat"])
    drawn = lambda rows: sorted(x[3:] for x in rows if x[4])
    assert drawn([tuple(r) for r in resample(clashing, target).collect()]) == drawn(want)
