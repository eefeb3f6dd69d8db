import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from inkgraph.llm import _bytes as B
from inkgraph.llm.exact_dedup import cuts, exact_dedup
from inkgraph.llm.line_dedup import line_dedup
from inkgraph.llm.simhash import ball, bit_counts, simhash_groups
from inkgraph.llm.substring import COVER, PERIOD, substring_dedup

WORD = "[^\x20\x09-\x0d]+"


def rows(df, *c):
    return Counter(tuple(r[x] for x in c) for r in df.collect())


def test_exact_dedup_equals_brute_force(both):
    got = rows(exact_dedup(both), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = defaultdict(list)
    for r in both.collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append(r)
    want = Counter()
    for key, g in groups.items():
        top = min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in g:
            want[(r.doc_id, top.doc_id, len(g), r.doc_id == top.doc_id and len(r.text or "") == len(top.text or ""), hashlib.sha256(key.encode()).hexdigest())] += 1
    assert got == want


def test_colliding_chunk_names_are_drawn_anew(docs):
    few = docs.limit(40)
    assert rows(exact_dedup(few, name_bytes=1), "doc_id", "keep_id") == rows(exact_dedup(few), "doc_id", "keep_id")


def test_empty_and_clashing(odd):
    for op in (exact_dedup, simhash_groups, substring_dedup, line_dedup):
        assert op(odd.limit(0)).count() == 0
        assert op(odd).count() == odd.count()


def test_cuts_resist_shifts():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 60_000).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 256, 17).astype(np.uint8), a])
    pieces = lambda x: {x[i:j].tobytes() for i, j in itertools.pairwise([0, *cuts(x, np.array([0, len(x)]))[0].tolist()])}
    assert len(pieces(a) & pieces(b)) > 0.8 * len(pieces(a))
    ends, first = cuts(np.zeros(300_000, np.uint8), np.array([0, 0, 200_000, 300_000]))
    assert np.diff(ends, prepend=0).max() <= 1 << 16 and first.tolist()[0] == 0 and first[-1] == len(ends)


def fingerprint(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(both):
    prints = {r.doc_id: fingerprint(r.text) for r in both.collect() if r.doc_id is not None}
    top = {k: k for k in prints}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(both).collect() if r.doc_id is not None}
    assert got == {(k, f"{p:016x}", find(k)) for k, p in prints.items()}


def test_chains_of_fingerprints_are_one_component(spark):
    from inkgraph.llm._cluster import components
    from inkgraph.llm.simhash import link_prints

    rng = np.random.default_rng(3)
    prints, at = [], 0
    for _ in range(40):  # each differs from the last by two bits
        at ^= (1 << int(rng.integers(63))) | (1 << int(rng.integers(63)))
        prints.append(at)
    prints += [int(x) for x in rng.integers(1 << 62, size=20)]
    df = spark.createDataFrame([(p,) for p in set(prints)], "print long")
    links = link_prints(df)
    start = links.groupBy("a").agg({"b": "min"}).selectExpr("a AS node", "least(a, `min(b)`) AS label")
    label = {r.node: r.label for r in components(start, links).collect()}
    assert len({label[p] for p in prints[:40]}) == 1
    assert df.select(ball(df["print"], 1).alias("v")).selectExpr("size(array_distinct(v)) AS n").distinct().collect()[0].n == 65


def test_bit_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    starts = np.array([0, 1, 300, 1900])
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert (bit_counts(h, starts) == np.add.reduceat(bits.astype(int), starts, axis=0)).all()


def test_cover_meets_every_shift():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_substring_dedup_equals_brute_force(spark, both, blocks):
    long = spark.createDataFrame([(910, "a b " * 40), (911, "q " * 21 + "r"), (912, " ".join(f"w{i}" for i in range(60))), (913, "z " + " ".join(f"w{i}" for i in range(20, 55)))], "doc_id long, text string")
    df = both.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(long)
    seen, want = set(), set()
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        w = re.findall(WORD, r.text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.add((r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert set(rows(substring_dedup(df, blocks=blocks), "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) == want


def test_line_dedup_by_hand(spark):
    text = "a\nb\nc\nd\ne\nf"
    df = spark.createDataFrame([(1, None), (2, ""), (3, text), (4, f"x\n{text}\ny"), (5, f"{text}\n{text}"), (6, "\n\n\n")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup(df).collect()}
    assert got[1] == (0, 0, "") and got[2] == (1, 0, "") and got[3] == (6, 0, text) and got[6] == (4, 2, "\n")
    assert got[4][1] >= 2 and got[4][2].startswith("x\n") and got[4][2].endswith("\ny")
    assert got[5][1] > got[4][1]


def test_word_kernels():
    import pyarrow as pa

    texts = ["a  bb\tc", "", None, "é x y", " z"]
    data, off = B.buffer_of(pa.array(texts))
    s, e, first = B.words(data, off)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(s, e, strict=True)] == ["a", "bb", "c", "é x", "y", "z"] and np.diff(first).tolist() == [3, 0, 0, 2, 1]
    h = B.word_hashes(data, s, e, 1)
    w = np.tile(h, 3)
    win = B.window_hashes(w, 2, 1)
    assert len(set(win.tolist())) == 6 and (win[:5] == win[6:11]).all()
    step, B.STEP = B.STEP, 8
    try:
        assert (B.word_hashes(data, s, e, 1) == h).all() and (B.window_hashes(w, 2, 1) == win).all()
    finally:
        B.STEP = step


def thue_morse(n):
    """A word over a and b and its complement: polynomials modulo a power of two take the same value at both, whatever their base."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_and_passages_do_not_collide(spark):
    from inkgraph.llm.near_dedup import near_groups

    one, two = thue_morse(10)
    text = lambda x: " ".join([*(f"w{i}" for i in range(13)), x, *(f"v{i}" for i in range(12))])
    words = [" ".join("red" if c == "a" else "blue" for c in x) for x in thue_morse(9)]
    df = spark.createDataFrame([(1, text(one)), (2, text(two)), (3, words[0]), (4, words[1])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df.where("doc_id < 3")).collect()}
    assert got == {1: (26, 0), 2: (26, 0)}
    whole = {r.doc_id: r.n_removed for r in substring_dedup(df.where("doc_id > 2"), window=512).collect()}
    assert whole == {3: 0, 4: 0}  # windows as long as the texts
    wide = near_groups(df, width=26)
    assert {r.doc_id: r.component_id for r in wide.where("doc_id < 3").collect()} == {1: 1, 2: 2}
    five = {r.doc_id: r.component_id for r in near_groups(df).collect()}
    assert five[1] == 1 and five[2] == 2 and five[4] == 3  # words in the same patterns of five are alike


def test_window_hashes_tell_all_windows_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    for length in (1, 2, 3, 5, 8, 20, 31):
        got = B.window_hashes(words, length, 4)
        seen = {}
        assert all(seen.setdefault(tuple(words[i : i + length].tolist()), h) == h for i, h in enumerate(got.tolist())) and len(set(seen.values())) == len(seen)
