"""Plain versions, row by row, of the quality classifier, language ID and the token counter's scan."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from inkgraph.llm.langid import language_id
from inkgraph.llm.quality import quality
from inkgraph.llm.token_count import Counter as TokenCounter
from inkgraph.llm.token_count import Transducer

M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def is_letter(b):
    return 65 <= b <= 90 or 97 <= b <= 122 or b >= 128


def facts(text):
    """The ten statistics of a text, None where there is nothing to go by."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)

    def part(hits, of):
        return hits / of if of else None

    letters = [b for b in data if is_letter(b)]
    out = [
        part(sum(b in b"#$%&*@^_~<>{}[]\\=+`|" for b in data), len(data)),
        part(sum(65 <= b <= 90 for b in letters), len(letters)),
        part(data.count(b"!"), len(data)),
        part(sum(48 <= b <= 57 for b in data), len(data)),
    ]
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    out.append(len(set(triples)) / len(triples) if len(triples) >= 10 else None)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    out.append(len(set(lines)) / len(lines) if len(lines) >= 4 else None)
    cores = [w[:-1] if w[-1] in b".,;:?" else w for w in words]
    plain = [bool(c) and is_letter(c[0]) and all(is_letter(b) and not 65 <= b <= 90 for b in c[1:]) for c in cores]
    shares = [sum(plain), sum(p and len(c) <= 3 for p, c in zip(plain, cores, strict=True)), sum(words[i] == words[i - 1] for i in range(1, n)), sum(words[i] in words[max(0, i - 4) : i] for i in range(n))]
    return out + [s / n if n >= 10 else None for s in shares]


def ballot(f):
    rules = [(0.05, None, 1), (0.5, None, 1), (0.03, None, 1), (0.3, None, 1), (0.5, None, 0), (0.6, None, 0), (0.7, 0.9, 0), (0.08, 0.15, 0), (0.1, None, 1), (0.2, None, 1)]
    out = []
    for s, (bad, good, high) in zip(f, rules, strict=True):
        if s is not None and (s > bad if high else s < bad):
            out.append(0)
        elif s is not None and good is not None and s > good:
            out.append(1)
        else:
            out.append(-1)
    return out


def plain_quality(texts):
    """Votes of each row, EM over rows, and a dense logistic regression on the distinct texts."""
    rows = [ballot(facts(t)) for t in texts]
    share, start = 0.8, [{0: 0.4, 1: 0.1, -1: 0.5}, {0: 0.1, 1: 0.4, -1: 0.5}]
    chance = [[dict(c) for c in start] for _ in range(10)]

    def good(votes):
        bad, fine = (math.prod(chance[j][c][k] for j, k in enumerate(votes)) for c in (0, 1))
        return share * fine / (share * fine + (1 - share) * bad)

    for _ in range(100):
        p = [good(r) for r in rows]
        share = min(max(sum(p) / len(p), 0.001), 0.999)
        for c in (0, 1):
            weight = p if c else [1 - x for x in p]
            for j in range(10):
                n = {k: 10 * start[c][k] + sum(w for w, r in zip(weight, rows, strict=True) if r[j] == k) for k in (0, 1, -1)}
                chance[j][c] = {k: x / sum(n.values()) for k, x in n.items()}

    def features(t):
        data, x = (t or "").encode(), np.zeros(1 << 16)
        grams = Counter(((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(data) - 2))
        for k, n in grams.items():
            x[k] += 20 * n / grams.total()
        for j, s in enumerate(facts(t)):
            x[mix(j * 64 + (31 if s is None else min(int(s * 20), 20)) + (1 << 32)) >> 48] += 1
        return x

    known = sorted(set(texts), key=str)
    x, y = np.stack([features(t) for t in known]), np.array([good(ballot(facts(t))) for t in known])
    w, b, m, v = np.zeros(1 << 16), 0.0, np.zeros((1 << 16) + 1), np.zeros((1 << 16) + 1)
    for t in range(1, 151):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ error + 1e-4 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return {t: 1 / (1 + math.exp(-(features(t) @ w + b))) for t in known}


def test_quality_equals_plain_version(both):
    rows = both.collect()
    want = plain_quality([r.text for r in rows])
    got = quality(both).collect()
    text = defaultdict(set)
    for r in rows:
        text[r.doc_id].add(r.text)
    assert len(got) == len(rows) and len(want) > 50
    for r in got:
        assert any(r.quality == pytest.approx(want[t], abs=2e-3) for t in text[r.doc_id]), r
        assert r.kept == (r.quality >= 0.5)


def plain_grams(text):
    """Buckets of the 1- to 3-grams of letter runs, one gap between them, one before and two after the text."""
    low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    p = " " * 3 + " ".join(low.split()) + "  "
    for n in (1, 2, 3):
        for e in range(2, len(p)):
            h = 0
            for k in range(n):
                h = (h * 0x110001 + ord(p[e - k])) & M64
            yield mix((h + (n << 58)) & M64) >> 48


def test_language_id_equals_plain_version(both):
    """With fewer rows a language than its sample holds, so that the plain version learns from all."""
    rows = both.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    counts, seen = defaultdict(Counter), Counter()
    for r in rows:
        if not held(r) and r.lang is not None and r.text:
            counts[r.lang].update(plain_grams(r.text))
            seen[r.lang] += 1
    assert max(seen.values()) <= 500 and len(seen) > 2
    total = {x: c.total() + 0.1 * (1 << 16) for x, c in counts.items()}

    def plain(text):
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            return "und", 0.0
        grams = Counter(plain_grams(text))
        log = {x: math.log(seen[x] / seen.total()) + sum(n * math.log((counts[x][g] + 0.1) / total[x]) for g, n in grams.items()) for x in sorted(counts)}
        best = max(log, key=log.get)
        return best, 1 / sum(math.exp(v - log[best]) for v in log.values())

    want = sorted((r.doc_id or -1, held(r), *plain(r.text)) for r in rows)
    got = sorted((r.doc_id or -1, r.held_out, r.lang_pred, r.score) for r in language_id(both).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-3)


def test_chunk_maps_are_composed():
    """Text without spaces, where no chunk resets: equal to the library, in a few rounds for all chunks."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter = sentencepiece.SentencePieceProcessor(model_file=model), TokenCounter(model)
    rnd = random.Random(5)
    parts = ["the", "ing", "tion", "a", "e", "xq", "日本", "é", "ab", "st", "0", "12", "==", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(30_000)), "a" * 60_000, "=" * 30_001, "ab" * 20_000, "日" * 9_000, "".join(rnd.choice([*parts, " ", "   "]) for _ in range(3_000))]
    runs, run = [], Transducer.run

    def watched(self, *args):
        runs.append(len(args[1]))
        return run(self, *args)

    Transducer.run = watched
    try:
        for t in texts:
            runs.clear()
            assert counter.count([t])[0] == len(sp.encode(t))
            assert len(runs) <= 5
    finally:
        Transducer.run = run
    small = [t[:2_000] for t in texts]
    for chunk in (1, 7, 64):
        assert Transducer(model).count(small, chunk=chunk).tolist() == [len(x) for x in sp.encode(small)]
