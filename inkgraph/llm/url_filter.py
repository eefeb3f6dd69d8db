"""URL filters: a weighted vocabulary counted by Aho-Corasick, and rules by host and path.

All URLs of a batch are searched as one text, by one pass of the automaton; a hit counts if no word character touches it. Terms whose
weight reaches `limit` are strict, the others soft: a URL is rejected when the weights of the distinct terms it holds reach `limit`, so by one strict
or several distinct soft terms. A rule, where one fits, decides instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of all terms and rules, which each task holds.
MOST = 1 << 24
LIMIT = 2
#: Weights of a small default vocabulary; strict terms weigh LIMIT.
TERMS = {t: LIMIT for t in "adult casino escort hentai hookup jackpot poker porn roulette sex slots spam viagra warez xxx".split()} | {
    t: 1 for t in "ads bet bets bonus cheap click crack dating deals download farm free keygen lottery nude pharma pills promo replica torrent track win winner".split()
}
#: host and path, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ESCAPE = re.compile("%[0-9a-f]{2}")
RESULT = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_distinct long"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; and from there to `?`, `#` or the end. Both empty without `://`."""
    at = F.instr(url, "://")
    tail = F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^?#]*", 0)), F.lit(""))
    host = F.regexp_extract(tail, r"^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.substr(tail, F.length(host) + 1)


class Rules:
    """Rules by host; a host's rules by path."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), {})[slash + path] = (rule, verdict)
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule, in characters, then the one with the longest host, whose host this is or lies under and with whose path this one starts."""
        best, at = None, 0
        while True:
            if (suffix := host[at:]) in self.by_host:
                paths = self.by_host[suffix]
                hit = next((paths[path[:n]] for n in self.lengths[suffix] if path[:n] in paths), None)
                if hit and (best is None or len(hit[0]) > len(best[0])):
                    best = hit
            if not (dot := host.find(".", at) + 1):
                return best
            at = dot


class Vocabulary:
    def __init__(self, terms: Mapping[str, float], limit: float):
        self.limit, self.weight = limit, np.array(list(terms.values()), float)
        self.strict = self.weight >= limit
        self.machine = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.machine.add_word(term, (k, len(term)))
        if len(terms):
            self.machine.make_automaton()

    def count(self, urls: list[str | None]) -> tuple[np.ndarray, ...]:
        """For each URL: hits of strict terms, of soft terms, distinct soft terms, and whether the weights of its distinct terms reach the limit."""
        n = len(urls)
        low = [ESCAPE.sub(" ", u.translate(_FOLD)) if u else "" for u in urls]
        text = "\n" + "\n".join(low) + "\n"
        row, term = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.weight) and n:
            found = np.array([(end - size + 1, end + 1, k) for end, (k, size) in self.machine.iter(text)], np.int64).reshape(-1, 3)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            solid = (points >= 0x80) | ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122))
            found = found[~solid[found[:, 0] - 1] & ~solid[found[:, 1]]]
            first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
            row, term = np.searchsorted(first, found[:, 0], "right") - 1, found[:, 2]
        strict = self.strict[term]
        once = np.unique(row * max(len(self.weight), 1) + term)
        own, kind = once // max(len(self.weight), 1), once % max(len(self.weight), 1)
        reached = np.bincount(own, self.weight[kind], n) >= self.limit if len(once) else np.zeros(n, bool)
        return np.bincount(row[strict], minlength=n), np.bincount(row[~strict], minlength=n), np.bincount(own[~self.strict[kind]] if len(once) else own, minlength=n), reached


_FOLD = dict(zip(map(ord, UPPER), LOWER, strict=True)) | {10: " "}


def _judge(terms: Mapping[str, float], rules: Sequence[tuple[str, str]], limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ruled = Vocabulary(terms, limit), Rules(rules)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                strict, soft, distinct, reached = words.count(batch.column(3).to_pylist())
                hits = [ruled.find(h, p) for h, p in zip(hosts, paths, strict=True)]
                verdict = [hit[1] if hit else "block" if bad else "allow" for hit, bad in zip(hits, reached.tolist(), strict=True)]
                rule = pa.array([hit[0] if hit else None for hit in hits], pa.string())
                counts = [pa.array(x, pa.int64()) for x in (strict, soft, distinct)]
                yield pa.record_batch([*[batch.column(k) for k in range(3)], rule, pa.array(verdict, pa.string()), *counts], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_distinct"])

    return run


def judge_urls(pages: DataFrame, id: str = "page_id", url: str = "url", terms: Mapping[str, float] = TERMS, rules: Sequence[tuple[str, str]] = tuple(RULES), limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_distinct: one row for each row of pages.

    A rule `host/path` fits its host and all hosts under it where the path starts with the rule's; the longest that fits gives
    the verdict (`allow` or `block`); of equally long ones that with the longer host. Otherwise the vocabulary does: `block` if the weights of the
    distinct terms in the URL reach `limit`. Terms are searched in the whole URL, A-Z lower-cased, %-escapes taken as
    spaces; a term counts where no ASCII letter, digit or non-ASCII character stands next to it. Hits may overlap.

    A null or empty URL, or one without `://`, has an empty host and path, so no rule; a null or empty one has no hits either and is allowed. A very
    long URL is searched whole. Ids are passed on as they are; repeated rows stay. An empty table gives no rows. Columns other than
    id and url, whatever their names, are not read. Terms and rules are held by each task: over MOST characters of them raise an error, as do
    empty terms and terms with capitals or line ends.
    """
    if sum(map(len, terms)) + sum(len(r) for r, _ in rules) > MOST:
        raise ValueError(f"terms and rules have over {MOST} characters")
    if any(not t or t != t.translate(_FOLD) for t in terms):
        raise ValueError("terms are not empty, lower-case and have no line ends")
    text = F.col(url).cast("string")
    host, path = host_and_path(text)
    base = pages.select(F.col(id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), text.alias("url"))
    return base.mapInArrow(_judge(dict(terms), list(rules), limit), RESULT)
