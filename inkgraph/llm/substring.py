"""Substring dedup with difference-cover anchors.

A window is `window` consecutive words. Anchors are shorter windows at word positions p with p mod 13 in
{0, 1, 3, 9}. For any two positions i and j there is a d < 13 with both i+d and j+d in that set, so
two equal windows share an equal anchor at the same place inside them. Only windows that hold an anchor seen
more than once can repeat; the others are settled without being moved.

Documents are dealt into blocks, whose texts are shuffled once; the three passes below read that
same exchange.

1. Each block sends its distinct anchor hashes to buckets. A bucket answers each block with those it also has
   from another block.
2. A block extends its repeated anchors to the windows that hold one, settles repeats inside the block, and sends
   the first occurrence of each distinct window, under 96 bits of hash, to buckets. A bucket answers each block
   with the positions of windows which start earlier in another block. The bits are of two hashes of all words, see `_bytes`, that share no step.
3. A block marks the words its repeated windows cover and drops them.

A passage that a third of all documents hold is one hash for each block, not a row for each document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

U64 = np.uint64
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Of an anchor's 64 bits the top ones choose its bucket; so many more are sent.
ANCHOR = np.dtype([("low", "<u4"), ("high", "u1")])
SPOT = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<u4"), ("at", "<u4")])
PLACE = np.dtype([("doc", "<u4"), ("at", "<u4")])


class Block:
    """The documents of one block in order of id, as flat word hashes."""

    def __init__(self, docs: pa.Table, window: int):
        self.docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.off = B.buffer_of(self.docs.column("text"))
        self.starts, self.ends, self.first = B.words(self.data, self.off)
        self.hash = B.word_hashes(self.data, self.starts, self.ends, 1)
        self.window, self.length = window, window - PERIOD + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes and hashes of all anchors."""
        at = B.inside(self.first, self.length)
        local = at - np.repeat(self.first[:-1], np.maximum(np.diff(self.first) - self.length + 1, 0))
        at = at[np.isin(local % PERIOD, COVER)]
        return at, B.window_hashes(self.hash, self.length, 2)[at] if len(at) else np.zeros(0, U64)


def spread(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash: its top 32 bits, scaled."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _groups(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs in a sorted array."""
    if len(key):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(key[a]), a, b


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "body": pa.array([r[2] for r in rows], pa.binary())})


MESSAGE = "bucket long, block long, body binary"


def _send_anchors(window: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        _, h = Block(docs, window).anchors()
        h, n = np.unique(h, return_counts=True)
        body = np.empty(len(h), ANCHOR)
        body["low"], body["high"] = h.astype(np.uint32), (h >> U64(32)).astype(np.uint8)
        rows = [(k, block, body[a:b].tobytes()) for k, a, b in _groups(spread(h, buckets))]
        return _rows(rows)

    return run


def _answer_anchors(messages: pa.Table) -> pa.Table:
    """For each block the low bits of those anchors that another block has sent too."""
    bodies = [np.frombuffer(x, ANCHOR) for x in messages.column("body").to_pylist()]
    key = np.concatenate([x["low"].astype(U64) | (x["high"].astype(U64) << U64(32)) for x in bodies])
    owner = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    blocks, bucket, rows = messages.column("block").to_pylist(), messages.column("bucket")[0].as_py(), []
    for k, body in enumerate(bodies):
        if len(got := body[twice[owner == k]] if len(bodies) < 64 else body[twice[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]]):
            rows.append((bucket, blocks[k], got.tobytes()))
    return _rows(rows)


def _send_windows(window: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _rows([])
        number, block = docs.column("block")[0].as_py(), Block(docs, window)
        at, h = block.anchors()
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        again[order[1:][same]] = again[order[:-1][same]] = True
        got = {b: np.frombuffer(x, ANCHOR) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True)}
        hs = h[order]
        for k, a, b in _groups(spread(hs, buckets)):
            if k in got:
                wanted = np.sort(got[k]["low"].astype(U64) | (got[k]["high"].astype(U64) << U64(32)))
                mine = hs[a:b] & U64((1 << 40) - 1)
                place = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                again[order[a:b]] |= wanted[place] == mine
        # windows that hold a repeated anchor: those that start at most PERIOD - 1 words before it
        mark = np.zeros(len(block.hash) + PERIOD + 1, np.int32)
        np.add.at(mark, at[again] + 1, -1)
        np.add.at(mark, np.maximum(at[again] - PERIOD + 1, 0), 1)
        holds = np.cumsum(mark)[: len(block.hash)] > 0
        spots = B.inside(block.first, window)
        spots = spots[holds[spots]]
        if not len(spots):
            return _rows([])
        second = B.word_hashes(block.data, block.starts, block.ends, 3)
        a, b = B.window_hashes(block.hash, window, 4)[spots], (B.window_hashes(second, window, 5)[spots] >> U64(32)).astype(np.uint32)
        order = np.lexsort((spots, b, a))
        a, b, spots = a[order], b[order], spots[order]
        repeat = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        doc = np.searchsorted(block.first, spots, "right") - 1
        place = np.empty(len(spots), SPOT)
        place["a"], place["b"], place["doc"], place["at"] = a, b, doc, spots - block.first[doc]
        rows = [(-1 - number, number, place[["doc", "at"]][repeat].astype(PLACE).tobytes())] if repeat.any() else []
        a, place = a[~repeat], place[~repeat]
        ids = block.docs.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        for k, i, j in _groups(spread(a, buckets)):
            used, index = np.unique(place["doc"][i:j], return_inverse=True)
            head = np.array([len(used)], "<i8").tobytes() + ids[used].astype("<i8").tobytes() + used.astype("<u4").tobytes()
            body = place[i:j].copy()
            body["doc"] = index
            rows.append((k, number, head + body.tobytes()))
        return _rows(rows)

    return run


def _answer_windows(messages: pa.Table) -> pa.Table:
    """For each block the places of those windows that another block has from a smaller id."""
    bucket = messages.column("bucket")[0].as_py()
    if bucket < 0:
        return messages
    blocks, parts, ids, docs = messages.column("block").to_pylist(), [], [], []
    for x in messages.column("body").to_pylist():
        n = int(np.frombuffer(x, "<i8", 1)[0])
        body = np.frombuffer(x, SPOT, offset=8 + 12 * n)
        ids.append(np.frombuffer(x, "<i8", n, 8)[body["doc"]])
        docs.append(np.frombuffer(x, "<u4", n, 8 + 8 * n)[body["doc"]])
        parts.append(body)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    key, ids, docs = np.concatenate(parts), np.concatenate(ids), np.concatenate(docs)
    order = np.lexsort((np.array(blocks)[owner], ids, key["b"], key["a"]))
    k = key[order]
    later = order[np.concatenate([[False], (k["a"][1:] == k["a"][:-1]) & (k["b"][1:] == k["b"][:-1])])]
    later = np.sort(later)
    out = np.empty(len(later), PLACE)
    out["doc"], out["at"] = docs[later], key["at"][later]
    return _rows([(bucket, blocks[j], out[a:b].tobytes()) for j, a, b in _groups(owner[later])])


def _drop(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]
        if docs.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())], names)
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, off = B.buffer_of(docs.column("text"))
        starts, ends, first = B.words(data, off)
        mark = np.zeros(len(starts) + 1, np.int32)
        for x in answers.column("body").to_pylist():
            place = np.frombuffer(x, PLACE)
            at = first[place["doc"]] + place["at"]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
        keep = np.cumsum(mark)[:-1] == 0
        raw, kept, sha, gone = data.tobytes(), [], [], []
        cleared = np.concatenate([[0], np.cumsum(~keep)])[first]
        for i in range(docs.num_rows):
            lo, hi = first[i], first[i + 1]
            gone.append(int(cleared[i + 1] - cleared[i]))
            parts = raw[off[i] : off[i + 1]].split()
            if gone[-1]:
                parts = [parts[k] for k in np.flatnonzero(keep[lo:hi]).tolist()]
            text = b" ".join(parts)
            kept.append(text)
            sha.append(hashlib.sha256(text).hexdigest())
        return pa.table([docs.column("doc_id"), pa.array(np.diff(first)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names)

    return run


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 20, block_bytes: int = 1 << 23, blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256: one row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. Each word that is covered by a window of `window` words whose sequence also starts
    earlier (smaller id, or same document and earlier start) is removed; windows are judged on the input. kept_text is
    what is left, joined by single spaces. A null text has no words. A null id counts as the largest. Of rows that
    repeat an id one (any, if their texts differ) counts as the earlier. An empty table gives no rows. A very long text is a block of its
    own size. Columns other than id and text, whatever their names, are not read.

    A block holds about `block_bytes` of text (or one longer document); `blocks` sets their number instead.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if blocks is None:
        total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, math.ceil(total / block_bytes))
    buckets = blocks
    # by id and text: rows without an id, or with a common one, lie in many blocks; as many tasks as blocks, however many there are
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")

    def by_block(frame: DataFrame):
        return frame.groupBy("block")

    sent = by_block(dealt).applyInArrow(_send_anchors(window, buckets), MESSAGE)
    known = sent.groupBy("bucket").applyInArrow(_answer_anchors, MESSAGE)
    found = by_block(dealt).cogroup(by_block(known)).applyInArrow(_send_windows(window, buckets), MESSAGE)
    places = found.groupBy("bucket").applyInArrow(_answer_windows, MESSAGE)
    result = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return by_block(dealt).cogroup(by_block(places)).applyInArrow(_drop(window), result)
