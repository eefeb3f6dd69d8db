"""Token counts by a compiled finite-state transducer.

The tokenizer is BPE over pieces with scores (a sentencepiece model with byte fallback). For such merges the last
token of a prefix of the text is settled by the prefix alone: it is the one piece t that ends there, encodes to
itself and stands next to the last token of what is before it without merging. So a state needs the longest
suffix that can still grow into a piece, and for each place in it the last token there and its count relative to now;
that is finite, and each transition is annotated with the change of the token count.

A piece never holds a space sign after another character, so a space sign after another character resets the machine.
From reset to reset lies a word. A word is one transition from the start state to itself, annotated with its tokens; these are
compiled when a text first needs them, all new words of a batch together: `Compiler` holds each word's state in arrays
and advances all of them by a character at a time.

Such maps from the start to itself compose by adding their counts.

Longer stretches without a reset are cut into chunks, and `Transducer` compiles single characters into a table. A chunk's map gives
exit state and count by entry state, for all states that the chunk before it can leave; all chunks of a batch are mapped
at once. A chunk with a reset has one exit state. The maps compose pairwise in a parallel prefix scan (`composed`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices

SPACE_SIGN = "▁"
CHUNK = 1024
#: A machine that reads so many characters from the start state mostly agrees with one that has read all before them.
AHEAD = 64
#: Words up to this length are transitions of their own; at most so many are kept.
WORD, KEPT = 48, 400_000
SHIFT, BIAS = 6, 32


class Transducer:
    """Deterministic; state 0 is the start and follows every reset."""

    def __init__(self, model_file: str, entries: int = 1 << 24):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if sp.encode("a")[:1] != [sp.piece_to_id(SPACE_SIGN + "a")] or any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in self.score):
            raise ValueError("the model is not BPE over words with a leading space sign")
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        letters = sorted({c for p in self.score for c in p})
        # classes 0 to 3: characters in no piece, by their number of bytes less one; then each letter as it comes
        self.letters, self.known = set(letters), [""] * 4
        self.klass = np.full(0x110000, -1, np.int32)
        self.klass[:0x80], self.klass[0x80:0x800], self.klass[0x800:0x10000], self.klass[0x10000:] = 0, 1, 2, 3
        self.klass[[ord(c) for c in letters]] = -1
        self.entries, self.width = entries, 256
        self.cost = {c: 1 if c in self.score else len(c.encode()) for c in letters}
        self.alone: dict[str, bool] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table = np.full(max(64, self.entries // self.width) * self.width, -1, np.int32)
        self.intern(("", (("", 0),)))

    def intern(self, state: tuple) -> int:
        if (got := self.number.get(state)) is None:
            got = self.number[state] = len(self.states)
            self.states.append(state)
        return got

    def pieces(self, text: str) -> list[str]:
        """BPE: of all neighbours that make a piece, those with the best score merge, the leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, before: str, piece: str) -> bool:
        if (ok := self.alone.get(piece)) is None:
            ok = self.alone[piece] = self.pieces(piece) == [piece]
        if ok and before:
            if (got := self.apart.get((before, piece))) is None:
                got = self.apart[before, piece] = self.pieces(before + piece) == [before, piece]
            return got
        return ok

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The next state and the change of the count, for a letter."""
        tail, past = state
        if char == SPACE_SIGN and not tail.endswith(SPACE_SIGN):
            tail, past = "", (("", 0),)
        text = tail + char
        for j, place in enumerate(past):
            piece = text[j:]
            if place is not None and (len(piece) == 1 or piece in self.score) and self.stands(place[0], piece):
                change = place[1] + (self.cost[char] if len(piece) == 1 else 1)
                break
        else:
            raise AssertionError(f"no last token after {text!r}")
        j = 0
        while j < len(text) and text[j:] not in self.prefixes:
            j += 1
        later = [(p[0], p[1] - change) if p is not None and text[k:] in self.prefixes else None for k, p in enumerate(past[j:], j)] if j < len(text) else []
        return (text[j:], (*later, (piece, 0))), change

    def fill(self, states: np.ndarray, classes: np.ndarray) -> None:
        for key in np.unique(states.astype(np.int64) * self.width + classes).tolist():
            if self.table[key] < 0:
                s, k = divmod(key, self.width)
                if k < 4:
                    to, change = 0, k + 1
                else:
                    state, change = self.step(self.states[s], self.known[k])
                    to = self.intern(state)
                self.table[key] = (to << SHIFT) + change + BIAS

    def classes(self, points: np.ndarray) -> np.ndarray:
        got = self.klass[points]
        if len(got) and got.min() < 0:
            for p in np.unique(points[got < 0]).tolist():
                self.klass[p] = len(self.known)
                self.known.append(chr(p))
            got = self.klass[points]
            if len(self.known) > self.width:
                while self.width < len(self.known):
                    self.width *= 2
                self.forget()
        return got

    def run(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks, all advanced together."""
        order = np.argsort(-lengths, kind="stable")
        at, state, count = starts[order], entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        sizes = lengths[order]
        active = len(order) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
        for t, n in enumerate(active.tolist()):
            if len(self.states) + n > len(self.table) // self.width:
                live = [self.states[s] for s in state.tolist()]
                if len(set(live)) + n > len(self.table) // self.width:
                    self.entries *= 2
                self.forget()
                state = np.array([self.intern(s) for s in live])
            k = codes[at[:n] + t]
            s = state[:n]
            key = s * self.width + k
            got = self.table[key]
            if got.min() < 0:
                missing = got < 0
                self.fill(s[missing], k[missing])
                got = self.table[key]
            count[:n] += (got & ((1 << SHIFT) - 1)) - BIAS
            state[:n] = got >> SHIFT
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text. An empty text has none; the others get a space sign in front."""
        total = np.zeros(len(texts), np.int64)
        used = [i for i, t in enumerate(texts) if t]
        if not used:
            return total
        points = np.frombuffer("".join(" " + texts[i] for i in used).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[points == 0x20] = ord(SPACE_SIGN)
        codes, sign = self.classes(points), points == ord(SPACE_SIGN)
        sizes = np.array([len(texts[i]) + 1 for i in used])
        ends = np.cumsum(sizes)
        chunks = (sizes + chunk - 1) // chunk
        owner = np.repeat(np.arange(len(used)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = (ends - sizes)[owner] + nth * chunk
        hi = np.minimum(lo + chunk, ends[owner])
        reset = sign.copy()
        reset[1:] &= ~sign[:-1]
        resets = np.flatnonzero(reset)
        place = np.minimum(np.searchsorted(resets, lo), len(resets) - 1)
        first = np.where((resets[place] >= lo) & (resets[place] < hi), resets[place], -1)
        first = np.where(nth == 0, lo, first)
        # after its first reset a chunk's map does not depend on the entry state
        have = np.flatnonzero(first >= 0)
        state, got = self.run(codes, first[have], hi[have] - first[have], np.zeros(len(have), np.int64))
        after = np.zeros(len(lo), np.int64)
        after[have] = got
        leaves: list[tuple | None] = [None] * len(lo)
        for i, s in zip(have.tolist(), state.tolist(), strict=True):
            leaves[i] = self.states[s]  # numbers may be given anew later
        maps = self.maps(codes, lo, np.where(first < 0, hi, first), nth, after, leaves)
        total[used] = composed(maps, nth)[ends_of(chunks)]
        return total

    def maps(self, codes: np.ndarray, lo: np.ndarray, end: np.ndarray, nth: np.ndarray, after: np.ndarray, leaves: list[tuple | None]) -> list[dict[tuple, tuple[tuple, int]]]:
        """Of each chunk, exit state and count by entry state, for each state that the chunk before it can leave.

        Only what lies before `end` depends on the entry state; `after` and `leaves` are the count and the exit state of the rest. A chunk
        after one without a reset begins with a guess: the state that the AHEAD characters before it lead to from the start. Each round
        runs all entry states that have come up, of all chunks at once; chunks of equal content are run once. The rounds end when each map
        covers what the one before it leaves: after two or three, but for text that no few characters settle.
        """
        start = self.states[0]
        maps: list[dict] = [{start: (leaves[i], int(after[i]))} if k == 0 else {} for i, k in enumerate(nth.tolist())]
        ask = {(i, leaves[i - 1]) for i in np.flatnonzero(nth > 0).tolist() if leaves[i - 1] is not None}
        blind = np.array([i for i in np.flatnonzero(nth > 0).tolist() if leaves[i - 1] is None], np.int64)
        if len(blind):
            back = np.minimum(AHEAD, lo[blind] - lo[blind - 1])
            state, _ = self.run(codes, lo[blind] - back, back, np.zeros(len(blind), np.int64))
            ask |= {(i, self.states[s]) for i, s in zip(blind.tolist(), state.tolist(), strict=True)}
        numbers: dict[bytes, int] = {}
        content = [numbers.setdefault(codes[i:j].tobytes(), len(numbers)) for i, j in zip(lo.tolist(), end.tolist(), strict=True)]
        known: dict[tuple[int, tuple], tuple[tuple, int]] = {}
        while ask:
            new = list({(content[i], entry): i for i, entry in ask}.items())
            index = np.array([i for _, i in new])
            state, got = self.run(codes, lo[index], end[index] - lo[index], np.array([self.intern(s) for (_, s), _ in new]))
            known |= {key: (self.states[s], n) for (key, _), s, n in zip(new, state.tolist(), got.tolist(), strict=True)}
            todo, ask = list(ask), set()
            while todo:
                i, entry = todo.pop()
                if entry in maps[i]:
                    continue
                if (hit := known.get((content[i], entry))) is None:
                    ask.add((i, entry))
                    continue
                maps[i][entry] = to = (leaves[i] or hit[0], hit[1] + int(after[i]))
                if i + 1 < len(nth) and nth[i + 1] > 0:
                    todo.append((i + 1, to[0]))
        return maps


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """Place of the last of each run of so many."""
    return np.cumsum(sizes) - 1


def composed(maps: list[dict], nth: np.ndarray) -> np.ndarray:
    """Count from the first chunk of a text to each of its chunks: a prefix scan that composes maps pairwise, in as many steps as the
    logarithm of the chunks of a text. Row i of `to` and `count` holds the map of the chunks up to i by entry state.
    """
    place = [{s: k for k, s in enumerate(m)} for m in maps]
    width = max(map(len, maps))
    to, count = np.zeros((len(maps), width), np.int64), np.zeros((len(maps), width), np.int64)
    for i, m in enumerate(maps):
        follows = i + 1 < len(maps) and nth[i + 1] > 0
        for k, (state, n) in enumerate(m.values()):
            to[i, k], count[i, k] = place[i + 1][state] if follows else 0, n
    step = 1
    while len(late := np.flatnonzero(nth >= step)):
        early = to[late - step]
        count[late] = count[late - step] + np.take_along_axis(count[late], early, 1)
        to[late] = np.take_along_axis(to[late], early, 1)
        step *= 2
    return count[:, 0]


class Compiler:
    """Counts the tokens of many short words at once, each from the start state.

    Pieces are numbered; letters which are no piece get numbers of their own after them. The trie of all pieces has
    failure links, so a node is the longest suffix that can grow into a piece; `ends[node]` is the longest piece that ends
    there and `shorter[piece]` the next one.
    """

    def __init__(self, base: Transducer):
        self.base = base
        self.names = [*base.score, *(c for c in base.letters if c not in base.score)]
        number = {p: i for i, p in enumerate(self.names)}
        self.size = np.array([len(p) for p in self.names])
        self.cost = np.array([base.cost[p] if len(p) == 1 else 1 for p in self.names])
        self.alone = np.array([base.stands("", p) for p in self.names])
        self.letter = {c: i for i, c in enumerate(sorted(base.letters))}
        nodes = ["", *sorted(base.prefixes | base.letters, key=lambda p: (len(p), p))]
        at = {p: i for i, p in enumerate(nodes)}
        self.fail = np.zeros(len(nodes), np.int64)
        self.ends = np.full(len(nodes), -1, np.int64)
        self.shorter = np.full(len(self.names), -1, np.int64)
        for i, p in enumerate(nodes[1:], 1):
            k = 1
            while k < len(p) and p[k:] not in at:
                k += 1
            self.fail[i] = at[p[k:]]
            below = self.ends[self.fail[i]]
            self.ends[i] = number.get(p, below)
            if p in number:
                self.shorter[number[p]] = below
        edges = sorted((at[p[:-1]] * len(self.letter) + self.letter[p[-1]], i) for i, p in enumerate(nodes) if p)
        self.edge = np.array([e[0] for e in edges] + [np.iinfo(np.int64).max])
        self.target = np.array([e[1] for e in edges] + [0])
        self.point = np.full(0x110000, -1, np.int32)
        for c, i in self.letter.items():
            self.point[ord(c)] = i
        self.pair = np.zeros(0, np.int64)
        self.pair_ok = np.zeros(0, bool)

    def apart(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = before * len(self.names) + piece
        place = np.searchsorted(self.pair, key)
        hit = np.zeros(len(key), bool)
        if len(self.pair):
            hit = self.pair[np.minimum(place, len(self.pair) - 1)] == key
        if not hit.all():
            new = np.unique(key[~hit])
            ok = np.array([self._apart(*divmod(k, len(self.names))) for k in new.tolist()])
            both, at = np.concatenate([self.pair, new]), np.concatenate([self.pair_ok, ok])
            order = np.argsort(both, kind="stable")
            self.pair, self.pair_ok = both[order], at[order]
            place = np.searchsorted(self.pair, key)
        return self.pair_ok[place]

    def _apart(self, before: int, piece: int) -> bool:
        a, b = self.names[before], self.names[piece]
        return self.base.pieces(a + b) == [a, b]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; a word is spaces, then other characters."""
        if len(self.pair) > 2_000_000:
            self.pair, self.pair_ok = self.pair[:0], self.pair_ok[:0]
        words_ = sorted(range(len(words)), key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in words_])
        points = np.frombuffer("".join(words[i] for i in words_).replace(" ", SPACE_SIGN).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size) - size
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        last = np.full((len(size), size[0] + 1), -1, np.int64)  # -1: nothing can merge with what is before
        total = np.zeros((len(size), size[0] + 1), np.int64)
        node = np.zeros(len(size), np.int64)
        for t, n in enumerate(active.tolist()):
            point = points[start[:n] + t]
            letter = self.point[point]
            at, unknown = node[:n].copy(), letter < 0
            todo = np.flatnonzero(~unknown)
            while len(todo):
                key = at[todo] * len(self.letter) + letter[todo]
                place = np.searchsorted(self.edge, key)
                hit = self.edge[place] == key
                at[todo[hit]] = self.target[place[hit]]
                todo = todo[~hit]
                at[todo] = self.fail[at[todo]]
            at[unknown] = 0
            node[:n] = at
            p = point[unknown]
            total[:n, t + 1][unknown] = total[:n, t][unknown] + 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
            todo, piece = np.flatnonzero(~unknown), self.ends[at[~unknown]]
            while len(todo):
                back = t + 1 - self.size[piece]
                before = last[todo, back]
                ok = self.alone[piece]
                ask = np.flatnonzero(ok & (before >= 0))
                ok[ask] = self.apart(before[ask], piece[ask])
                done = todo[ok]
                last[done, t + 1] = piece[ok]
                total[done, t + 1] = total[done, back[ok]] + self.cost[piece[ok]]
                todo, piece = todo[~ok], self.shorter[piece[~ok]]
        out = np.empty(len(size), np.int64)
        out[words_] = total[np.arange(len(size)), size]
        return out


class Counter:
    """Counts whole texts."""

    SPLIT = re.compile(" +[^ ]*")

    def __init__(self, model_file: str, word: int = WORD, kept: int = KEPT):
        self.base = Transducer(model_file)
        self.compiler = Compiler(self.base)
        self.word, self.kept, self.words = word, kept, {}

    def count(self, texts: list[str]) -> np.ndarray:
        parts = [self.SPLIT.findall(" " + t.replace(SPACE_SIGN, " ")) if t else [] for t in texts]
        new = set().union(*parts).difference(self.words)
        if len(self.words) + len(new) > self.kept:
            self.words.clear()
            new = set().union(*parts)
        short = sorted(w for w in new if len(w) <= self.word)
        for i in range(0, len(short), 1 << 15):
            some = short[i : i + (1 << 15)]
            self.words.update(zip(some, self.compiler.count(some).tolist(), strict=True))
        long = sorted(w for w in new if len(w) > self.word)
        known = self.words | dict(zip(long, self.base.count([w[1:] for w in long]).tolist(), strict=True)) if long else self.words
        return np.array([sum(map(known.__getitem__, p)) for p in parts], np.int64)


_MACHINES: dict[str, Counter] = {}


def machine(model_file: str) -> Counter:
    if model_file not in _MACHINES:
        _MACHINES[model_file] = Counter(model_file)
    return _MACHINES[model_file]


def _count(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_file)
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 22)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bytes_ = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(bytes_, pa.int64()), pa.array(m.count(texts))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_file: str, id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs, in one pass without a shuffle.

    n_tokens is what the sentencepiece model at `model_file` gives for the whole text without begin or end tokens;
    the path must exist on every executor. A null text is empty: 0 bytes, 0 tokens. A very long text is counted whole, by its words. Ids
    are passed on as they are, null and repeated ones too; rows do not depend on one another, so there are no ties. An empty table
    gives no rows. Columns other than id and text, whatever their names, are not read.
    """
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = base.mapInArrow(_count(model_file), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
