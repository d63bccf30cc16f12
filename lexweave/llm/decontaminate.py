"""Benchmark decontamination by edit distance.

CGK embedding: a random walk reads a window of text, step by step; at step j it shows the character
under its pointer and moves on or stays, as a random table for j and that character says. Two windows
within few edits show equal characters at most steps, so edit distance becomes Hamming distance.
Sampling some of the steps makes a locality-sensitive hash of a window; several walks with tables of
their own reach the target recall.

Every item is read from each of its words, every document from each `stride`-th, with windows sized
to the item (at most `LONG` steps, of about half as many characters): a passage of an item has
several windows that may meet. Where two hashes meet, the whole item is aligned with the document
around that place, and the pair counts if the exact edit distance is at most `tolerance` of the
item's length.

Beside the walks, every byte of a document is looked up as the start of a gram of four, six or eight
bytes (by the item's length). Enough grams of an item near one diagonal also make the item be aligned
there. This finds every exact copy of `LEAST` bytes or more, in scripts without spaces too, at any
place and alignment. Recall near the tolerance is aimed at 0.98; the README has what was measured.

Texts are compared in lower case, with all but letters and digits as single spaces. Documents are read in one pass without a
shuffle; items go to the readers in blocks of at most `block_items`, and there are as many passages
over the documents as blocks.

Defined results: null, empty and blank texts leak nothing; items of fewer than `LEAST` normalised
bytes are found where they stand exactly, as whole words, if they have `least` bytes (by default none are searched,
the query and the pipeline search all); equal items are found each; repeated documents are
reported each; an empty benchmark leaks nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, LONG = 16, 72
_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_MULT, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of documents that are read at once, and alignments that are made side by side.
PART, ALIGNED = 512_000, 4000


class Seen:
    """A bit for each of some hashes, in a table of about 16 places a hash."""

    def __init__(self, keys: np.ndarray):
        bits = min(24, max(12, int(16 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys * _SPREAD) >> self.shift] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.table[(keys * _SPREAD) >> self.shift]


class Runs:
    """Where each key stands in a sorted array."""

    def __init__(self, keys: np.ndarray):
        new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
        self.first = np.append(np.flatnonzero(new), len(keys))
        self.keys = keys[new]

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each asked key stands there, and all its places in turn."""
        if not len(self.keys) or not len(asked):
            return np.zeros(len(asked), np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        n = np.where(self.keys[at] == asked, self.first[at + 1] - self.first[at], 0)
        ends = np.cumsum(n)
        return n, np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[at], n)


def normalised(text) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) if isinstance(text, str) else b""


def edit_distance(item: str, text: str) -> int:
    """The least edits that turn the item into some part of the text (bit-parallel)."""
    if item in text:
        return 0
    size = len(item)
    mask, top = (1 << size) - 1, 1 << (size - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = mask, 0, size
    best = size
    for c in text:
        eq = at.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(horizontal | up) & mask), up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up, down = minus | (~(vertical | plus) & mask), plus & vertical
    return best


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """`edit_distance` of each (item, text), many side by side: one word of 64 rows after the other."""
    out = [0] * len(pairs)
    todo = [n for n, (item, text) in enumerate(pairs) if item not in text]
    for n in todo:
        out[n] = len(pairs[n][0])
    todo = sorted((n for n in todo if pairs[n][1]), key=lambda n: (-(-len(pairs[n][0]) // 64), len(pairs[n][1])))
    one, at = np.uint64(1), 0
    while at < len(todo):
        blocks, end = -(-len(pairs[todo[at]][0]) // 64), at + 1
        while end < len(todo) and end - at < 2000 and -(-len(pairs[todo[end]][0]) // 64) == blocks:
            end += 1
        some, at = todo[at:end], end
        if len(some) < 40:
            for n in some:
                out[n] = edit_distance(*pairs[n])
            continue
        codes = np.zeros((max(len(pairs[n][1]) for n in some), len(some)), np.int64)
        masks, known, rows = [[0] * blocks], {}, 1
        for c, n in enumerate(some):
            item, text = pairs[n]
            if item not in known:
                where: dict[str, int] = {}
                for i, x in enumerate(item):
                    where[x] = where.get(x, 0) | 1 << i
                known[item] = (np.array(sorted(map(ord, where)), np.uint32), rows)
                masks += [[where[x] >> 64 * b & (1 << 64) - 1 for b in range(blocks)] for x in sorted(where)]
                rows += len(where)
            alphabet, base = known[item]
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.minimum(np.searchsorted(alphabet, code), len(alphabet) - 1)
            codes[: len(code), c] = np.where(alphabet[found] == code, base + found, 0)
        table = np.array(masks, np.uint64).T.copy()
        size = np.array([len(pairs[n][0]) for n in some])
        last = ((size - 1) % 64).astype(np.uint64)
        up = np.full((blocks, len(some)), ~np.uint64(0))
        down = np.zeros_like(up)
        score, best = size.copy(), size.copy()
        for code in codes:
            plus_in = minus_in = np.zeros(len(some), np.uint64)
            for b in range(blocks):
                u, d, eq = up[b], down[b], table[b][code]
                vertical = eq | d
                eq |= minus_in
                horizontal = (((eq & u) + u) ^ u) | eq
                plus, minus = d | ~(horizontal | u), u & horizontal
                top = last if b == blocks - 1 else np.uint64(63)
                plus_out, minus_out = plus >> top & one, minus >> top & one
                plus, minus = plus << one | plus_in, minus << one | minus_in
                up[b], down[b] = minus | ~(vertical | plus), plus & vertical
                plus_in, minus_in = plus_out, minus_out
            score += plus_in.astype(np.int64) - minus_in.astype(np.int64)
            np.minimum(best, score, out=best)
        for n, e in zip(some, best.tolist(), strict=True):
            out[n] = e
    return out


def _edges(raw: np.ndarray) -> np.ndarray:
    """Where a word may begin or end: at gaps, and around each character of scripts that may go without."""
    gap = (raw == 32) | (raw == 0)
    edge = gap.copy()
    edge[1:] |= gap[:-1]
    edge[0] = True
    for low, high, size in ((0xC2, 0xC2, 2), (0xE0, 0xEF, 3), (0xF0, 0xFF, 4)):
        wide = (raw >= low) & (raw <= high)
        edge |= wide
        edge[size:] |= wide[:-size]
    return edge


class Short:
    """Items of up to 15 bytes, which are found where they stand exactly, as whole words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.of: dict[bytes, list[int]] = {}
        for i, t in enumerate(texts):
            self.of.setdefault(t, []).append(i)
        self.keys = {n: np.sort(self.read(np.frombuffer(b"".join(t + b"\0" * 16 for t in self.of if len(t) == n) + b"\0" * 16, np.uint8), n)[:: n + 16]) for n in {len(t) for t in self.of}}

    @staticmethod
    def read(raw: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n bytes from each byte but the last 16."""
        low = np.ndarray((len(raw) - 16,), "<u8", raw, 0, (1,)) & np.uint64((1 << 8 * min(n, 8)) - 1)
        high = np.ndarray((len(raw) - 16,), "<u8", raw, 8, (1,)) & np.uint64((1 << 8 * max(n - 8, 0)) - 1)
        return (low * _SPREAD) ^ (high * _MULT)

    def meet(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item number, first byte) of all that stand in the text, which ends in 16 zeros."""
        edge = _edges(raw)
        for n, keys in self.keys.items():
            gram = self.read(raw, n)
            place = np.flatnonzero(edge[: len(gram)] & edge[n : len(gram) + n])
            at = np.minimum(np.searchsorted(keys, gram[place]), len(keys) - 1)
            for p in place[keys[at] == gram[place]].tolist():
                for i in self.of.get(raw[p : p + n].tobytes(), ()):
                    yield i, p


class Grams:
    """Where the byte grams of some items stand, read at every byte of a text.

    A copy within the tolerance keeps many grams of its item near one diagonal. For items under 40
    bytes, grams of four and the number that any such edits must leave: none is missed. Longer ones
    need grams of six or eight on a small share of their places."""

    def __init__(self, q: int, texts: list[bytes], plain: list[str], mine: np.ndarray, tolerance: float):
        self.q, self.mine = q, mine
        size = np.array([len(texts[i]) for i in mine], np.int64)
        edits = np.array([int(tolerance * len(plain[i])) for i in mine], np.int64)
        wide = np.array([max((len(c.encode("utf-8", "replace")) for c in set(plain[i])), default=1) for i in mine], np.int64)
        lemma = np.maximum(1, size - q + 1 - edits * (q - 1 + wide))
        share = np.maximum(2, (size * (0.06 if q == 8 else 0.08)).astype(np.int64))
        self.need = lemma if q == 4 else np.where(lemma > 2, np.minimum(lemma, share), share)
        self.size, self.slack = size, np.maximum(8, edits * wide)
        n = np.maximum(0, size - q + 1)
        raw = np.frombuffer(b"\0".join(texts[i] for i in mine) + b"\0" * 9, np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        self.item = np.repeat(np.arange(len(mine)), n)
        self.offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = self.read(raw)[begin[self.item] + self.offset]
        order = np.argsort(key, kind="stable")
        self.item, self.offset = self.item[order], self.offset[order]
        self.runs = Runs(key[order])
        self.seen = Seen(self.runs.keys)

    def read(self, raw: np.ndarray) -> np.ndarray:
        """The gram that starts at each byte but the last eight."""
        return np.ndarray((len(raw) - 8,), "<u8", raw, 0, (1,)) & np.uint64((1 << 8 * self.q) - 1)

    def meet(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item number, first and last byte) of each part of the text with enough grams of an item."""
        gram = self.read(raw)
        place = np.flatnonzero(self.seen(gram))
        n, which = self.runs.of(gram[place])
        item = self.item[which]
        slack = self.slack[item]
        diagonal = np.repeat(place, n) - self.offset[which] + (1 << 20)
        found = []
        for shift in (0, 1):
            key, count = np.unique(item << 32 | (diagonal + shift * slack) // (2 * slack), return_counts=True)
            of = key >> 32
            key, of = key[count >= self.need[of]], of[count >= self.need[of]]
            first = (key & 0xFFFFFFFF) * 2 * self.slack[of] - shift * self.slack[of] - (1 << 20)
            found.append((self.mine[of], first - self.slack[of], first + 3 * self.slack[of] + self.size[of]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Walk:
    """One CGK table with its sampled steps, and the hashes of the windows of some items."""

    def __init__(self, steps: int, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2, (steps, 256), dtype=np.int64)
        self.table[:, 0] = 0  # the end of a text holds the pointer
        self.samples = np.sort(rng.choice(steps, min(samples, steps), replace=False))
        self.seen: list[Seen] = []

    def hashes(self, text: np.ndarray, starts: np.ndarray, prune: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(which starts, their hashes, hashes after each sample); with `prune`, starts that no item shares are left early."""
        at, key, which = starts.copy(), np.zeros(len(starts), np.uint64), np.arange(len(starts))
        after, s = [], 0
        for j in range(int(self.samples[-1]) + 1):
            c = text[at]
            if j == self.samples[s]:
                key = (key + c + np.uint64(1)) * _MULT
                if prune and s >= 2:
                    ok = self.seen[s - 2](key)
                    at, key, which, c = at[ok], key[ok], which[ok], c[ok]
                    if not len(at):
                        break
                elif not prune:
                    after.append(key.copy())
                s += 1
            at += self.table[j][c]
        return which, key, after

    def learn(self, text: np.ndarray, starts: np.ndarray) -> None:
        _, key, after = self.hashes(text, starts, False)
        self.seen = [Seen(k) for k in after[2:]]
        self.owner = np.argsort(key, kind="stable")
        self.runs = Runs(key[self.owner])

    def meet(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start number, item window number) of all meetings."""
        which, key, _ = self.hashes(text, starts, True)
        n, at = self.runs.of(key)
        return np.repeat(which, n), self.owner[at]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each with an end mark; word starts with text number and word number."""
    raw = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8)
    gap = (raw == 32) | (raw == 0)
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
    doc = np.searchsorted(begin, start, "right") - 1
    first = np.searchsorted(start, begin)
    return raw, start, doc, np.arange(len(start)) - first[doc] if len(start) else start


class Index:
    """The windows of some items."""

    def __init__(self, items: list[tuple], *, walks: int = 5, samples: int = 12, tolerance: float = 0.2, stride: int = 3, seed: int = 17, least: int = LEAST):
        usable = [(i, normalised(t)) for i, t in items]
        kept = [(i, t) for i, t in usable if len(t) >= LEAST]
        brief = [(i, t) for i, t in usable if max(1, least) <= len(t) < LEAST]
        self.ids, self.texts, self.tolerance = [i for i, _ in kept], [t for _, t in kept], tolerance
        self.plain = [t.decode("utf-8", "replace") for t in self.texts]
        self.classes = []
        raw, start, doc, _ = _joined(self.texts)
        begin = np.cumsum([0, *(len(t) + 1 for t in self.texts)])[: len(kept)].astype(np.int64)
        length = np.array([len(t) for t in self.texts], np.int64)
        steps_of = np.where(length >= 48, LONG, np.where(length >= 24, 32, 20))
        for steps in sorted(set(steps_of.tolist())):
            room = begin[doc] + length[doc] - start
            mine = (steps_of[doc] == steps) & ((room >= steps // 2) | (start == begin[doc]))
            chosen = start[mine]
            made = []
            for w in range(walks):
                walk = Walk(steps, samples, seed + 1000 * steps + w)
                walk.learn(raw, chosen)
                made.append(walk)
            self.classes.append((stride if steps == LONG else 1, made, doc[mine], chosen - begin[doc[mine]]))
        q_of = np.where(length >= 80, 8, np.where(length >= 40, 6, 4))
        self.grams = [Grams(q, self.texts, self.plain, np.flatnonzero(q_of == q), tolerance) for q in sorted(set(q_of.tolist()))]
        self.short = Short([t for _, t in brief]) if brief else None
        self.ids = self.ids + [i for i, _ in brief]

        longest = max(map(len, self.texts), default=0)
        self.overlap = 2 * longest + 256

    def leaks(self, texts: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, edit distance) for each text and item that it holds."""
        if not self.ids:
            return
        best: dict[tuple[int, int], int] = {}
        todo: list[tuple[int, int, str]] = []

        def align():
            far = edit_distances([(self.plain[i], t) for _, i, t in todo])
            for (d, i, _), e in zip(todo, far, strict=True):
                if e <= int(self.tolerance * len(self.plain[i])):
                    best[d, i] = min(best.get((d, i), e), e)
            todo.clear()

        for parts in _pieces(texts, max(PART, 4 * self.overlap), self.overlap):
            for d, i, text in self._near(parts):
                if text is None:
                    best[d, i] = 0
                else:
                    todo.append((d, i, text))
            if len(todo) >= ALIGNED:
                align()
        align()
        for (d, i), e in sorted(best.items()):
            yield d, i, e

    def _near(self, parts: list[Part]) -> Iterator[tuple[int, int, str | None]]:
        """(text number, item number, what to align the item with), or None for the last where the item stands exactly."""
        texts = [p.text for p in parts]
        raw, start, doc, word = _joined(texts)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        where: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for stride, walks, item_of, offset in self.classes:
            mine = word % stride == 0
            at, own = start[mine], doc[mine]
            for walk in walks:
                s, w = walk.meet(raw, at)
                place = at[s] - begin[own[s]] - offset[w]
                for d, i, p in {*zip(own[s].tolist(), item_of[w].tolist(), (place // 32).tolist(), strict=True)}:
                    wide, slack = len(self.texts[i]), int(self.tolerance * len(self.texts[i])) + 4
                    where.setdefault((d, i), set()).add((max(0, p * 32 - slack), p * 32 + 32 + wide + slack))
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        for grams in self.grams:
            items, low, high = grams.meet(padded)
            first = np.maximum(0, np.searchsorted(begin, low, "right") - 1)
            last = np.searchsorted(begin, high, "left")
            for i, a, b, x, y in zip(items.tolist(), low.tolist(), high.tolist(), first.tolist(), last.tolist(), strict=True):
                for d in range(x, y):
                    own = int(begin[d])
                    c, e = max(0, a - own), min(b - own, len(texts[d]))
                    if e - c >= len(self.plain[i]) - int(self.tolerance * len(self.plain[i])):
                        where.setdefault((d, i), set()).add((c, e))
        for i, p in self.short.meet(padded) if self.short else ():
            d = int(np.searchsorted(begin, p, "right")) - 1
            at, size = p - int(begin[d]), len(self.short.texts[i])
            # Where a part was cut within a word, no word begins or ends.
            if (at or parts[d].whole_start) and (at + size < len(texts[d]) or parts[d].whole_end):
                yield parts[d].number, len(self.texts) + i, None
        for (d, i), some in where.items():
            if self.texts[i] in texts[d]:
                yield parts[d].number, i, None
                continue
            joined: list[tuple[int, int]] = []
            for a, b in sorted(some):  # overlapping places are read once
                if joined and a < joined[-1][1] and b - joined[-1][0] <= 3 * len(self.texts[i]):
                    joined[-1] = joined[-1][0], max(joined[-1][1], b)
                else:
                    joined.append((a, b))
            for a, b in joined:
                yield parts[d].number, i, texts[d][a:b].decode("utf-8", "ignore")


class Part(NamedTuple):
    """A text or a part of a long one; whether it starts and ends where a word or the text does."""

    number: int
    text: bytes
    whole_start: bool = True
    whole_end: bool = True


def _cut(number: int, text: bytes, most: int, overlap: int) -> Iterator[Part]:
    """A text in parts of at most `most` bytes; whatever is no longer than half the overlap lies in one of them."""
    at, near = 0, overlap // 4

    def border(p: int, low: int, high: int) -> tuple[int, bool]:
        gap = text.rfind(b" ", low, high)
        if gap >= 0:
            return gap, True
        while p < len(text) and text[p] & 0xC0 == 0x80:
            p += 1
        return p, False

    whole = True
    while True:
        if at + most >= len(text):
            yield Part(number, text[at:], whole, True)
            return
        end, clean = border(at + most, at + most - near, at + most)
        yield Part(number, text[at:end], whole, clean)
        start = end - overlap
        at, whole = border(start, start, start + near)


def _pieces(texts: Iterable[bytes], most: int, overlap: int) -> Iterator[list[Part]]:
    """The texts, and long ones in parts, some at a time."""
    held, size = [], 0
    for d, t in enumerate(texts):
        for part in [Part(d, t)] if len(t) <= most else _cut(d, t, most, overlap):
            if held and size + len(part.text) > most:
                yield held
                held, size = [], 0
            held.append(part)
            size += len(part.text)
    if held:
        yield held


def _indexes(benchmark: DataFrame, block_items: int, **options):
    usable = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    blocks = max(1, -(-usable.count() // block_items))
    for b in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1])), **options)


def _pairs(send, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, found = pdf["doc_id"].tolist(), []
        found += [(ids[d], send.value.ids[i], e) for d, i, e in send.value.leaks(map(normalised, pdf["text"]))]
        yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance"], dtype=object)


def _is_clean(send):
    def judge(text: pd.Series) -> pd.Series:
        hit = np.zeros(len(text), bool)
        hit[[d for d, _, _ in send.value.leaks(map(normalised, text))]] = True
        return pd.Series(~hit)

    return F.pandas_udf(judge, "boolean")


def find(docs: DataFrame, benchmark: DataFrame, *, block_items: int = 20_000, **options) -> DataFrame:
    """(doc_id, item_id, distance) of each document (doc_id, text) that holds an item (item_id, text) of the benchmark."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, distance int"
    out = None
    for index in _indexes(benchmark, block_items, **options):
        send = docs.sparkSession.sparkContext.broadcast(index)
        part = docs.select("doc_id", "text").mapInPandas(partial(_pairs, send), schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, block_items: int = 20_000, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for index in _indexes(benchmark, block_items, **options):
        docs = docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return docs
