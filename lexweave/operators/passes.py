"""Counts of neighbouring symbols under merges, as passes over whole arrays of symbols in Arrow batches.

A merge list works on a text as a sequence of its own, one merge after the other; as arrays a merge is a comparison and a count
is a histogram, a few nanoseconds a symbol. Batches are taken in stretches of `STRETCH` characters, so memory does not grow with them;
what goes on to Spark are the counts of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BREAK, CLOSE, MARK, OPEN, once
from .symbols import encoded, sequence_of, tokens_of
from .text import with_chances

#: Characters that are looked at together, counts that a task holds at most, and bins of a histogram at most.
STRETCH, HELD, BINS = 1 << 20, 200_000, 1 << 22
#: Between rows; in place of a break. Neither has neighbours.
_EDGE, _BREAK = -1, -2
_TAGS = "\x1f"


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, pa.RecordBatch]]:
    """(symbols with an edge after each row, names, characters of each row, rows) of the texts in the first column."""
    texts = batch.column(0).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STRETCH, "right")) - 1)
        data = texts.buffers()[2].slice(ends[first], ends[last] - ends[first]).to_pybytes() if ends[last] > ends[first] else b""
        starts = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        size = np.diff(starts[ends[first : last + 1] - ends[first]])
        points = np.frombuffer(data.decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
        known = np.zeros(0x110000, bool)
        known[points] = True
        alphabet = np.flatnonzero(known)
        number = np.zeros(0x110000, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        if known[ord(BREAK)]:
            number[ord(BREAK)] = _BREAK
        symbols = np.full(len(points) + len(size), _EDGE, np.int32)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(size + 1) - 1] = False
        symbols[inner] = number[points]
        yield symbols, [chr(c) for c in alphabet], size, batch.slice(first, last - first)
        first = last


def merged(symbols: np.ndarray, names: list[str], merges) -> np.ndarray:
    """The symbols under the merges in turn, each left to right and without overlap; new names are added. [F9 M4]"""
    ids = {s: i for i, s in enumerate(names)}
    for a, b in merges:
        left, right = ids.get(a, _BREAK), ids.get(b, _BREAK)
        if left < 0 or right < 0:
            continue
        at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
        if not len(at):
            continue
        if left == right:  # in a run of equal symbols the first and second merge, then the third and fourth
            starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
        if ids.setdefault(a + b, len(names)) == len(names):
            names.append(a + b)
        symbols[at] = ids[a + b]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols = symbols[kept]
    return symbols


def cut(text: Column, merges) -> Column:
    """The symbols of each text under merges in rank order, breaks dropped; null for null. A text that holds the signs
    which wrap symbols is cut as `symbols.encoded` cuts it. [M4 M5 P8]"""
    merges = [tuple(m) for m in merges]

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.string()))]
        for symbols, names, _, _ in _stretches(pa.RecordBatch.from_arrays([texts.fill_null("")], ["text"])):
            symbols = merged(symbols, names, merges)
            symbols = symbols[symbols != _BREAK]
            inner = symbols != _EDGE
            offsets = np.concatenate(([0], np.cumsum(inner)[~inner])).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(symbols[inner]))))
        return pa.concat_arrays(parts)

    wrapped = tokens_of(encoded(sequence_of(text), merges))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), wrapped).when(text.isNotNull(), tokens(text))


def sizes(text: Column, models: list) -> Column:
    """How many symbols each text has under each merge list; a list that goes on from the one before it starts where that ended."""
    models = [[tuple(m) for m in merges] for merges in models]

    @F.arrow_udf("array<long>")
    def many(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int64()))]
        for symbols, names, size, _ in _stretches(pa.RecordBatch.from_arrays([texts.fill_null("")], ["text"])):
            columns, before, made, own = [], [], symbols.copy(), list(names)
            for merges in models:
                if merges[: len(before)] != before:
                    before, made, own = [], symbols.copy(), list(names)
                made = merged(made, own, merges[len(before) :])
                before = merges
                columns.append(np.diff(np.flatnonzero(made == _EDGE), prepend=-1) - 1)
            offsets = np.arange(len(size) + 1, dtype=np.int32) * len(models)
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(np.stack(columns, 1).ravel().astype(np.int64))))
        return pa.concat_arrays(parts)

    return F.when(text.isNotNull(), many(text))


def _tally(key: np.ndarray, bins: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often, or with what weight, each occurs."""
    if bins > BINS:
        found, key = np.unique(key, return_inverse=True)
        bins = len(found)
    else:
        found = None
    many = np.bincount(key, minlength=bins) if weight is None else np.bincount(key, weights=weight, minlength=bins).astype(np.int64)
    some = np.flatnonzero(many)
    return (some if found is None else found[some]), many[some]


def _summed(stretches: Iterator[dict], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: dict = {}

    def out() -> pa.RecordBatch:
        columns = [*zip(*held, strict=True)] or [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, list(held.values())], [*types, pa.int64()], strict=True)], [*names, "n"])

    for counts in stretches:
        for k, n in counts.items():
            held[k] = held.get(k, 0) + n
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def pair_counts(rows: DataFrame, merges=(), text: str = "text", freq: str | None = None) -> DataFrame:
    """(l, r, n): `symbols.pair_counts` of rows (text) under merges; each row counts `freq` times. [A1 W2]"""
    merges = [tuple(m) for m in merges]

    def stretch(symbols: np.ndarray, names: list[str], part: pa.RecordBatch) -> dict:
        symbols = merged(symbols, names, merges)
        left, right = symbols[:-1], symbols[1:]
        pair = (left >= 0) & (right >= 0)
        weight = None
        if freq:
            row = np.cumsum(symbols == _EDGE)[:-1][pair]
            weight = part.column(1).to_numpy(zero_copy_only=False)[row].astype(np.float64)  # exact below 2**53
        size = len(names)
        keys, many = _tally(left[pair].astype(np.int64) * size + right[pair], size * size, weight)
        return {(names[k // size], names[k % size]): n for k, n in zip(keys.tolist(), many.tolist(), strict=True)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (stretch(s, names, part) for b in batches if b.num_rows for s, names, _, part in _stretches(b))
        yield from _summed(each, ["l", "r"], [pa.string(), pa.string()])

    given = rows.where(F.col(text).isNotNull()).select(text, *([freq] if freq else []))
    return given.mapInArrow(count, "l string, r string, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


END = "</s>"


def ended_pairs(rows: DataFrame, merges, by: str = "lang") -> DataFrame:
    """(by, held, l, r, n): neighbouring symbols of rows (text, by, held) with an end before and after each row. [A29]"""
    merges = [tuple(m) for m in merges]

    def stretch(symbols: np.ndarray, names: list[str], part: pa.RecordBatch) -> dict:
        symbols = merged(symbols, names, merges)
        symbols = np.concatenate(([_EDGE], symbols[symbols != _BREAK]))
        row = np.cumsum(symbols == _EDGE)[:-1] - 1
        coded = part.column(1).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + part.column(2).to_numpy(zero_copy_only=False)
        size = len(names) + 1
        of = np.where(symbols == _EDGE, len(names), symbols).astype(np.int64)
        keys, many = _tally((kind[row] * size + of[:-1]) * size + of[1:], 2 * len(kinds) * size * size)
        name_of, out = [*names, END], {}
        for x, n in zip(keys.tolist(), many.tolist(), strict=True):
            x, right = divmod(x, size)
            k, left = divmod(x, size)
            out[kinds[k // 2], bool(k % 2), name_of[left], name_of[right]] = n
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (stretch(s, names, part) for b in batches if b.num_rows for s, names, _, part in _stretches(b))
        yield from _summed(each, [by, "held", "l", "r"], [pa.string(), pa.bool_(), pa.string(), pa.string()])

    given = rows.where(F.col("text").isNotNull() & F.col("held").isNotNull()).select("text", F.coalesce(by, F.lit("\x1f")).alias(by), "held")
    found = given.mapInArrow(count, f"{by} string, held boolean, l string, r string, n long")
    return found.groupBy(F.nullif(by, F.lit("\x1f")).alias(by), "l", "r").agg(F.sum(F.when(~F.col("held"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("m"))


def vocabularies(rows: DataFrame, models: dict[int, list], by: str = "lang") -> DataFrame:
    """(by, seed, token, n): the symbols of rows (by, text) under each merge list, with their counts. [T4 K4 A15]"""
    models = {k: [tuple(m) for m in merges] for k, merges in models.items()}

    def stretch(symbols: np.ndarray, names: list[str], part: pa.RecordBatch) -> dict:
        coded = part.column(1).dictionary_encode()
        kinds, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out: dict = {}
        for k, merges in models.items():
            own = list(names)
            made = merged(symbols.copy(), own, merges)
            row = np.cumsum(made == _EDGE)
            inner, size = made >= 0, max(1, len(own))
            keys, many = _tally(kind[row[inner]] * size + made[inner], len(kinds) * size)
            out |= {(kinds[x // size], k, own[x % size]): n for x, n in zip(keys.tolist(), many.tolist(), strict=True)}
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (stretch(s, names, part) for b in batches if b.num_rows for s, names, _, part in _stretches(b))
        yield from _summed(each, [by, "seed", "token"], [pa.string(), pa.int32(), pa.string()])

    given = rows.where(F.col("text").isNotNull()).select("text", F.coalesce(by, F.lit("\x1f")).alias(by))
    found = given.mapInArrow(count, f"{by} string, seed int, token string, n long")
    return found.groupBy(F.nullif(by, F.lit("\x1f")).alias(by), "seed", "token").agg(F.sum("n").alias("n"))


def agreements(rows: DataFrame, models: dict[int, list], by: str = "lang") -> DataFrame:
    """(by, a, b, both, apart) of each pair a < b of merge lists: how many ends of symbols, in characters without markers,
    the cuts of rows (by, text) have in common and how many only one has. [A19]"""
    models = {k: [tuple(m) for m in merges] for k, merges in models.items()}

    def stretch(symbols: np.ndarray, names: list[str], part: pa.RecordBatch) -> dict:
        coded = part.column(1).dictionary_encode()
        kinds, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ends = {}
        for k, merges in models.items():
            own = list(names)
            made = merged(symbols.copy(), own, merges)
            made = made[made != _BREAK]
            inner = made != _EDGE
            size = np.array([len(s) - s.count(MARK) for s in own] + [0], np.int64)[made]
            row, place = np.cumsum(~inner) - ~inner, np.cumsum(size)
            place -= np.concatenate(([0], place[~inner][:-1]))[row]
            ends[k] = np.unique((row << 32 | place)[inner & (place > 0)])
        out: dict = {}
        for a in models:
            for b in models:
                if a < b:
                    common = np.intersect1d(ends[a], ends[b], assume_unique=True)
                    count = lambda x: np.bincount(kind[x >> 32], minlength=len(kinds))
                    both, every = count(common), count(ends[a]) + count(ends[b])
                    for i, name in enumerate(kinds):
                        out[name, a, b, True], out[name, a, b, False] = int(both[i]), int(every[i] - 2 * both[i])
        return out

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (stretch(s, names, part) for b in batches if b.num_rows for s, names, _, part in _stretches(b))
        yield from _summed(each, [by, "a", "b", "common"], [pa.string(), pa.int32(), pa.int32(), pa.bool_()])

    given = rows.where(F.col("text").isNotNull()).select("text", F.coalesce(by, F.lit("\x1f")).alias(by))
    found = given.mapInArrow(count_all, f"{by} string, a int, b int, common boolean, n long")
    return found.groupBy(F.nullif(by, F.lit("\x1f")).alias(by), "a", "b").agg(F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)).alias("both"), F.sum(F.when(~F.col("common"), F.col("n")).otherwise(0)).alias("apart"))


def tagged_texts(rows: DataFrame) -> DataFrame:
    """(text, tags): rows (text, tags) with the tags as one string, the form in which `classed_pairs` takes them and in which they are small to keep."""
    return rows.where("text IS NOT NULL").select("text", F.array_join("tags", _TAGS).alias("tags"))


def transitions(rows: DataFrame) -> DataFrame:
    """`text.transitions` of `tagged_texts`. [W1 A2]"""
    return with_chances(_counted(rows.select(F.lit("").alias("text"), "tags"), ()).select("pos_l", "pos_r", "n"))


def classed_pairs(rows: DataFrame, merges=()) -> DataFrame:
    """(l, r, rule, pos_l, pos_r, n): `symbols.classed_pairs` of `tagged_texts` under merges. [DM6 W4 W5 J2]"""
    return _counted(rows, merges).where("rule > 0")


def classes_and_transitions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`classed_pairs` and `transitions` from one pass: the test of the rule stays above the counts, which both then share."""
    counts = once(_counted(rows, ()), kind=F.col("rule"))
    return counts.where("kind > 0").drop("kind"), with_chances(counts.where("kind = 0").select("pos_l", "pos_r", "n"))


def _counted(rows: DataFrame, merges) -> DataFrame:
    """Classed pairs, and under rule 0 the pairs of neighbouring tags."""
    merges = [tuple(m) for m in merges]

    def stretch(symbols: np.ndarray, names: list[str], part: pa.RecordBatch) -> dict:
        symbols = merged(symbols, names, merges)
        listed = pc.split_pattern(part.column(1), _TAGS)
        words = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        tags = [None, *coded.dictionary.to_pylist()]
        tag = np.append(coded.indices.to_numpy(zero_copy_only=False) + 1, 0)
        marks = np.array([s.count(MARK) for s in names] + [0, 0], np.int64)  # the last two: breaks and edges
        begins = np.array([s.startswith(MARK) for s in names] + [False, False])
        bare = names.index(MARK) if MARK in names else len(names)
        row = np.cumsum(symbols == _EDGE)[:-1]
        before = np.cumsum(marks[symbols])
        starts = np.concatenate(([0], before[symbols == _EDGE][:-1]))  # markers before each row
        left, right = symbols[:-1], symbols[1:]
        pair = np.flatnonzero((left != _EDGE) & (right != _EDGE))
        left, right, row, after = left[pair], right[pair], row[pair], before[:-1][pair]
        k = after - starts[row]  # the word in which the left symbol ends
        first = np.concatenate(([0], np.cumsum(words)))[:-1]

        def tag_at(which: np.ndarray, at: np.ndarray) -> np.ndarray:
            inside = (at >= 0) & (at < words[row[which]])
            return np.where(inside, tag[np.where(inside, first[row[which]] + at, -1)], 0)

        rule = np.full(len(pair), 4, np.int8)
        rule[~begins[left] & ~begins[right] & (marks[left] == 0)] = 3
        rule[right == bare] = 2
        rule[left == bare] = 1
        names_of = [*names, BREAK, None]
        size, kinds, out = len(names) + 2, len(tags), {}
        left, right = left.astype(np.int64) % size, right.astype(np.int64) % size
        row_of = np.repeat(np.arange(len(words)), words)
        beside = np.flatnonzero(row_of[:-1] == row_of[1:])
        keys, many = _tally(tag[beside].astype(np.int64) * kinds + tag[beside + 1], kinds * kinds)
        for x, n in zip(keys.tolist(), many.tolist(), strict=True):
            out["", "", 0, tags[x // kinds], tags[x % kinds]] = n
        for r in (1, 2, 3, 4):
            which = np.flatnonzero(rule == r)
            own, next_ = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
            if r in (2, 3):
                plain = np.flatnonzero(~begins[left[which]])
                own[plain] = tag_at(which[plain], k[which[plain]] - marks[left[which[plain]]])
                if r == 2:
                    next_[plain] = tag_at(which[plain], k[which[plain]] + 1)
            # A key has only what its rule leaves open: the right symbol of rule 2 is the marker, and rules 1 and 4 have no tags.
            wide, deep = (1 if r == 2 else size), (1, kinds * kinds, kinds, 1)[r - 1]
            key = (left[which] * wide + (0 if r == 2 else right[which])) * deep + (own * kinds + next_ if r == 2 else own)
            keys, many = _tally(key, size * wide * deep)
            for x, n in zip(keys.tolist(), many.tolist(), strict=True):
                x, t = divmod(x, deep)
                a, b = divmod(t, kinds) if r == 2 else (t, 0)
                out[names_of[x // wide], MARK if r == 2 else names_of[x % wide], r, tags[a], tags[b]] = n
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (stretch(s, names, part) for b in batches if b.num_rows for s, names, _, part in _stretches(b))
        yield from _summed(each, ["l", "r", "rule", "pos_l", "pos_r"], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()])

    found = rows.select("text", "tags").mapInArrow(count, "l string, r string, rule int, pos_l string, pos_r string, n long")
    return found.groupBy("l", "r", "rule", "pos_l", "pos_r").agg(F.sum("n").alias("n"))
