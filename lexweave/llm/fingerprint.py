"""Homomorphic multiset hash of documents.

A text is the multiset of its paragraphs: its lines, which are cut again after sentence ends so that
an edit stays within a few of them. Each paragraph is hashed to a wide vector of integers, and a
fingerprint is the sum of these vectors, component by component, modulo 2**64, 2**32 and 2**16. So
the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector.

Components: `DENSE` full 64-bit ones, which decide equality; the number of paragraphs; and `LEVELS`
times `LANES` sparse 16-bit ones. A paragraph is non-zero in one lane of level 0, and with
probability 2**-j also in one lane of level j. The share of equal lanes tells how many paragraphs
differ, few at level 0 and many at the last level, up to some 2**28 of them; `likeness` takes the likeliest number and turns it
into a Jaccard similarity of the two multisets.

Defined results: null is the empty text, whose fingerprint is all zeros; equal fingerprints have
likeness 1; texts that differ only in the order of paragraphs have equal fingerprints; the document
after the last (by doc_id, nulls last, equal ids by text hash) is the first; a single document is its own
next; an empty table gives no rows; other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE, LEVELS, LANES = 8, 24, 16
#: Numbers of differing paragraphs, and for each and every level the log chances that a lane is equal or not.
_DIFFER = np.unique(np.round(np.geomspace(1, 1 << 33, 240)))
_CHANCE = np.exp(-_DIFFER[:, None] / (LANES * 2.0 ** np.arange(LEVELS)))
_SAME, _OTHER = np.log(np.maximum(_CHANCE, 1e-300)), np.log(np.maximum(1 - _CHANCE, 1e-300))
_CUT = re.compile(r"(?<=\n)|(?<=[.!?])(?= )")
_LAST = (1 << 63) - 1  # the place of a missing doc_id


def paragraphs(text: str) -> list[str]:
    """Pieces that make up the text; they keep their line ends."""
    return [p for p in _CUT.split(text) if p]


class Hash:
    """A running fingerprint: dense sums, paragraph count, and lanes."""

    __slots__ = ("count", "dense", "lanes")

    def __init__(self):
        self.dense, self.count, self.lanes = np.zeros(DENSE, np.uint64), 0, np.zeros(LEVELS * LANES, np.uint16)

    def copy(self) -> Hash:
        twin = Hash()
        twin.dense, twin.count, twin.lanes = self.dense.copy(), self.count, self.lanes.copy()
        return twin

    def add(self, pieces: list[str], sign: int = 1) -> Hash:
        """Insert the paragraphs, or delete them with sign -1."""
        if not pieces:
            return self
        raw = np.frombuffer(b"".join(hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=64).digest() for p in pieces), np.uint64).reshape(-1, 8)
        total = raw.sum(axis=0, dtype=np.uint64)
        self.dense = self.dense + total if sign > 0 else self.dense - total
        self.count = (self.count + sign * len(pieces)) % (1 << 32)
        spread, value = raw[:, 0], (raw[:, 1] & np.uint64(0xFFFF)) | np.uint64(1)
        depth = raw[:, 2]
        change = np.zeros(LEVELS * LANES)
        for level in range(LEVELS):
            inside = (depth & np.uint64((1 << level) - 1)) == 0
            if not inside.any():
                break
            # Four bits a level, 16 levels a word.
            word = spread if level < 16 else raw[:, 3]
            lane = ((word[inside] >> np.uint64(4 * (level % 16))) & np.uint64(LANES - 1)).astype(np.int64)
            change[level * LANES : (level + 1) * LANES] = np.bincount(lane, value[inside].astype(float), LANES)
        self.lanes = (self.lanes.astype(np.int64) + sign * change.astype(np.int64)).astype(np.uint16)
        return self

    def text(self) -> str:
        """Lowercase hex: dense components, count, lanes."""
        return (self.dense.astype(">u8").tobytes() + self.count.to_bytes(4, "big") + self.lanes.astype(">u2").tobytes()).hex()


def of(text: str) -> Hash:
    return Hash().add(paragraphs(text))


def edited_hash(own: Hash, before: list[str], after: list[str]) -> Hash:
    """The fingerprint after an edit: only paragraphs that changed are deleted and inserted."""
    same = 0
    for a, b in zip(before, after):  # noqa: B905
        if a != b:
            break
        same += 1
    return own.copy().add(before[same:], -1).add(after[same:])


def likeness(a: Hash, b: Hash) -> float:
    """Estimated Jaccard similarity of the paragraphs, 0 to 1, from the fingerprints alone."""
    if a.count == b.count and (a.dense == b.dense).all():
        return 1.0
    most = a.count + b.count
    if not a.count or not b.count:
        return 0.0
    equal = (a.lanes == b.lanes).reshape(LEVELS, LANES).sum(axis=1)
    possible = _DIFFER <= max(most, 1)
    differ = float(_DIFFER[possible][(_SAME @ equal + _OTHER @ (LANES - equal))[possible].argmax()])
    differ = min(float(most), max(1.0, differ))
    return float((most - differ) / (most + differ))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of `docs` (doc_id, text), of each edited text, and how alike they are.

    Texts are shuffled once, into buckets of neighbouring ids, whose bounds are quantiles of the
    ids; the first document of each bucket also goes to the bucket before it."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = buckets or 6 * parts
    keys = docs.select(key.alias("key"))
    bounds = keys.approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    splits = np.array(sorted({int(b) for b in bounds if b < 2.0**63}), np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splits, k.to_numpy(np.int64), side="left").astype(np.int32))

    heads = {r["b"]: r["k"] for r in keys.groupBy(bucket("key").alias("b")).agg(F.min("key").alias("k")).collect()}  # a row a bucket
    used = sorted(heads)
    before = {heads[b]: used[i - 1] for i, b in enumerate(used)}
    firsts = np.array(sorted(before), np.int64)
    back = np.array([before[k] for k in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        k = k.to_numpy(np.int64)
        own = np.searchsorted(splits, k, side="left")
        at = np.minimum(np.searchsorted(firsts, k), max(0, len(firsts) - 1))
        return pd.Series([[int(o), int(back[a])] if len(firsts) and firsts[a] == x else [int(o)] for o, a, x in zip(own, at, k, strict=True)])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"), places(key).alias("places"))
    rows = rows.select("doc_id", "text", "key", F.posexplode("places").alias("ahead", "bucket"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "key", F.xxhash64("text"))

    def stream(batches):
        pending = None  # (bucket, doc_id, text, paragraphs, hash)
        for pdf in batches:
            out = []
            for doc_id, text, ahead, b in zip(pdf["doc_id"], pdf["text"], pdf["ahead"], pdf["bucket"], strict=True):
                if ahead and (pending is None or pending[0] != b):
                    continue
                pieces = paragraphs(text)
                own = Hash().add(pieces)
                if pending is not None and pending[0] == b:
                    _, before_id, before_text, before_pieces, before_hash = pending
                    new = edited(before_text, text)
                    changed = edited_hash(before_hash, before_pieces, paragraphs(new))
                    out.append((before_id, len(before_text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), before_hash.text(), changed.text(), likeness(before_hash, changed), likeness(before_hash, own)))
                pending = None if ahead else (b, doc_id, text, pieces, own)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return dealt.select("doc_id", "text", "ahead", "bucket").mapInPandas(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
