"""Quality by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (labelled good), one of all
text. A document's log importance weight is the mean log ratio of the two over its n-grams, times a
nominal length, so that long documents are not all-or-nothing. Adding a seeded Gumbel number to each
log weight and taking the k largest sums is a draw of k documents without replacement, with
probabilities in proportion to the weights.

N-grams are words and marks, pairs of them, and one bucket for a word that repeats itself.

Defined results: null and empty texts have no n-gram and the weight 0; equal texts draw numbers of
their own by doc_id; equal sums go to the smaller doc_id, and rows that agree in that too are taken
together; without target rows all weights are 0 and the draw is uniform; an empty table gives no
rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix, unit_hash, utf8, word_stream

BUCKETS = 16_384


def ngrams(raw: list[bytes], buckets: int = BUCKETS):
    """(text number, bucket) of every n-gram, a piece at a time; bucket 0 is a word that repeats the one before."""
    room, before = np.uint64(buckets - 1), (np.empty(0, np.uint64), np.empty(0, np.int64))
    for h, doc, *_ in word_stream(raw, marks=True):
        one = (h >> np.uint64(20)) % room + np.uint64(1)
        left, owner = np.concatenate((before[0], h)), np.concatenate((before[1], doc))
        same = owner[1:] == owner[:-1]
        pair = (mix(left[:-1] * np.uint64(3) + left[1:]) >> np.uint64(20)) % room + np.uint64(1)
        pair[left[1:] == left[:-1]] = 0
        before = left[-1:], owner[-1:]
        yield np.concatenate((doc, owner[1:][same])), np.concatenate((one, pair[same])).astype(np.int64)


def _count(ids: np.ndarray, batches):
    """Of one partition: n-grams of all texts and of the target's, by bucket."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        good = np.isin(pdf["doc_id"].fillna(-1).to_numpy(np.int64), ids) & pdf["doc_id"].notna().to_numpy()
        texts = utf8(pdf["text"])
        for doc, bucket in ngrams(texts):
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})


def model(docs: DataFrame, labels: DataFrame, *, most_target: int = 20_000, smoothing: float = 1.0, seed: int = 29) -> np.ndarray:
    """Log ratio of target to raw by bucket.

    The raw counts are those of all documents; the target's are of at most about `most_target`
    documents labelled good, chosen by a seeded hash of doc_id, whose ids are all that is sent to the readers."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = good.count()
    chosen = good.where(unit_hash(seed, F.col("doc_id")) < min(1.0, most_target / max(1, n)))
    ids = np.array(sorted(r["doc_id"] for r in chosen.collect()), np.int64)
    counted = docs.select("doc_id", "text").mapInPandas(partial(_count, ids), "bucket long, raw long, target long")
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() <= smoothing * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _weigh(ratio: np.ndarray, length: float, batches):
    for texts in batches:
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for doc, bucket in ngrams(utf8(texts)):
            first = doc[0] if len(doc) else 0  # texts come in order
            n[first:] += np.bincount(doc - first, minlength=len(texts) - first)
            total[first:] += np.bincount(doc - first, ratio[bucket], len(texts) - first)
        yield pd.Series(total / np.maximum(1, n) * length)


def kth_largest(keyed: DataFrame, k: int, *, bins: int = 2048, few: int = 5000) -> tuple[float, int] | None:
    """The k-th row of `keyed` (key, doc_id) by key downwards and doc_id upwards; None if there are not as many.

    Found by counting in ever narrower ranges; only the last, of at most `few` different rows, is gathered."""
    low, high, total = keyed.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k <= 0 or total < k:
        return None
    above = 0
    while True:
        inside = keyed.where(F.col("key").between(F.lit(low), F.lit(high)))
        if low == high:
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / (high - low) * bins))
        # A row for each range.
        counts = sorted(((r["b"], r["n"], r["low"], r["high"]) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()), reverse=True)
        for _, n, a, b in counts:
            if above + n >= k:
                low, high = a, b
                break
            above += n
        if n <= few:
            inside = keyed.where(F.col("key").between(F.lit(low), F.lit(high)))
            rows = sorted(((r["key"], r["doc_id"]) for r in inside.collect()), key=lambda r: (-r[0], r[1] is None, r[1]))
            return rows[k - above - 1]
    first, last = inside.agg(F.min("doc_id"), F.max("doc_id")).first()
    if first == last:
        return low, first
    # More than `few` rows share one key: the same by doc_id, nulls last.
    ids = inside.select((-F.coalesce(F.col("doc_id"), F.lit((1 << 53) - 1))).cast("double").alias("key"), "doc_id")
    return low, kth_largest(ids, k - above, bins=bins, few=few)[1]


def resample(docs: DataFrame, labels: DataFrame, *, keep: float | None = None, length: float = 100.0, seed: int = 29, **options) -> DataFrame:
    """(doc_id, log_weight, key, selected) of every document (doc_id, text).

    `keep` is the share of documents to draw; by default the share of good ones among the labelled."""
    if keep is None:
        good, all_ = labels.where("quality IS NOT NULL").agg(F.sum("quality"), F.count("*")).first()
        keep = good / all_ if all_ else 1.0

    ratio = model(docs, labels, seed=seed, **options)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _weigh(ratio, length, batches)

    weight = F.pandas_udf(weigh, "double")(F.col("text"))
    gumbel = -F.log(-F.log(F.greatest(unit_hash(seed + 1, F.col("doc_id")), F.lit(1e-16))))
    keyed = checkpointed(docs.select("doc_id", weight.alias("log_weight")).withColumn("key", F.col("log_weight") + gumbel))
    n = keyed.count()
    last = kth_largest(keyed.select("key", "doc_id"), round(keep * n))
    if last is None:
        return keyed.withColumn("selected", F.lit(round(keep * n) > 0))
    first = (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (F.col("doc_id") <= last[1] if last[1] is not None else F.lit(True)))
    return keyed.withColumn("selected", F.coalesce(first, F.lit(False)))
