"""Running counts over streams of paragraphs: transitions, symbol pairs, affixes.

The state of each query has a row for each counted key; with `watermark`, counts are kept by window
of event time and late rows are dropped once a window is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.symbols import pair_counts, sequence_of
from ..operators.text import word_arrays


def transition_counts(paras: DataFrame, time: str | None = None, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(pos_l, pos_r, n) of a stream of paragraphs (text), by window of `time` if it is given."""
    rows = word_arrays(paras).where(F.size("tags") > 1)
    pairs = F.expr("transform(sequence(1, size(tags) - 1), i -> struct(tags[i - 1] AS pos_l, tags[i] AS pos_r))")
    if time is None:
        return rows.select(F.explode(pairs).alias("x")).groupBy("x.pos_l", "x.pos_r").agg(F.count("*").alias("n"))
    each = rows.withWatermark(time, late).select(time, F.explode(pairs).alias("x"))
    return each.groupBy(F.window(time, window), "x.pos_l", "x.pos_r").agg(F.count("*").alias("n"))


def symbol_pair_counts(paras: DataFrame) -> DataFrame:
    """(l, r, n) of a stream of paragraphs (text)."""
    return pair_counts(paras.select(sequence_of(F.col("text")).alias("seq")))
