"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Every source asks for its share by weight of the words to take. Sources that would repeat more often
than `most_epochs` are clamped there, and what they leave is shared again by weight among the others
until none is above. The end of these rounds is a water level: target = least of cap and
level * weight. It is computed at once, from running sums over the sources in the order in which
they would be clamped.

A source whose target is e times its size gives every document floor(e) times. The rest of its target
is filled in a seeded order of its documents; where it ends, within a document, that document gives
the words that are still missing. So a source meets its (whole) target to the word.

Defined results: null text has size 0; null sources form one source that sorts last; empty tables
give no rows; a source without words has target 0 and its documents take 0 words; repeated rows are
documents of their own, told apart by an arbitrary but harmless order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """`sources` (source, source_size) with target. One row a source; weights repeat in code-point order, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", most_epochs * F.col("source_size"))
    everything = Window.partitionBy()
    # Sources run full in the order of cap / weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("budget", share * F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    # The first source that the level does not fill sets the water level; those before it are capped.
    place = F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), F.col("level").alias("level"))
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), place)
    s = s.withColumn("water", F.min(fits).over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))  # null is a source


def _order(seed: int, size: str = "size") -> Column:
    """A seeded place: the first 60 bits of an MD5 digest, which SQL engines share, as the high bits of an unsigned number."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col(size)))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 4)


def ends(sized: DataFrame, **shares) -> DataFrame:
    """For `sized` (doc_id, source, size, h) one row a source: how often its documents are whole, and where its target ends.

    No source is gathered anywhere: sizes are summed by source and hash range first, and only the
    range in which a target ends is looked into, twice over."""
    rank1 = F.shiftrightunsigned(F.col("h"), 64 - BITS)
    rank2 = F.shiftrightunsigned(F.shiftleft(F.col("h"), BITS), 64 - BITS)
    rows = sized.select("doc_id", "source", "size", "h", _key(F.col("source")).alias("k"), rank1.alias("b1"), rank2.alias("b2"))

    ranges = checkpointed(rows.groupBy("k", "source", "b1").agg(F.sum("size").alias("words")))
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("target") + 1e-6).cast("long") - F.col("whole") * F.col("source_size"))
    plan = checkpointed(plan.select(_key(F.col("source")).alias("k"), "source_size", "target", "whole", "rest"))

    def ending(parts: DataFrame, base: Column, *order: str) -> DataFrame:
        """Of the parts of each source, in their order, the one in which its rest ends."""
        running = F.sum("words").over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", base + F.coalesce(running, F.lit(0)))
        return parts.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))

    one = ending(ranges.select("k", "b1", "words").join(plan.select("k", "rest"), "k"), F.lit(0), "b1").select("k", "b1", "rest", F.col("before").alias("base"))
    two = rows.join(one, ["k", "b1"]).groupBy("k", "b1", "rest", "base", "b2").agg(F.sum("size").alias("words"))
    two = ending(two, F.col("base"), "b2").select("k", "b1", "b2", "rest", F.col("before").alias("base"))
    # Rows alike in all of this share what is left.
    last = rows.join(two, ["k", "b1", "b2"]).groupBy("k", "h", "doc_id", "size", "rest", "base").agg(F.count("*").alias("same"))
    last = ending(last.withColumn("words", F.col("size") * F.col("same")), F.col("base"), "h", "doc_id", "size")
    last = last.select("k", F.col("h").alias("end_h"), F.col("doc_id").alias("end_id"), F.floor((F.col("rest") - F.col("before")) / F.col("same")).cast("long").alias("end_part"))
    return checkpointed(plan.drop("rest").join(last, "k", "left"))


def taken(rows: DataFrame, end: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """`rows` (doc_id, source, size, h, ...) with source_size, target and taken. Sends the sources to all only while they are few."""
    few = end.limit(most_broadcast + 1).count() <= most_broadcast
    end = end.drop("source")
    rows = rows.withColumn("k", _key(F.col("source"))).join(F.broadcast(end) if few else end, "k")
    # Hashes are ordered as unsigned numbers, like the ranges.
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    is_end = (F.col("h") == F.col("end_h")) & F.col("doc_id").eqNullSafe(F.col("end_id"))
    first = (unsigned("h") < unsigned("end_h")) | ((F.col("h") == F.col("end_h")) & (F.col("doc_id") < F.col("end_id")))
    part = F.when(F.coalesce(is_end, F.lit(False)), F.col("end_part")).when(F.coalesce(first, F.lit(False)), F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long")).drop("k", "end_h", "end_id", "end_part")


def mix(docs: DataFrame, *, seed: int = 5, **shares) -> DataFrame:
    """`docs` (doc_id, source, text) as (doc_id, source, size, source_size, target, taken)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = checkpointed(sized.withColumn("h", _order(seed)))
    return taken(sized, ends(sized, **shares)).select("doc_id", "source", "size", "source_size", "target", "taken")


def materialised(docs: DataFrame, *, seed: int = 5, **shares) -> DataFrame:
    """The mix as rows with the columns of `docs`: whole repetitions, and a shortened one where a target ends.

    Documents without words stay, as often as their source's documents are whole and at least once.
    Texts are not shuffled: only their sizes are."""
    size = word_count(F.col("text"))
    thin = checkpointed(docs.select("doc_id", "source", size.alias("size")).withColumn("h", _order(seed)))
    # The input's own columns travel in one struct, so their names cannot clash.
    rows = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"), size.alias("size"))
    rows = taken(rows.withColumn("h", _order(seed)), ends(thin, **shares))
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.greatest(F.lit(1), F.col("whole"))).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") - F.col("size") * F.col("full")).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("full", full).withColumn("rest", rest)
    times = F.col("full") + (F.col("rest") > 0).cast("int")
    rows = rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    short = F.col("copy") > F.col("full")
    begin = F.call_function("regexp_extract", F.col("row.text"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("rest"), F.lit("}+")), F.lit(0))
    text = F.when(short, begin).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(short, F.length(text).cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])
