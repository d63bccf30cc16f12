"""Symbol sequences: one string a paragraph, each symbol wrapped in ⟨ and ⟩, so that a merge is a replacement.

Scores are counted in whole numbers by class of neighbour and multiplied by weights in billionths
afterwards, so they do not depend on the order of summation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BREAK, CLOSE, MARK, OPEN

UNIT = 1_000_000_000


def escaped_absent(text: Column) -> Column:
    """Whether none of the characters that the representation needs for itself occurs."""
    return ~text.rlike(f"[{OPEN}{CLOSE}{MARK}{BREAK}]")


def sequence_of(text: Column) -> Column:
    """Every character as a symbol, the marker between words. [P6 DM5]"""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit(MARK)), "(?s)(.)", f"{OPEN}$1{CLOSE}")


def with_breaks(pieces: Column) -> Column:
    """The pieces of a word as symbols, with an unmergeable break between pieces. [P7]"""
    return F.array_join(F.transform(pieces, sequence_of), f"{OPEN}{BREAK}{CLOSE}")


def tokens_of(seq: Column) -> Column:
    """The symbols of a sequence, breaks dropped. [P8]"""
    inner = F.substr(seq, F.lit(2), F.greatest(F.lit(0), F.length(seq) - 2))
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.array_remove(F.split(inner, CLOSE + OPEN), BREAK))


def merged(seq: Column, left: str, right: str) -> Column:
    """One merge, left to right and without overlap. [F9]"""
    return F.replace(seq, F.lit(f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}"), F.lit(f"{OPEN}{left}{right}{CLOSE}"))


def encoded(seq: Column, merges: list[tuple[str, str]]) -> Column:
    """All merges in rank order: the same as merging the pair of lowest rank until none is left. [M4 M5 J9]

    The list is folded inside one expression, so the plan does not grow with the number of merges."""
    if not merges:
        return seq
    rules = F.array(*[F.struct(F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}").alias("f"), F.lit(f"{OPEN}{a}{b}{CLOSE}").alias("t")) for a, b in merges])
    return F.aggregate(rules, seq, lambda acc, m: F.replace(acc, m["f"], m["t"]))


def pair_counts(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(l, r, n) over neighbouring symbols of each row, overlaps included. [A1 W2]"""
    t = rows.select(tokens_of(F.col(seq)).alias("t")).where(F.size("t") > 1)
    pairs = t.select(F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] AS l, t[i] AS r))")).alias("x"))
    return pairs.where((F.col("x.l") != BREAK) & (F.col("x.r") != BREAK)).groupBy("x.l", "x.r").agg(F.count("*").alias("n"))


def classed_pairs(rows: DataFrame) -> DataFrame:
    """(l, r, rule, pos_l, pos_r, n): neighbouring symbols by the rule that weighs them, for rows (seq, tags). [DM6 W4 W5 J2]

    rule 1: the left symbol is a bare marker; 2: the right one is, between words tagged pos_l and pos_r
    (pos_l null where the left token begins with an absorbed marker); 3: both lie in one word, tagged pos_l; 4: else.
    A token belongs to the word of its first character; words are counted by the markers before, bare or absorbed."""
    # The text between two markers lies in one word, so each border between symbols is given the number
    # of the part it lies in before the symbols are parted; the work is linear in the paragraph.
    borders = f"transform(split(substr(seq, 2), '{MARK}'), (part, k) -> replace(part, '{CLOSE}{OPEN}', concat('{CLOSE}', k, '␟{OPEN}')))"
    rows = rows.select("tags", F.expr(f"split(array_join({borders}, '{MARK}'), '␟{OPEN}')").alias("u")).where(F.size("u") > 1)
    pair = f"transform(sequence(1, size(u) - 1), i -> struct(substring_index(u[i - 1], '{CLOSE}', 1) AS l, substring_index(u[i], '{CLOSE}', 1) AS r, cast(substring_index(u[i - 1], '{CLOSE}', -1) AS int) AS k))"
    rows = rows.select("tags", F.explode(F.expr(pair)).alias("x")).select("tags", "x.*").withColumn("ml", F.expr(f"length(l) - length(replace(l, '{MARK}', ''))"))
    starts = lambda c: F.col(c).startswith(MARK)
    rule = F.when(F.col("l") == MARK, 1).when(F.col("r") == MARK, 2).when(~starts("l") & ~starts("r") & (F.col("ml") == 0), 3).otherwise(4)
    rows = rows.withColumn("rule", rule)
    pos_l = F.when(F.col("rule").isin(2, 3) & ~starts("l"), F.get("tags", F.col("k") - F.col("ml")))
    pos_r = F.when((F.col("rule") == 2) & ~starts("l"), F.get("tags", F.col("k") + 1))
    return rows.groupBy("l", "r", "rule", pos_l.alias("pos_l"), pos_r.alias("pos_r")).agg(F.count("*").alias("n"))


def weighted(classes: DataFrame, table: DataFrame, *, beta: int = 0, factor: int = 1000, content: tuple[str, ...] = (), unseen: int = 10_000) -> DataFrame:
    """(l, r, score) in billionths, from classed pairs and a transition table (pos_l, pos_r, p). [A5 J3 F7]

    beta is 0 or 1; factor, the weight of pairs with a bare marker, is in thousandths; words tagged
    with `content` weigh double; `unseen` is the probability of a transition that does not occur, in millionths. The table has a row for each pair of tags at most."""
    adj = F.least(F.greatest(F.floor(F.col("p") * 1e6 + 0.5).cast("long"), F.lit(10_000)), F.lit(950_000))
    tags = F.broadcast(table.select("pos_l", "pos_r", adj.alias("adj")))
    rows = classes.join(tags, ["pos_l", "pos_r"], "left")
    boundary = F.when(F.col("pos_l").isNotNull() & F.col("pos_r").isNotNull(), 1_000_000 + beta * F.coalesce("adj", F.lit(unseen))).otherwise(F.lit(1_000_000))
    inside = F.when(F.col("pos_l").isin(*content), F.lit(2 * UNIT)).otherwise(F.lit(UNIT)) if content else F.lit(UNIT)
    weight = F.when(F.col("rule") == 1, F.lit(factor * 1_000_000)).when(F.col("rule") == 2, boundary * factor).when(F.col("rule") == 3, inside).otherwise(F.lit(UNIT))
    return rows.groupBy("l", "r").agg(F.sum(F.col("n") * weight.cast("long")).alias("score"))


def legacy_scores(classes: DataFrame, table: DataFrame, part: str = "both") -> DataFrame:
    """(l, r, score) in billionths by the older rule: every pair with a bare marker is a boundary pair and
    weighs (1 + adj) * 0.98, adj being 0.6 where there is no transition. Of the two factors `part` takes
    "both", only "transitions" or only "penalties". [A6 J5 F8]"""
    adj = F.least(F.greatest(F.floor(F.col("p") * 1e6 + 0.5).cast("long"), F.lit(10_000)), F.lit(950_000))
    rows = classes.join(F.broadcast(table.select("pos_l", "pos_r", adj.alias("adj"))), ["pos_l", "pos_r"], "left")
    gain = F.lit(1_000_000) if part == "penalties" else 1_000_000 + F.coalesce("adj", F.lit(600_000))
    weight = F.when(F.col("rule").isin(1, 2), gain * (1000 if part == "transitions" else 980)).otherwise(F.lit(UNIT))
    return rows.groupBy("l", "r").agg(F.sum(F.col("n") * weight.cast("long")).alias("score"))


def best_pair(scores: DataFrame, score: str = "score"):
    """The pair of the highest score, ties to the smaller pair. [K1]"""
    return scores.orderBy(F.col(score).desc(), "l", "r").limit(1).first()


def word_types(paras: DataFrame) -> DataFrame:
    """(word, freq): distinct words; 10 to 50 times fewer rows than words. [T-word]"""
    return paras.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def kept_types(types: DataFrame) -> DataFrame:
    """`word_types` cached for rounds of passes, in two tasks a core: they are few rows for the tasks of a shuffle, each of which costs a round its start."""
    return types.coalesce(2 * types.sparkSession.sparkContext.defaultParallelism).cache()


__all__ = ["UNIT", "best_pair", "classed_pairs", "encoded", "escaped_absent", "kept_types", "legacy_scores", "merged", "pair_counts", "sequence_of", "tokens_of", "weighted", "with_breaks", "word_types"]
