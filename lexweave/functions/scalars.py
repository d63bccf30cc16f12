"""Scalar column functions: words, stems, cuts, cells. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
OPEN, CLOSE, BREAK = "⟨", "⟩", "␀"
#: White space as Python's str.split sees it; Java's \s is narrower.
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with more columns, each found once a row: they pass through a generator of one row, below which
    filters on them cannot move. As plain columns, costly ones would be repeated in every filter over them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def is_word(s: Column) -> Column:
    """Letters and combining marks only, at least one."""
    return s.rlike(r"^[\p{L}\p{Mn}\p{Mc}]+$")


def stripped(token: Column) -> Column:
    return F.replace(token, F.lit(MARK), F.lit(""))


def clamp(p: Column, low: float = 0.01, high: float = 0.95) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def common_stem(word: str, lemma: str, least: int = 3) -> str:
    """SQL for the span (first, end) of the lemma in the word, else of their longest common part of at
    least `least` characters (leftmost on ties), else null. Both arguments are SQL of lower-cased strings."""
    parts = (
        f"flatten(transform(sequence(1, greatest(1, length({word}))), i -> transform(filter(sequence({least}, greatest({least}, length({word}))), "
        f"n -> i + n - 1 <= length({word}) AND instr({lemma}, substr({word}, i, n)) > 0), n -> struct(n AS size, -i AS back))))"
    )
    # Bound by a lambda, so that the search stands in the expression once.
    # Without a part of the least length in common there is none that is longer, and only one length is tried.
    shared = f"exists(sequence(1, length({word}) - {least} + 1), i -> instr({lemma}, substr({word}, i, {least})) > 0)"
    longest = f"transform(array(array_max({parts})), b -> CASE WHEN b IS NOT NULL THEN struct(-b.back - 1 AS first, -b.back - 1 + b.size AS end) END)[0]"
    return f"CASE WHEN instr({word}, {lemma}) > 0 THEN struct(instr({word}, {lemma}) - 1 AS first, instr({word}, {lemma}) - 1 + length({lemma}) AS end) WHEN length({word}) < {least} OR NOT {shared} THEN NULL ELSE {longest} END"


def stem_cuts(span: str, word: str) -> str:
    """SQL for the inner boundaries of a stem span; null without a span."""
    return f"CASE WHEN {span} IS NOT NULL THEN filter(array({span}.first, {span}.end), c -> c > 0 AND c < length({word})) END"


def pieces(word: Column, cuts: Column) -> Column:
    """The word cut at the given places."""
    inner = F.array_sort(F.filter(cuts, lambda c: (c > 0) & (c < F.length(word))))
    at = F.concat(F.array(F.lit(0)), inner, F.array(F.length(word)))
    return F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.substr(word, F.element_at(at, i) + 1, F.element_at(at, i + 1) - F.element_at(at, i)))


def cuts_of(tokens: Column) -> Column:
    """Ends of the tokens in characters without markers, without 0, each once."""
    ends = F.aggregate(
        tokens,
        F.array().cast("array<int>"),
        lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(stripped(t)))),
    )
    return F.array_distinct(F.filter(ends, lambda c: c > 0))


def prompt(words: Column, language: Column) -> Column:
    """A request to cut words into morphemes with plus signs."""
    return F.concat(F.format_string("Segment these %s words into morphemes with +, one per line as word: seg+ment\n", language), F.array_join(words, "\n"))


def tex_escaped(text: Column) -> Column:
    out = text
    for a, b in (("\\", r"\textbackslash "), ("_", r"\_"), ("%", r"\%"), ("&", r"\&"), ("#", r"\#"), (MARK, r"\textvisiblespace{}")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cell(mean: Column, sd: Column, scale: float = 1.0, digits: int = 1) -> Column:
    """A table cell: mean and spread."""
    return F.format_string(f"%.{digits}f$\\pm$%.{digits}f", mean * scale, sd * scale)


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def learning_rate(step: Column, total: int, warm: int = 100, peak: float = 3e-4) -> Column:
    """Warm-up times cosine; after `total` steps it stays where it is. [F14]"""
    at = F.least(step, F.lit(total))
    return F.lit(peak) * F.least(F.lit(1.0), (at + 1) / F.lit(float(warm))) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * at / float(max(1, total))))
