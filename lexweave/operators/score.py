"""Scores of segmentations: gold boundaries, precision and recall, compression, and what tokens span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MARK, cuts_of, is_word, once, stripped
from .text import occurrences

# ------------------------------------------------------------------ fixed affixes of the made gold rows
PREFIXES = ("un", "re", "in", "de", "ver", "be")
FOLLOWING = ("mente", "keit", "tion", "ment", "ing", "ung", "ers", "eux", "ed", "er", "ly", "en", "es", "os")


def gold_source(tagged: DataFrame) -> DataFrame:
    """Rows with the columns of a gold file, made from the distinct words by fixed affixes: wordform,
    preceding_part, stem, following_part, lemma, pos, data_split, word_freq, unique. `tagged` has words, or their kinds with n.

    Parts are found once a word, after the count; else the filters of `gold_items` repeat them for every word of the text."""
    words = tagged.groupBy("surface").agg(occurrences(tagged).alias("word_freq"), F.min("upos").alias("pos"), F.min("lemma").alias("lemma"))
    words = once(words, word=is_word(F.col("surface"))).where("word").drop("word")
    # The first listed affix that leaves a stem, by a search in a literal array: small, wherever Spark repeats it.
    listed = lambda ends: "array(" + ", ".join(repr(e) for e in ends) + ")"
    after = f"coalesce(right(surface, length(get(filter({listed(FOLLOWING)}, e -> length(surface) >= length(e) + 3 AND endswith(lower(surface), e)), 0))), '')"
    rows = once(words, following_part=F.expr(after)).withColumn("rest", F.expr("left(surface, length(surface) - length(following_part))"))
    before = f"coalesce(left(rest, length(get(filter({listed(PREFIXES)}, e -> length(rest) >= length(e) + 3 AND startswith(lower(rest), e)), 0))), '')"
    rows = once(rows, preceding_part=F.expr(before)).withColumn("stem", F.expr("substr(rest, length(preceding_part) + 1)"))
    test = F.substring(F.md5(F.col("surface").cast("binary")), 1, 1).isin("0", "1")
    unique = F.when(F.length("surface") > 2, "unique").otherwise("shared")
    return rows.select(F.col("surface").alias("wordform"), "preceding_part", "stem", "following_part", F.when(F.substring(F.md5(F.col("surface").cast("binary")), 2, 1) < "8", F.lower("stem")).otherwise(F.col("lemma")).alias("lemma"), "pos", F.when(test, "test").otherwise("train").alias("data_split"), "word_freq", unique.alias("unique"))


def gold_items(source: DataFrame) -> DataFrame:
    """(word, cuts, split, freq, pos, lemma) of the unique rows whose lemma is the stem and whose parts make up the word. [S8 P10 P11 P12]"""
    whole = F.lower(F.concat("preceding_part", "stem", "following_part")) == F.lower("wordform")
    found = once(source, letters=is_word(F.col("wordform")), whole=whole)
    rows = found.where((F.col("unique") == "unique") & (F.lower("lemma") == F.lower("stem")) & F.col("letters") & F.col("whole") & (F.length("wordform") >= 2))
    first = F.when(F.col("preceding_part") != "", F.length("preceding_part"))
    second = F.when(F.col("following_part") != "", F.length("preceding_part") + F.length("stem"))
    return rows.select(F.col("wordform").alias("word"), F.array_distinct(F.array_compact(F.array(first, second))).alias("cuts"), F.col("data_split").alias("split"), F.col("word_freq").cast("double").alias("freq"), "pos", "lemma")


def predictions(gold: DataFrame, tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """Gold items with predicted cuts, number of pieces, and whether the word was seen in training. [P13 F10 J8]

    `tokens` has word and pieces; words whose pieces do not make them up are dropped."""
    return predicted(gold.join(tokens.select("word", "pieces"), "word"), seen)


def predicted(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """`predictions` of rows that have word and pieces. [P13 F10 J8]"""
    rows = once(rows, joined=F.array_join(F.transform("pieces", stripped), "")).where(F.col("joined") == F.col("word")).drop("joined")
    cuts = F.filter(cuts_of(F.col("pieces")), lambda c: c < F.length("word"))
    known = seen.select(F.col("form").alias("w"), F.lit(True).alias("was_seen"))
    rows = rows.withColumn("pred", cuts).withColumn("n_pieces", F.size("pieces")).withColumn("w", F.lower("word"))
    return rows.join(known, "w", "left").withColumn("seen", F.coalesce("was_seen", F.lit(False))).drop("w", "was_seen", "pieces")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged precision, recall and F1, plain and weighted by freq, with n_words and tokens_per_word. [A10 T1]"""
    rows = rows.withColumns({"tp": F.size(F.array_intersect("cuts", "pred")), "fp": F.size(F.array_except("pred", "cuts")), "fn": F.size(F.array_except("cuts", "pred"))})
    sums = {f"{w}{c}": F.sum(F.col(c) * (F.col("freq") if w else F.lit(1.0))) for w in ("", "weighted_") for c in ("tp", "fp", "fn")}
    out = rows.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()], F.count("*").alias("n_words"), F.avg("n_pieces").alias("tokens_per_word"))
    columns = []
    for w in ("", "weighted_"):
        p, r = _ratio(F.col(f"{w}tp"), F.col(f"{w}tp") + F.col(f"{w}fp")), _ratio(F.col(f"{w}tp"), F.col(f"{w}tp") + F.col(f"{w}fn"))
        columns += [F.round(p, 6).alias(f"{w}precision"), F.round(r, 6).alias(f"{w}recall"), F.round(_ratio(2 * p * r, p + r), 6).alias(f"{w}f1")]
    return out.select(*by, *columns, "n_words", F.round("tokens_per_word", 6).alias("tokens_per_word"))


def subsets(rows: DataFrame) -> DataFrame:
    """Each row once for every subset it is in: all, test_split, unseen, seen. [A11]"""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("split") == "test", F.lit("test_split")), F.when(F.col("seen"), F.lit("seen")).otherwise(F.lit("unseen"))))
    return rows.withColumn("subset", F.explode(names))


# ----------------------------------------------------------------------------- running text


def token_shapes(rows: DataFrame) -> DataFrame:
    """Per row of tokens: counts of tokens, characters, and tokens with a leading, trailing or inner marker. [P17 P18]"""
    core = lambda t: stripped(t) != ""
    inner = lambda t: F.contains(F.btrim(t, F.lit(MARK)), F.lit(MARK))
    return rows.withColumns(
        {
            "n_tok": F.size("tokens"),
            "n_char": F.aggregate("tokens", F.lit(0), lambda acc, t: acc + F.length(stripped(t))),
            "lead": F.size(F.filter("tokens", lambda t: core(t) & t.startswith(MARK))),
            "trail": F.size(F.filter("tokens", lambda t: core(t) & t.endswith(MARK))),
            "cross": F.size(F.filter("tokens", lambda t: core(t) & inner(t))),
        }
    )


def boundaries(rows: DataFrame) -> DataFrame:
    """(…, pos_l, pos_r, token) of each word boundary that lies in a token, for rows (tokens, words, tags). [J19 W3]

    Each token is repeated for each of its characters within the row's array, so a place in the text
    looks its token up at once; a marker that the model puts before the first word shifts the places by one."""
    places = F.flatten(F.transform("tokens", lambda t: F.array_repeat(t, F.length(t))))
    rows = rows.withColumn("places", places).withColumn("shift", F.when(F.element_at("tokens", 1).startswith(MARK), 1).otherwise(0))
    located = F.expr(
        "aggregate(sequence(0, size(words) - 2), struct(shift AS at, cast(array() AS array<struct<pos_l:string,pos_r:string,token:string>>) AS found), "
        "(acc, k) -> struct(acc.at + length(words[k]) + 1 AS at, concat(acc.found, array(struct(tags[k] AS pos_l, tags[k + 1] AS pos_r, get(places, acc.at + length(words[k])) AS token))) AS found), acc -> acc.found)"
    )
    keep = [c for c in rows.columns if c not in ("tokens", "words", "tags", "places", "shift")]
    return rows.where((F.size("words") > 1) & (F.size("tokens") > 0)).select(*keep, F.explode(located).alias("b")).select(*keep, "b.*").where(F.col("token").isNotNull())


def with_transition(found: DataFrame, table: DataFrame) -> DataFrame:
    """Boundaries with the probability of their transition, 0 where it does not occur. The table has a row a pair of tags. [J4]"""
    return found.join(F.broadcast(table.select("pos_l", "pos_r", "p")), ["pos_l", "pos_r"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def compression(rows: DataFrame, table: DataFrame, by: str = "lang") -> DataFrame:
    """Tokens a word, characters a token, shares of markers, boundaries absorbed and their mean transition probability. [A9]"""
    per_row = token_shapes(rows).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n_tok", "n_char", "lead", "trail", "cross")], F.sum(F.size("words")).alias("n_word"))
    absorbed = F.length("token") > 1
    edge = with_transition(boundaries(rows.select(by, "tokens", "words", "tags")), table).groupBy(by).agg(
        F.count("*").alias("all_n"), F.sum("p").alias("all_p"), F.sum(absorbed.cast("int")).alias("absorbed_n"), F.sum(F.when(absorbed, F.col("p")).otherwise(0.0)).alias("absorbed_p")
    )
    out = per_row.join(edge, by, "left").na.fill(0)
    one = lambda c: F.greatest(F.lit(1), F.col(c))
    values = {
        "tokens_per_word": F.col("n_tok") / F.col("n_word"), "chars_per_token": F.col("n_char") / F.col("n_tok"),
        "share_leading_marker": F.col("lead") / F.col("n_tok"), "share_trailing_marker": F.col("trail") / F.col("n_tok"), "share_cross_word": F.col("cross") / F.col("n_tok"),
        "boundaries_absorbed": F.col("absorbed_n") / one("all_n"), "mean_transition_p_all": F.col("all_p") / one("all_n"), "mean_transition_p_absorbed": F.col("absorbed_p") / one("absorbed_n"),
    }
    return out.select(by, *[F.round(v, 6).alias(k) for k, v in values.items()])


def spans(rows: DataFrame, table: DataFrame, by: str = "lang", strict: bool = False) -> DataFrame:
    """Share of word boundaries in tokens with an inner marker, and mean transition probability there and everywhere. [A20]

    With `strict`, a marker at the end of its token does not count."""
    found = with_transition(boundaries(rows.select(by, "tokens", "words", "tags")), table)
    spanned = spans_inside(F.col("token"))
    if strict:
        spanned = spanned & ~F.col("token").endswith(MARK)
    out = found.groupBy(by).agg(F.count("*").alias("n_all"), F.sum(spanned.cast("int")).alias("n_span"), F.sum("p").alias("p_all"), F.sum(F.when(spanned, F.col("p")).otherwise(0.0)).alias("p_span"))
    return out.select(by, F.round(F.col("p_all") / F.col("n_all"), 6).alias("p_all"), F.round(F.col("p_span") / F.greatest(F.lit(1), F.col("n_span")), 6).alias("p_span"), F.round(F.col("n_span") / F.col("n_all"), 6).alias("share_span"))


def spans_inside(token: Column) -> Column:
    return F.contains(F.btrim(token, F.lit(MARK)), F.lit(MARK))


def top_spanned(rows: DataFrame, by: str = "lang") -> DataFrame:
    """(lang, what, value, n): the transition and the token that span boundaries most often. [A21 K6]"""
    found = boundaries(rows.select(by, "tokens", "words", "tags")).where(spans_inside(F.col("token")))
    both = found.select(by, F.explode(F.array(F.struct(F.lit("transition").alias("what"), F.concat_ws("->", "pos_l", "pos_r").alias("value")), F.struct(F.lit("token").alias("what"), F.col("token").alias("value")))).alias("x"))
    counts = both.groupBy(by, "x.what", "x.value").agg(F.count("*").alias("n"))
    best = counts.groupBy(by, "what").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("x"))
    return best.select(by, "what", "x.value", (-F.col("x.m")).alias("n"))


def agreement(a: DataFrame, b: DataFrame, key: tuple[str, ...], by: str = "lang") -> DataFrame:
    """Agreement of the boundaries of two segmentations, in two tables, of the same rows. [J16]"""
    both = a.select(*key, by, F.col("tokens").alias("x")).join(b.select(*key, F.col("tokens").alias("y")), list(key))
    return agreements(both, {0: "x", 1: "y"}, by).select(by, "agreement")


def agreements(rows: DataFrame, tokens: dict[int, str], by: str = "lang") -> DataFrame:
    """(by, a, b, agreement) of each pair a < b of segmentations that stand in columns of the same rows:
    2|A∩B| / (2|A∩B| + |A△B|) of their boundaries. One pass, no join. [A19 T1]"""
    rows = rows.select(by, *[cuts_of(F.col(c)).alias(f"c{k}") for k, c in tokens.items()])
    pairs = [(a, b) for a in tokens for b in tokens if a < b]
    common = lambda a, b: F.size(F.array_intersect(f"c{a}", f"c{b}"))
    sums = rows.groupBy(by).agg(*[F.sum(common(a, b)).alias(f"s{a}_{b}") for a, b in pairs], *[F.sum(F.size(f"c{a}") + F.size(f"c{b}") - 2 * common(a, b)).alias(f"d{a}_{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(2 * F.col(f"s{a}_{b}") / (2 * F.col(f"s{a}_{b}") + F.col(f"d{a}_{b}")), 6).alias("agreement")) for a, b in pairs])
    return sums.select(by, F.explode(each).alias("x")).select(by, "x.*")


def example_picks(segmented: DataFrame, gold: DataFrame, seen: DataFrame) -> DataFrame:
    """First, middle and last of the unseen lower-case gold words of 8 to 14 letters with a cut, with their pieces joined by bars. [P15 W7 F18 M16]"""
    rows = gold.where(F.length("word").between(8, 14) & (F.size("cuts") > 0) & (F.col("word") == F.lower("word")))
    rows = rows.join(seen.select(F.col("form").alias("word")), "word", "left_anti").join(segmented, "word")
    every = Window.partitionBy("split")
    rows = rows.withColumn("rn", F.row_number().over(every.orderBy("word"))).withColumn("n", F.count("*").over(every))
    picked = rows.where((F.col("n") < 3) | F.col("rn").isin(1) | (F.col("rn") == F.floor(F.col("n") / 2) + 1) | (F.col("rn") == F.col("n")))
    return picked.select("split", "word", F.array_join(F.filter(F.transform("pieces", stripped), lambda p: p != ""), "|").alias("pieces"))
