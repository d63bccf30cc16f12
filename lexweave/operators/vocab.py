"""Vocabulary statistics, token ids, and bits per character."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stripped


def vocabulary(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, n): distinct tokens of rows (keys, tokens) with their counts. [T4 K4 A15]"""
    return rows.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def overlap(vocab: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, a, b, common, either, jaccard) of each pair a < b of values of `key`. [J12 J13 A18 T2]

    One pass: each token carries the keys that have it, so tokens are not joined with themselves."""
    held = vocab.groupBy(*by, "token").agg(F.array_sort(F.collect_set(key)).alias("keys"))  # as many as there are keys at most
    pairs = held.select(*by, F.explode(F.expr("flatten(transform(keys, x -> transform(filter(keys, y -> y > x), y -> struct(x AS a, y AS b))))")).alias("x"))
    common = pairs.groupBy(*by, "x.a", "x.b").agg(F.count("*").alias("common"))
    sizes = vocab.groupBy(*by, key).agg(F.countDistinct("token").alias("size"))
    a, b = sizes.select(*by, F.col(key).alias("a"), F.col("size").alias("na")), sizes.select(*by, F.col(key).alias("b"), F.col("size").alias("nb"))
    every = a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))
    every = every.where("a < b").join(common, [*by, "a", "b"], "left").na.fill(0, ["common"])
    either = F.col("na") + F.col("nb") - F.col("common")
    return every.select(*by, "a", "b", "common", either.alias("either"), F.round(F.col("common") / either, 6).alias("jaccard"))


def lengths(vocab: DataFrame, *by: str) -> DataFrame:
    """Mean token length without markers and entropy of the lengths in bits. [A12 A13]"""
    counts = vocab.select(*by, F.length(stripped(F.col("token"))).alias("size")).where("size > 0").groupBy(*by, "size").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
    return shares.groupBy(*by).agg(F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 6).alias("avg_len"), F.round(-F.sum(F.col("share") * F.log2("share")), 6).alias("entropy"))


def divergence(p: DataFrame, q: DataFrame, floor: float = 1e-9) -> DataFrame:
    """KL(p || q) in bits over tokens with counts n; shares are clipped to `floor`..1 and not scaled again. [A14 J11]"""
    a = p.select("token", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    b = q.select("token", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("q"))
    both = a.join(b, "token", "full_outer")
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(floor), F.coalesce(c, F.lit(0.0))))
    return both.agg(F.round(F.sum(clip("p") * F.log2(clip("p") / clip("q"))), 6).alias("kl"))


def report(vocab: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """One row of vocabulary metrics against a base vocabulary; both count each token once. [A16 Q12]"""
    once = lambda v: v.select("token").distinct().withColumn("n", F.lit(1))
    v, b = once(vocab), once(base)
    both = v.withColumn("v", F.lit(1)).join(b.withColumn("b", F.lit(1)), "token", "full_outer")
    counts = both.agg(F.sum(F.coalesce("v", F.lit(0))).alias("size"), F.sum(F.coalesce("b", F.lit(0))).alias("base_size"), F.sum(F.when(F.col("v").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("common"), F.count("*").alias("either"))
    base_lengths = lengths(b).select(F.col("avg_len").alias("base_avg_len"), F.col("entropy").alias("base_entropy"))
    row = counts.crossJoin(lengths(v)).crossJoin(base_lengths).crossJoin(divergence(v, b))  # one row each
    return row.select(F.lit(name).alias("model"), "size", "base_size", "common", F.round(F.col("common") / F.col("either"), 6).alias("jaccard"), "avg_len", "base_avg_len", "entropy", "base_entropy", "kl")


def ids(vocab: DataFrame) -> DataFrame:
    """(token, id): 2 and up in code-point order; 0 is the end of a paragraph, 1 an unknown token. [J10]

    Ranks come from counts of first-character ranges, so no single task orders the whole vocabulary."""
    tokens = vocab.select("token").distinct().withColumn("head", F.substring("token", 1, 1))
    offsets = tokens.groupBy("head").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = tokens.withColumn("rn", F.row_number().over(Window.partitionBy("head").orderBy("token")))
    return own.join(offsets, "head").select("token", (F.col("base") + F.col("rn") + 1).alias("id"))


def id_rows(rows: DataFrame, vocab_ids: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, id) of every token, unknown ones as 1, and a 0 after each row. [J10]"""
    each = rows.select(*keys, F.posexplode("tokens").alias("i", "token")).join(vocab_ids, "token", "left")
    ends = rows.select(*keys, F.size("tokens").alias("i"), F.lit(0).cast("long").alias("id"))
    return each.select(*keys, "i", F.coalesce("id", F.lit(1)).cast("long").alias("id")).unionByName(ends)


def windows(rows: DataFrame, *, size: int = 128, by: str = "lang", order: tuple[str, ...] = ("doc_id", "para_idx")) -> DataFrame:
    """(lang, window, n): predicted tokens in each context window of `size` over the stream of rows (tokens), a stream a language. [W9]

    Only each row's length enters: rows are placed by running sums over documents first, then within documents."""
    counted = rows.select(by, *order, (F.size("tokens") + 1).alias("n"))
    doc = counted.groupBy(by, order[0]).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    streams = doc.withColumn("base", before).groupBy(by).agg(F.max(F.col("base") + F.col("n")).alias("total"))
    each = streams.where("total > 1").select(by, "total", F.explode(F.expr(f"sequence(0L, (total - 2) div {size})")).alias("window"))
    return each.select(by, "window", F.least(F.lit(size).cast("long"), F.col("total") - 1 - F.col("window") * size).alias("n"))


def stream_starts(rows: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """Rows (by, order, n) with `base`, where each begins in the stream of its language: over documents first, then within them."""
    doc = rows.groupBy(by, order[0]).agg(F.sum("n").alias("size"))
    before = lambda *keys: Window.partitionBy(by, *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    doc = doc.withColumn("doc_base", F.coalesce(F.sum("size").over(before(order[0])), F.lit(0))).drop("size")
    within = F.coalesce(F.sum("n").over(before(*order)), F.lit(0))
    return rows.withColumn("own", within).join(doc, [by, order[0]]).withColumn("base", F.col("doc_base") + F.col("own")).drop("own", "doc_base")


def training_windows(rows: DataFrame, ids_of: DataFrame, *, samples: int, size: int = 128, seed: int = 0, by: str = "lang", order: tuple[str, ...] = ("doc_id", "para_idx")) -> DataFrame:
    """(lang, sample, start, n, total): `samples` windows of `size` ids a language at hashed places of its stream, with the sum of their ids. [W10]

    Only the tokens of stretches that a window touches are looked at: windows and tokens meet on places div `size`."""
    placed = stream_starts(rows.select(by, *order, "tokens", (F.size("tokens") + 1).alias("n")), by, order)
    streams = placed.groupBy(by).agg(F.max(F.col("base") + F.col("n")).alias("total"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), by, "sample").cast("binary")), 1, 8), 16, 10).cast("long")
    starts = streams.where(F.col("total") > size + 1).select(by, "total", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    starts = starts.select(by, F.col("sample").cast("long").alias("sample"), (place % (F.col("total") - size - 1)).alias("start"))
    each = placed.select(by, "base", F.posexplode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("i", "token")).join(ids_of, "token", "left")
    last = F.col("token").isNull()  # the end of a row
    each = each.select(by, (F.col("base") + F.col("i")).alias("place"), F.when(last, 0).otherwise(F.coalesce("id", F.lit(1))).cast("long").alias("id"))
    asked = starts.withColumn("stretch", F.explode(F.array(F.expr(f"start div {size}"), F.expr(f"start div {size} + 1"))))
    met = each.withColumn("stretch", F.expr(f"place div {size}")).join(asked, [by, "stretch"]).where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + size))
    return met.groupBy(by, "sample", "start").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


def ngram_bits(train: DataFrame, test: DataFrame, by: str = "lang") -> DataFrame:
    """`held_out_bits` of two tables."""
    sides = [rows.select(by, "tokens", "text").withColumn("held", F.lit(held)) for rows, held in ((train, False), (test, True))]
    return held_out_bits(sides[0].unionByName(sides[1]), by)


def held_out_bits(rows: DataFrame, by: str = "lang") -> DataFrame:
    """(lang, tokens, chars, bits_per_char) of the rows (tokens, text, held) that are held out, under add-one bigrams of the others. [A29]

    It takes the place of the neural probe: nll / ln 2 / characters, a row having its text and one end.
    The rows are encoded and their bigrams counted once, for both sides; all that follows works on the counts."""
    ended = rows.select(by, "held", F.concat(F.array(F.lit("</s>")), "tokens", F.array(F.lit("</s>"))).alias("s"))
    pairs = ended.select(by, "held", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(s[i - 1] AS l, s[i] AS r))")).alias("x"))
    counts = pairs.groupBy(by, "x.l", "x.r").agg(F.count_if(~F.col("held")).alias("n"), F.count_if("held").alias("m"))
    return bits_of(counts, rows, by)


def bits_of(counts: DataFrame, rows: DataFrame, by: str = "lang") -> DataFrame:
    """`held_out_bits` from its bigrams (by, l, r, n in training, m held out) and the rows (by, text, held)."""
    left = Window.partitionBy(by, "l")
    counts = counts.withColumn("nl", F.sum("n").over(left)).withColumn("first", F.row_number().over(Window.partitionBy(by, "r").orderBy(F.col("n").desc(), "l")))
    counts = counts.select(by, "n", "m", "nl", ((F.col("first") == 1) & (F.col("n") > 0)).cast("long").alias("kind"))
    sizes = counts.groupBy(by).agg((F.sum("kind") + 1).alias("v"))
    nll = counts.where("m > 0").join(sizes, by).groupBy(by).agg(F.sum(-F.col("m") * F.log((F.col("n") + 1) / (F.col("nl") + F.col("v")))).alias("nll"), F.sum("m").alias("tokens"))
    chars = rows.where("held").groupBy(by).agg(F.sum(F.length("text") + 1).alias("chars"))
    return nll.join(chars, by).select(by, "tokens", "chars", F.round(F.col("nll") / F.lit(0.6931471805599453) / F.col("chars"), 6).alias("bits_per_char"))
