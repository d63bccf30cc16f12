"""Tables over run records in long form: (lang, method, seed, budget, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivoted(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric of a run. [A24]"""
    return runs.unpivot(keys, metrics, "metric", "value")


def mean_sd(runs: DataFrame, *keys: str) -> DataFrame:
    """Mean and sample deviation over seeds; 0 for a single run. [A17]"""
    return runs.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("n"))


def best(runs: DataFrame, higher_better: bool = True) -> DataFrame:
    """(lang, method, mean) of the best method of each language, ties to the smaller name. [A22 Q11]"""
    means = mean_sd(runs, "lang", "method")
    first = F.min(F.struct((-F.col("mean") if higher_better else F.col("mean")).alias("m"), "method", "mean"))
    return means.groupBy("lang").agg(first.alias("x")).select("lang", "x.method", "x.mean")


def by_language(runs: DataFrame, langs: list[str]) -> DataFrame:
    """A row a method, a column a language. [A23]"""
    return runs.groupBy("method").pivot("lang", langs).agg(F.round(F.avg("value"), 6))


def by_budget(runs: DataFrame, budgets: list[int]) -> DataFrame:
    """A row a language and method, a column a budget. [A25]"""
    named = runs.withColumn("budget", F.concat(F.lit("b"), F.col("budget")))
    return named.groupBy("lang", "method").pivot("budget", [f"b{b}" for b in budgets]).agg(F.round(F.avg("value"), 6))


def runs_per_cell(runs: DataFrame) -> DataFrame:
    """How many cells have how many runs. [A27]"""
    cells = runs.groupBy("lang", "method", "budget").agg(F.countDistinct("seed").alias("runs"))
    return cells.groupBy("runs").agg(F.count("*").alias("cells"))


def parse_replies(replies: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, segmentation, valid) from replies (reply_id, reply): lines `word: segmentation` of wanted words; the
    last whose letters are the word's, else the last. [F12 P14]"""
    lines = replies.select("reply_id", F.posexplode(F.split("reply", "\n")).alias("line", "text")).where(F.instr("text", ":") > 0)
    rows = lines.select("reply_id", "line", F.trim(F.substring_index("text", ":", 1)).alias("word"), F.trim(F.expr("substr(text, instr(text, ':') + 1)")).alias("segmentation"))
    rows = rows.join(wanted.select("word").distinct(), "word").withColumn("valid", F.replace("segmentation", F.lit("+"), F.lit("")) == F.col("word"))
    last = rows.groupBy("word").agg(F.max(F.struct("valid", "reply_id", "line", "segmentation")).alias("x"))
    return last.select("word", "x.segmentation", "x.valid")


def reply_pieces(rows: DataFrame) -> DataFrame:
    """`rows` (segmentation) with pieces. [F11]"""
    return rows.withColumn("pieces", F.split("segmentation", r"\+"))


def latest(answers: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only table. [S18]"""
    others = [c for c in answers.columns if c not in (key, order)]
    return answers.groupBy(key).agg(F.max(F.struct(order, *others)).alias("x")).select(key, F.col(f"x.{order}").alias(order), *[F.col(f"x.{c}").alias(c) for c in others])


def missing(words: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that the cache does not have yet. [J15 S17 T5 P20]"""
    return words.select(key).distinct().join(cached.select(key), key, "left_anti")


def tex_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a table as a line of TeX. [S21 F15]"""
    return table.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in columns]), F.lit(r" \\")).alias("line"))


def macros(values: DataFrame) -> DataFrame:
    """Distinct TeX definitions of (name, value), in order. [S21 T6]"""
    return values.select(F.concat(F.lit("\\newcommand{\\"), "name", F.lit("}{"), "value", F.lit("}")).alias("line")).distinct().orderBy("line")


def with_probes(runs: DataFrame, probes: DataFrame, keys=("lang", "method", "budget", "seed")) -> DataFrame:
    """Runs that have a probe record, with its columns. [J17]"""
    return runs.join(probes, list(keys))


FIGURE = "figure", "panel", "series", "x", "y", "spread"


def _figure(rows: DataFrame, name: str, **columns) -> DataFrame:
    given = {"panel": F.lit(""), "series": F.lit(""), "spread": F.lit(0.0)} | columns
    return rows.select(F.lit(name).alias("figure"), *[given[c].cast("string" if c in ("panel", "series", "x") else "double").alias(c) for c in FIGURE[1:]])


def figure_histogram(vocab: DataFrame) -> DataFrame:
    """Data of the histogram of token lengths. [S22]"""
    sizes = vocab.select(F.length("token").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    return _figure(sizes, "lengths", x=F.col("size"), y=F.col("n"))


def figure_merges(merges: DataFrame) -> DataFrame:
    """Data of the curve of pair frequencies over merges (rank, n). [S22]"""
    return _figure(merges, "merges", x=F.col("rank"), y=F.col("n"))


def figure_bars(stats: DataFrame, metric: str) -> DataFrame:
    """Data of grouped bars with spreads, a group a language and a bar a method. [S22]"""
    return _figure(stats.where(F.col("metric") == metric), "bars", series=F.col("method"), x=F.col("lang"), y=F.col("mean"), spread=F.col("sd"))


def figure_precision_recall(scores: DataFrame, panel: str) -> DataFrame:
    """Data of the panels of precision over recall, a panel for each value of `panel`. [S22]"""
    return _figure(scores, "precision_recall", panel=F.col(panel), x=F.format_string("%.6f", F.col("recall")), y=F.col("precision"))


def figure_sweep(runs: DataFrame) -> DataFrame:
    """Data of the panels of a metric over budgets, a panel a language and a line a method. [S22]"""
    means = runs.groupBy("lang", "method", "budget").agg(F.round(F.avg("value"), 6).alias("mean"))
    return _figure(means, "sweep", panel=F.col("lang"), series=F.col("method"), x=F.col("budget"), y=F.col("mean"))
