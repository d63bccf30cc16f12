"""Queries that go through the sources and sinks, and those over their records. Each writes to a folder of its own,
reads it again and works on what it read; the SQL twins know nothing of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bpe, l2w, report, score, symbols, text, vocab
from ..sources import tables as T
from . import catalogue as C
from . import oracles as O
from .models import BUDGETS, MERGES, SEEDS, seed_merges

# --------------------------------------------------------------------------- sources and sinks


def lines_source(spark, d):
    """How often each stripped, non-blank line of the conversations occurs. [S2]"""
    path = T.scratch(spark)
    T.table(spark, d, "conversations").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return T.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


def article_slice(spark, d):
    """Documents 11 to 60 of each language: the source's skip and take. [S1]"""
    return text.articles(T.table(spark, d, "documents"), 10, 50).select("doc_id", "lang")


def split_sink(spark, d):
    """[S3 T7]"""
    path = T.scratch(spark)
    T.write_split(text.dedupe_split(C.paras(spark, d)), path)
    return spark.read.parquet(path).groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def tagged_source(spark, d):
    """[S4 S5 F16 P19]"""
    path = T.scratch(spark)
    T.write_tagged(T.tagged_paragraphs(C.tagged(spark, d)), path)
    rows = T.read_tagged(spark, path)
    words = rows.select("text", F.explode("words").alias("w")).where(F.expr("substr(text, w.start + 1, w.end - w.start) = w.surface"))
    return words.groupBy(F.col("w.upos").alias("upos")).agg(F.count("*").alias("n"), F.sum((F.col("w.end") - F.col("w.start")).cast("long")).alias("chars"))


def legacy_tagged_source(spark, d):
    """[S6 A2]"""
    path = T.scratch(spark)
    lines = T.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("item_id", "k", S.squeezed(F.col("line")).alias("text")).where("text <> ''")
    pairs = F.transform(F.arrays_zip("words", "tags"), lambda x: F.struct(x["words"].alias("word"), x["tags"].alias("pos")))
    rows = text.word_arrays(lines).select((F.col("item_id") % 8).alias("part"), (F.col("item_id") * 1000 + F.col("k")).alias("sentence"), pairs.alias("words"))
    T.write_legacy_tagged(rows, path)
    return text.transitions(T.read_legacy_tagged(spark, path).select(F.transform("words", lambda w: w["pos"]).alias("tags")))


def transitions_sink(spark, d):
    """[S7]"""
    path = T.scratch(spark)
    T.write_transitions(text.transitions(C.arrays(spark, d)), path)
    return T.read_transitions(spark, path)


def gold_source_csv(spark, d):
    """[S8 P10 P11 P12]"""
    path = T.scratch(spark)
    score.gold_source(C.tagged_types(spark, d)).write.option("header", True).option("emptyValue", "").csv(path)
    return C.flat(score.gold_items(T.read_gold(spark, path)))


def merge_model_source(spark, d):
    """A trained model saved and loaded: merges, vocabulary, settings, and the older form's joined tokens. [S9 S10 S12 P6]"""
    path, rows = T.scratch(spark), C.sequences(spark, d)
    merges = bpe.native(rows, 8).cache()
    T.write_bpe(merges, bpe.vocabulary_of(rows, merges), bpe.METHODS["bpe"], f"{path}/own")
    T.write_legacy_model(merges, bpe.vocabulary_of(rows, merges), f"{path}/older")
    found, known, config = T.read_bpe(spark, f"{path}/own")
    out = found.select(F.lit("merge").alias("kind"), "rank", F.concat_ws(" ", "l", "r").alias("value"))
    out = out.union(known.select(F.lit("vocab"), F.lit(-1).cast("long"), "token"))
    out = out.union(T.read_legacy_model(spark, f"{path}/older").select(F.lit("joined"), "rank", "token"))
    return out.union(config.select(F.lit("config"), F.lit(-1).cast("long"), F.format_string("%d %d", "beta", "factor")))


def l2w_model_source(spark, d):
    """Segments by a stem-boundary model that was saved with all its affixes. [S11 M6]"""
    path = T.scratch(spark)
    found = l2w.spans(text.tagged_types(C.training(spark, d)))
    T.write_lemma_words(l2w.lexicon(found), l2w.affixes(found, 1), path, min_count=l2w.MIN_COUNT, min_stem=l2w.MIN_STEM)
    lexicon, affixes, least = T.read_lemma_words(spark, path)
    return C.flat(l2w.segment(C.distinct_words(spark, d), lexicon, affixes, least))


def unigram_model_source(spark, d):
    """A unigram model of characters, saved and loaded. [S13]"""
    path = T.scratch(spark)
    counts = C.paras(spark, d).select(F.explode(F.split(F.replace("text", F.lit(" "), F.lit(S.MARK)), "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    T.write_unigram(counts.select("token", F.round(F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))), 6).alias("logprob")), path)
    return T.read_unigram(spark, path)


def _records(spark, d) -> DataFrame:
    """Run records in their stored shape, from the long table."""
    wide = C._runs(spark, d).groupBy("lang", "method", "seed", "budget").pivot("metric", ["tokens_per_word", "chars_per_token"]).agg(F.first("value"))
    held = F.struct(*[(F.col(h) if h in ("tokens_per_word", "chars_per_token") else F.lit(None).cast("double")).alias(h) for h in T.HELDOUT])
    return wide.select("lang", "method", "seed", F.col("budget").alias("vocab_budget"), held.alias("heldout"))


def run_records_source(spark, d):
    """Run records through their folders, whose names give method, budget and seed. [S14 P16 DM16]"""
    path = T.scratch(spark)
    T.write_records(_records(spark, d), path)
    runs = T.read_runs(spark, f"{path}/*/*/*.json").where("run_method = method AND run_budget = vocab_budget AND run_seed = seed")
    return C.flat(T.long_runs(runs).where("value IS NOT NULL").select("lang", "method", "seed", "budget", "metric", F.round("value", 6).alias("value")))


def vocab_upsert(spark, d):
    """Vocabulary tables of which one seed is written anew, and the others stay. [S15 S16 P20]"""
    path, every = T.scratch(spark), C._seed_vocab(spark, d).where("lang = 'en'")
    T.upsert(every.withColumn("n", F.when(F.col("seed") == 1, F.lit(0)).otherwise(F.col("n"))), path, ["seed"])
    T.upsert(every.where("seed = 1"), path, ["seed"])
    return C.flat(spark.read.parquet(path).groupBy("seed").agg(F.count("*").alias("tokens"), F.sum("n").alias("n")))


def metrics_with_probe(spark, d):
    """Runs that have a probe record, with its bits per character. [J17 S16 A29]"""
    path = T.scratch(spark)
    bits = C.ngram_bits_per_char(spark, d).select("lang", F.lit("free").alias("method"), F.lit(BUDGETS[-1]).alias("vocab_budget"), F.lit(0).alias("seed"), "bits_per_char", F.col("tokens").cast("int").alias("test_tokens"))
    T.write_records(bits, path)
    probes = T.read_probes(spark, f"{path}/*/*/*.json").select("lang", "method", F.col("vocab_budget").alias("budget"), "seed", "bits_per_char")
    runs = C._runs(spark, d).where("metric = 'tokens_per_word'").select("lang", "method", "budget", "seed", F.round("value", 6).alias("tokens_per_word"))
    return C.flat(report.with_probes(runs, probes))


def answers_log(spark, d):
    """The latest answers of a log that was written in two runs. [S18 K6]"""
    path = T.scratch(spark)
    rows = C._replies(spark, d).select("reply_id", F.posexplode(F.split("reply", "\n")).alias("line", "t"))
    rows = rows.select((F.col("reply_id") * 10_000 + F.col("line")).alias("at"), F.substring_index("t", ": ", 1).alias("word"), F.substring_index("t", ": ", -1).alias("segmentation"))
    for part in (0, 1):
        T.append_answers(rows.where(F.col("at") % 2 == part), path)
    return report.latest(spark.read.schema("at LONG, word STRING, segmentation STRING").json(path), "word", "at")


def report_csv(spark, d):
    """The union of two reports as CSV. [S19 T3]"""
    path, a, b = T.scratch(spark), C._vocab(spark, d, MERGES), C._vocab(spark, d, seed_merges(1))
    T.write_report([vocab.lengths(a).withColumn("model", F.lit("seed0")), vocab.lengths(b).withColumn("model", F.lit("seed1"))], path)
    return spark.read.option("header", True).schema("avg_len DOUBLE, entropy DOUBLE, model STRING").csv(path)


def train_summary(spark, d):
    """[S20 A31 M1]"""
    path, rows = T.scratch(spark), C.sequences(spark, d)
    merges = bpe.native_legacy(C.arrays(spark, d), None, 4)
    T.write_summary(bpe.summary(bpe.vocabulary_of(rows, merges), merges), path)
    return spark.read.schema("vocab_size LONG, num_merges LONG, avg_iter_ms DOUBLE").json(path).select("vocab_size", "num_merges", (F.col("avg_iter_ms") > 0).alias("timed"))


# ----------------------------------------------------------------------------------- operators


def surface_pos_join(spark, d):
    """Held-out words by the majority tag of their form in training, X for forms that it lacks. [J2 A4]"""
    table = text.surface_pos(text.tagged_types(C.training(spark, d)))
    words = text.word_offsets(C.paras(spark, d).where(text.is_held_out()))
    return text.with_surface_pos(words.select("surface"), table).groupBy("pos").agg(F.count("*").alias("n"))


def _legacy(part: str):
    def query(spark, d):
        return bpe.native_legacy(C.arrays(spark, d), None, 8, part).drop("ms")

    return query


def training_windows(spark, d):
    """[W10 J10]"""
    rows = C.segmented(C.training(spark, d))
    return C.flat(vocab.training_windows(rows, vocab.ids(vocab.vocabulary(rows)), samples=16))


def learning_rates(spark, d):
    """[F14]"""
    return spark.range(0, 301).select(F.col("id").alias("step"), F.round(S.learning_rate(F.col("id"), 250), 12).alias("rate"))


def prompts(spark, d):
    """Requests for batches of 40 gold words. [F19 M10]"""
    words = C.gold(spark, d).select("word", F.substring(F.md5(F.col("word").cast("binary")), 1, 1).alias("part"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("word"))
    batches = words.withColumn("batch", F.floor((rank - 1) / 40)).groupBy("part", "batch").agg(F.array_sort(F.collect_list("word")).alias("words"))  # 40 words at most
    return batches.select("part", "batch", S.prompt(F.col("words"), F.lit("English")).alias("prompt"))


def formatted_cells(spark, d):
    """[F15]"""
    stats = report.mean_sd(C._runs(spark, d), "lang", "method", "budget", "metric")
    return stats.select("lang", S.tex_escaped(F.concat_ws("_", "method", "metric", F.col("budget").cast("string"))).alias("name"), S.cell(F.col("mean"), F.col("sd"), 100.0, 1).alias("cell"), S.thousands(F.round(F.col("mean") * 1e6)).alias("number"))


def tex_macros(spark, d):
    """[S21 T6 F15]"""
    counts = C.paras(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return report.macros(counts.union(counts).select(F.concat(F.lit("nParagraphs"), F.initcap("lang")).alias("name"), S.thousands(F.col("n")).alias("value")))


def figure_frames(spark, d):
    """The data of all five kinds of figures. [S22]"""
    runs = C._runs(spark, d).where("metric = 'tokens_per_word'")
    frames = [
        report.figure_histogram(C._vocab(spark, d, MERGES)),
        report.figure_merges(C.bpe_merges_k8(spark, d)),
        report.figure_bars(report.mean_sd(runs.where(f"budget = {BUDGETS[-1]}"), "lang", "method", "metric"), "tokens_per_word"),
        report.figure_precision_recall(C.boundary_prf_subsets(spark, d), "subset"),
        report.figure_sweep(runs),
    ]
    return reduce(DataFrame.unionByName, frames)


def llm_study(spark, d):
    """Scores of the valid answers, how many were invalid or asked, and the words sent and received, summed over the whole log. [A30 J14 Q10]"""
    g, replies = C.gold(spark, d), C._replies(spark, d)
    answers = report.parse_replies(replies, g)
    scores = score.prf(score.predictions(g, report.reply_pieces(answers.where("valid")), C.seen_forms(spark, d))).select("precision", "recall", "f1", "n_words")
    asked = answers.agg(F.count("*").alias("n_sample"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
    tokens = replies.agg(F.sum(F.size(F.split("reply", "\n")).cast("long")).alias("input_tokens"), F.sum(F.size(F.split("reply", "[: +\n]+")).cast("long")).alias("output_tokens"))
    return scores.crossJoin(asked).crossJoin(tokens)  # one row each


QUERIES = {
    f.__name__: f
    for f in (
        lines_source, article_slice, split_sink, tagged_source, legacy_tagged_source, transitions_sink, gold_source_csv, merge_model_source, l2w_model_source, unigram_model_source, run_records_source,
        vocab_upsert, metrics_with_probe, answers_log, report_csv, train_summary, surface_pos_join, training_windows, learning_rates, prompts, formatted_cells, tex_macros, figure_frames, llm_study,
    )
} | {f"legacy_{part}_merges_k8": _legacy(part) for part in ("both", "transitions", "penalties")}

# ------------------------------------------------------------------------------------ SQL twins

_SEED_VOCAB = " UNION ALL ".join(f"SELECT {s}::BIGINT AS seed, lang, unnest(tokens) AS token FROM seg{s}" for s in SEEDS)
_SIGNS = O.sql(O.PARAS, "SELECT DISTINCT unnest(string_split(replace(text, ' ', '▁'), '')) AS token FROM paras")

ORACLES = {
    "lines_source": r"SELECT line, count(*) AS n FROM (SELECT trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\s+', ' ', 'g')) AS line FROM conversations) WHERE line <> '' GROUP BY line",
    "article_slice": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn BETWEEN 11 AND 60",
    "split_sink": f"SELECT lang, split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({O.ORACLES['corpus_dedupe_split']}) GROUP BY ALL",
    "tagged_source": O.sql(O.PARAS, O.WORDS, O.TAGGED, "SELECT upos, count(*) AS n, sum(length(surface))::BIGINT AS chars FROM tagged GROUP BY upos"),
    "legacy_tagged_source": O.ORACLES["legacy_sentence_transitions"],
    "transitions_sink": O.ORACLES["pos_transitions"],
    "gold_source_csv": O.ORACLES["gold_items"],
    "merge_model_source": f"""WITH m AS MATERIALIZED ({O.ORACLES['bpe_merges_k8']}), known AS (SELECT token FROM ({_SIGNS}) UNION SELECT l || r FROM m)
SELECT 'merge' AS kind, rank, l || ' ' || r AS value FROM m UNION ALL SELECT 'vocab', -1, token FROM known UNION ALL SELECT 'joined', rank, l || r FROM m UNION ALL SELECT 'config', -1, '0 1000'""",
    "l2w_model_source": O.ORACLES["l2w_segment"],
    "unigram_model_source": O.sql(O.PARAS, "c AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(replace(text, ' ', '▁'), '')) AS token FROM paras) GROUP BY token)", "SELECT token, round(ln(n / sum(n) OVER ()), 6) AS logprob FROM c"),
    "run_records_source": O.sql(*O.RUNS, "SELECT lang, method, seed::BIGINT AS seed, budget::BIGINT AS budget, metric, round(value, 6) AS value FROM runs"),
    "vocab_upsert": O.sql(O.PARAS, O.SEQ, *O.seed_parts(), f"SELECT seed, count(DISTINCT token) AS tokens, count(*) AS n FROM ({_SEED_VOCAB}) WHERE lang = 'en' GROUP BY seed"),
    "metrics_with_probe": f"WITH bits AS MATERIALIZED ({O.ORACLES['ngram_bits_per_char']}), r AS ({O.sql(*O.RUNS, 'SELECT * FROM runs')}) SELECT lang, method, budget::BIGINT AS budget, seed::BIGINT AS seed, round(value, 6) AS tokens_per_word, bits_per_char FROM r JOIN bits USING (lang) WHERE metric = 'tokens_per_word' AND method = 'free' AND seed = 0 AND budget = {BUDGETS[-1]}",
    "answers_log": O.ORACLES["latest_answer"],
    "report_csv": O.sql(*O.VOCABS, f"SELECT *, 'seed0' AS model FROM {O.length_stats('va')} UNION ALL SELECT *, 'seed1' FROM {O.length_stats('vb')}"),
    "train_summary": f"""WITH m AS MATERIALIZED (SELECT * FROM ({O.weighted_merges(legacy='both')}) WHERE rank < 4), k AS ({_SIGNS})
SELECT (SELECT count(*) FROM (SELECT token FROM k UNION SELECT l || r FROM m)) AS vocab_size, (SELECT count(*) FROM m) AS num_merges, true AS timed""",
    "surface_pos_join": O.sql(O.PARAS, O.WORDS, O.TAGGED, f"best AS (SELECT surface, upos FROM (SELECT surface, upos, row_number() OVER (PARTITION BY surface ORDER BY count(*) DESC, upos) AS rn FROM tagged WHERE NOT {O.HELD} GROUP BY surface, upos) WHERE rn = 1)", f"SELECT coalesce(b.upos, 'X') AS pos, count(*) AS n FROM (SELECT surface FROM words WHERE {O.HELD}) w LEFT JOIN best b USING (surface) GROUP BY 1"),
    "training_windows": O.sql(*O.IDS, """flow AS MATERIALIZED (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, para_idx, i) - 1 AS place, CASE WHEN token IS NULL THEN 0 ELSE coalesce(id, 1) END AS id
  FROM (SELECT lang, doc_id, para_idx, unnest(list_append(tokens, NULL)) AS token, unnest(range(0, len(tokens) + 1)) AS i FROM seg) LEFT JOIN ids USING (token)),
starts AS (SELECT lang, sample, ('0x' || left(md5('0:' || lang || ':' || sample), 8))::BIGINT % (total - 129) AS start FROM (SELECT lang, count(*) AS total FROM flow GROUP BY lang), range(0, 16) s(sample) WHERE total > 129)""",
        "SELECT s.lang, s.sample, s.start, count(*) AS n, sum(f.id)::BIGINT AS total FROM starts s JOIN flow f ON f.lang = s.lang AND f.place >= s.start AND f.place < s.start + 128 GROUP BY ALL"),
    "learning_rates": "SELECT i AS step, round(0.0003 * least(1.0, (least(i, 250) + 1) / 100.0) * 0.5 * (1 + cos(3.141592653589793 * least(i, 250) / 250.0)), 12) AS rate FROM range(0, 301) t(i)",
    "prompts": O.sql(O.PARAS, O.WORDS, O.TAGGED, O.GOLD, "b AS (SELECT word, left(md5(word), 1) AS part, (row_number() OVER (PARTITION BY left(md5(word), 1) ORDER BY word) - 1) // 40 AS batch FROM gold)",
        "SELECT part, batch, 'Segment these English words into morphemes with +, one per line as word: seg+ment' || chr(10) || string_agg(word, chr(10) ORDER BY word) AS prompt FROM b GROUP BY part, batch"),
    "formatted_cells": f"SELECT lang, replace(concat_ws('_', method, metric, budget), '_', chr(92) || '_') AS name, printf('%.1f$' || chr(92) || 'pm$%.1f', mean * 100, sd * 100) AS cell, format('{{:,}}', round(mean * 1000000)::BIGINT) AS number FROM ({O.ORACLES['run_metrics_mean_sd']})",
    "tex_macros": O.sql(O.PARAS, "SELECT DISTINCT chr(92) || 'newcommand{' || chr(92) || 'nParagraphs' || upper(left(lang, 1)) || substring(lang, 2) || '}{' || format('{:,}', n) || '}' AS line FROM (SELECT lang, count(*) AS n FROM paras GROUP BY lang)"),
    "figure_frames": f"""WITH h AS ({O.sql(*O.VOCABS, 'SELECT length(token) AS size, count(*) AS n FROM va GROUP BY 1')}), m AS ({O.ORACLES['bpe_merges_k8']}), b AS ({O.sql(*O.RUNS, f"SELECT lang, method, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM runs WHERE {O.LAST} GROUP BY ALL")}),
p AS ({O.ORACLES['boundary_prf_subsets']}), s AS ({O.sql(*O.RUNS, "SELECT lang, method, budget, round(avg(value), 6) AS mean FROM runs WHERE metric = 'tokens_per_word' GROUP BY ALL")})
SELECT 'lengths' AS figure, '' AS panel, '' AS series, size::VARCHAR AS x, n::DOUBLE AS y, 0.0::DOUBLE AS spread FROM h UNION ALL SELECT 'merges', '', '', rank::VARCHAR, n::DOUBLE, 0.0 FROM m UNION ALL SELECT 'bars', '', method, lang, mean, sd FROM b
UNION ALL SELECT 'precision_recall', subset, '', printf('%.6f', recall), precision, 0.0 FROM p UNION ALL SELECT 'sweep', lang, method, budget::VARCHAR, mean, 0.0 FROM s""",
    "llm_study": f"""WITH s AS ({O.ORACLES['llm_prf']}), a AS ({O.ORACLES['llm_reply_parse']}), l AS ({O.sql(O.PARAS, O.WORDS, O.REPLIES, 'SELECT * FROM lines')})
SELECT precision, recall, f1, n_words, (SELECT count(*) FROM a) AS n_sample, (SELECT count(*) FROM a WHERE NOT valid) AS invalid, (SELECT count(*) FROM l) AS input_tokens,
  (SELECT sum(n)::BIGINT FROM (SELECT len(string_split_regex(string_agg(word || ': ' || segmentation, chr(10) ORDER BY line), '[: +' || chr(10) || ']+')) AS n FROM l GROUP BY reply_id)) AS output_tokens FROM s""",
} | {f"legacy_{part}_merges_k8": O.weighted_merges(legacy=part) for part in ("both", "transitions", "penalties")}
