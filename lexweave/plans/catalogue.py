"""Every registered query over the corpus tables; their SQL twins are in `oracles`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bpe, l2w, passes, report, score, symbols, text, unigram, vocab
from ..sources.tables import table
from .models import ANSWER_CUT, BUDGETS, MERGES, SEEDS, seed_merges, variants
from .oracles import ORACLES


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as long, arrays as text, so that both engines give the same columns."""
    kind = dict(df.dtypes)
    cast = {"int": lambda c: c.cast("long"), "float": lambda c: c.cast("double")}
    join = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return df.select(*[(join(F.col(c)) if kind[c].startswith("array") else cast.get(kind[c], lambda x: x)(F.col(c))).alias(c) for c in df.columns])


def paras(spark: SparkSession, d: str) -> DataFrame:
    return text.paragraphs(table(spark, d, "documents"))


def tagged(spark, d):
    return text.tagged_words(paras(spark, d))


def tagged_types(spark, d):
    return text.tagged_types(paras(spark, d))


def arrays(spark, d):
    return text.word_arrays(paras(spark, d))


def sequences(spark, d):
    return arrays(spark, d).withColumn("seq", symbols.sequence_of(F.col("text")))


def segmented(rows: DataFrame, merges=MERGES) -> DataFrame:
    return S.once(rows, tokens=passes.cut(F.col("text"), merges))


def held_out(spark, d) -> DataFrame:
    return text.word_arrays(paras(spark, d).where(text.is_held_out()))


def training(spark, d) -> DataFrame:
    return paras(spark, d).where(~text.is_held_out())


def table_of(spark, d) -> DataFrame:
    return text.transitions(text.word_arrays(training(spark, d)))


def seen_forms(spark, d) -> DataFrame:
    """Distinct lower-case words of the training paragraphs. [A28]"""
    return training(spark, d).select(F.explode(F.split(F.lower("text"), " ")).alias("form")).distinct()


def gold(spark, d) -> DataFrame:
    return score.gold_items(score.gold_source(tagged_types(spark, d)))


def word_pieces(words: DataFrame, merges=MERGES) -> DataFrame:
    return S.once(words, pieces=passes.cut(F.col("word"), merges))


def predicted(spark, d) -> DataFrame:
    return score.predicted(word_pieces(gold(spark, d)), seen_forms(spark, d))


def lexicon_parts(spark, d):
    found = l2w.spans(text.tagged_types(training(spark, d)))
    return l2w.lexicon(found), l2w.affixes(found)


def distinct_words(spark, d) -> DataFrame:
    return S.once(symbols.word_types(paras(spark, d)), whole=S.is_word(F.col("word"))).where("whole").select("word")


def l2w_words(spark, d) -> DataFrame:
    lex, parts = lexicon_parts(spark, d)
    return l2w.segment(distinct_words(spark, d), lex, parts)


# ------------------------------------------------------------------------------------ queries


def paragraph_extract(spark, d):
    return flat(paras(spark, d))


def corpus_dedupe_split(spark, d):
    return text.dedupe_split(paras(spark, d))


def word_offsets(spark, d):
    return flat(text.word_offsets(paras(spark, d)))


def annotate_words(spark, d):
    return flat(tagged(spark, d))


def align_tags_interval_join(spark, d):
    p = paras(spark, d)
    return flat(text.align(text.word_offsets(p), text.annotator_tokens(p)))


def surface_majority_pos(spark, d):
    return text.surface_pos(tagged_types(spark, d))


def pos_transitions(spark, d):
    return text.transitions(arrays(spark, d))


def pos_reward_factors(spark, d):
    return text.reward_factors(text.transitions(arrays(spark, d)))


def legacy_sentence_transitions(spark, d):
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).select(S.squeezed(F.col("text")).alias("text")).where("text <> ''")
    return text.transitions(text.word_arrays(lines))


def event_transitions(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(order).alias("b")).where("b IS NOT NULL")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 9))


def symbol_sequence(spark, d):
    return flat(sequences(spark, d).select("doc_id", "para_idx", "seq"))


def adjacent_pair_counts(spark, d):
    return passes.pair_counts(paras(spark, d))


def _scores(**weights):
    def query(spark, d):
        classes, table_ = passes.classes_and_transitions(passes.tagged_texts(arrays(spark, d)))
        return symbols.weighted(classes, table_, **weights)

    return query


def pair_scores_legacy(spark, d):
    return symbols.legacy_scores(*passes.classes_and_transitions(passes.tagged_texts(arrays(spark, d))))


def bpe_merges_k8(spark, d):
    return bpe.native(paras(spark, d), 8)


def posbpe_merges_k8(spark, d):
    return bpe.native_weighted(arrays(spark, d), None, 8, beta=1, factor=980)


def content_bpe_merges_k8(spark, d):
    return bpe.native_weighted(arrays(spark, d), None, 8, content=bpe.METHODS["pos_content"]["content"])


def word_initial_bpe_merges_k8(spark, d):
    return bpe.native_words(symbols.word_types(paras(spark, d)), 8)


def bpe_merges_batched(spark, d):
    merges = bpe.batched(paras(spark, d), 32)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(merges)], "rank long, l string, r string, n long")


def bpe_encode(spark, d):
    rows = segmented(paras(spark, d))
    return flat(rows.select("doc_id", "para_idx", F.array_join("tokens", " ").alias("tokens")))


def encode_with_breaks(spark, d):
    rows = l2w_words(spark, d).select("word", symbols.encoded(symbols.with_breaks(F.col("pieces")), MERGES).alias("seq"))
    return rows.select("word", F.array_join(symbols.tokens_of(F.col("seq")), " ").alias("tokens"))


def l2w_lexicon(spark, d):
    return flat(lexicon_parts(spark, d)[0])


def l2w_affixes(spark, d):
    return lexicon_parts(spark, d)[1]


def l2w_segment(spark, d):
    return flat(l2w_words(spark, d))


def l2w_online_cuts(spark, d):
    words = tagged_types(spark, d).groupBy(F.col("surface").alias("word")).agg(F.min("lemma").alias("lemma"))
    words = S.once(words, whole=S.is_word(F.col("word"))).where("whole").drop("whole")
    return flat(l2w.online(words, l2w_words(spark, d)))


def lcs_stem(spark, d):
    pairs = F.expr("transform(sequence(1, size(words) - 1), i -> struct(lower(words[i - 1]) AS a, lower(words[i]) AS b))")
    rows = arrays(spark, d).where(F.size("words") > 1).select(F.explode(pairs).alias("x")).select("x.a", "x.b").distinct().where(S.is_word(F.col("a")) & S.is_word(F.col("b")))
    rows = rows.withColumn("span", F.expr(S.common_stem("a", "b"))).where("span IS NOT NULL")
    return flat(rows.select("a", "b", F.col("span.first").alias("first"), F.col("span.end").alias("last")))


def gold_items(spark, d):
    return flat(gold(spark, d))


def boundary_prf(spark, d):
    return score.prf(predicted(spark, d)).select("precision", "recall", "f1", "n_words", "tokens_per_word")


def boundary_prf_weighted(spark, d):
    return score.prf(predicted(spark, d)).select("weighted_precision", "weighted_recall", "weighted_f1", "n_words")


def boundary_prf_subsets(spark, d):
    return score.prf(score.subsets(predicted(spark, d)), "subset")


def compression_metrics(spark, d):
    return score.compression(segmented(held_out(spark, d)), table_of(spark, d))


def boundary_absorption(spark, d):
    found = score.boundaries(segmented(held_out(spark, d)).select("lang", "tokens", "words", "tags"))
    return found.groupBy("lang", "pos_l", "pos_r").agg(F.count("*").alias("n"), F.sum((F.length("token") > 1).cast("long")).alias("absorbed"))


def span_diagnostics(spark, d):
    return score.spans(segmented(held_out(spark, d)), table_of(spark, d))


def span_diagnostics_strict(spark, d):
    return score.spans(segmented(held_out(spark, d)), table_of(spark, d), strict=True)


def top_spanned(spark, d):
    return score.top_spanned(segmented(held_out(spark, d)))


def _seed_vocab(spark, d):
    """Vocabularies of all seeds from one scan."""
    return passes.vocabularies(paras(spark, d).where(text.is_held_out()), {s: seed_merges(s) for s in SEEDS})


def seed_jaccard(spark, d):
    return flat(vocab.overlap(_seed_vocab(spark, d), "seed", "lang"))


def seed_agreement(spark, d):
    rows = paras(spark, d).where(text.is_held_out())
    sums = passes.agreements(rows, {s: seed_merges(s) for s in SEEDS})
    return flat(sums.select("lang", "a", "b", F.round(2 * F.col("both") / (2 * F.col("both") + F.col("apart")), 6).alias("agreement")))


def _vocab(spark, d, merges):
    return vocab.vocabulary(segmented(paras(spark, d), merges))


def vocab_report(spark, d):
    return flat(vocab.report(_vocab(spark, d, MERGES), _vocab(spark, d, seed_merges(1)), "seed0"))


def vocab_kl(spark, d):
    return vocab.divergence(_vocab(spark, d, MERGES), _vocab(spark, d, seed_merges(1)))


def length_entropy(spark, d):
    return vocab.lengths(passes.vocabularies(paras(spark, d), {0: MERGES}), "lang")


def _runs(spark, d):
    """Run records: every language, method, budget and seed, a seed training on half of the paragraphs."""
    half = F.array_compact(F.array(*[F.when(F.substring(text.hash_key(s), 1, 1) < "8", F.lit(s)) for s in SEEDS]))
    rows = paras(spark, d).withColumn("words", F.size(F.split("text", " "))).withColumn("chars", F.length("text"))
    models = list(variants())
    names = [(method, budget, f"{method}_{budget}") for method, budget, _ in models]
    rows = rows.withColumn("sizes", passes.sizes(F.col("text"), [merges for _, _, merges in models]))
    n = [F.get("sizes", F.lit(i)).alias(name) for i, (_, _, name) in enumerate(names)]
    counts = rows.select("lang", "words", "chars", half.alias("seeds"), *n).withColumn("seed", F.explode("seeds"))
    sums = counts.groupBy("lang", "seed").agg(*[F.sum(c).alias(c) for c in ("words", "chars", *(name for _, _, name in names))])
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(b).alias("budget"), F.col(name).alias("n")) for m, b, name in names])
    wide = sums.select("lang", "seed", "words", "chars", F.explode(each).alias("x"))
    wide = wide.select("lang", "x.method", "seed", "x.budget", (F.col("x.n") / F.col("words")).alias("tokens_per_word"), (F.col("chars") / F.col("x.n")).alias("chars_per_token"))
    return report.unpivoted(wide, ["lang", "method", "seed", "budget"], ["tokens_per_word", "chars_per_token"])


def run_metrics_mean_sd(spark, d):
    return flat(report.mean_sd(_runs(spark, d), "lang", "method", "budget", "metric"))


def best_method(spark, d):
    return report.best(_runs(spark, d).where(f"metric = 'tokens_per_word' AND budget = {BUDGETS[-1]}"), higher_better=False)


def metric_pivot(spark, d):
    return report.by_language(_runs(spark, d).where(f"metric = 'tokens_per_word' AND budget = {BUDGETS[-1]}"), ["de", "en", "es", "fr"])


def budget_sweep(spark, d):
    return report.by_budget(_runs(spark, d).where("metric = 'tokens_per_word'"), list(BUDGETS))


def runs_per_cell(spark, d):
    return flat(report.runs_per_cell(_runs(spark, d)))


def data_statistics(spark, d):
    """Words in training and held-out paragraphs, and gold words: all, of the test split, and unseen in training. The gold words of this corpus have no language. [A26]"""
    g, seen = gold(spark, d).select("word", "split"), seen_forms(spark, d).select(F.col("form").alias("w"), F.lit(1).alias("known"))
    sizes = g.withColumn("w", F.lower("word")).join(seen, "w", "left").agg(F.count("*").alias("gold_words"), F.sum((F.col("split") == "test").cast("long")).alias("gold_test"), F.sum(F.col("known").isNull().cast("long")).alias("gold_unseen"))
    rows = paras(spark, d).withColumn("words", F.size(F.split("text", " "))).withColumn("held", text.is_held_out())
    counts = rows.groupBy("lang").agg(
        F.count("*").alias("paragraphs"), F.round(F.avg(F.when(~F.col("held"), F.col("words"))), 6).alias("mean_train_words"), F.sum(F.when(F.col("held"), F.col("words")).otherwise(0)).alias("test_words")
    )
    return counts.crossJoin(sizes)  # one row


def l2w_variant_report(spark, d):
    g, seg = gold(spark, d), l2w_words(spark, d)
    made = l2w.online(g.select("word", "lemma"), seg)
    online = made.select("word", S.pieces(F.col("word"), F.col("cuts")).alias("pieces"))
    seen = seen_forms(spark, d)
    rows = score.predictions(g, seg, seen).withColumn("variant", F.lit("lexicon")).unionByName(score.predictions(g, online, seen).withColumn("variant", F.lit("online")))
    table_ = score.prf(score.subsets(rows), "variant", "subset")
    long = report.unpivoted(table_, ["variant", "subset"], ["precision", "recall", "f1"])
    return long.groupBy("variant", "metric").pivot("subset", ["all", "seen", "test_split", "unseen"]).agg(F.round(F.avg("value"), 6))


def example_picks(spark, d):
    g = gold(spark, d)
    return score.example_picks(word_pieces(g).select("word", "pieces"), g, seen_forms(spark, d))


def token_ids(spark, d):
    return vocab.ids(vocab.vocabulary(segmented(training(spark, d))))


def token_id_stream(spark, d):
    """How often each id occurs in the held-out stream, unknown tokens and ends included. [J10]"""
    known = vocab.ids(vocab.vocabulary(segmented(training(spark, d))))
    rows = vocab.id_rows(segmented(held_out(spark, d)), known, "doc_id", "para_idx")
    return rows.groupBy("id").agg(F.count("*").alias("n"))


def ctx_windows(spark, d):
    return vocab.windows(segmented(held_out(spark, d)))


def ngram_bits_per_char(spark, d):
    rows = paras(spark, d).withColumn("held", text.is_held_out())
    return vocab.bits_of(passes.ended_pairs(rows, MERGES), rows)


def _replies(spark, d):
    """Replies of a made-up annotator: a line for every word of a paragraph, some of them wrong."""
    line = F.expr(f"transform(split(text, ' '), w -> concat(w, ': ', CASE WHEN left(md5(cast(concat(w, doc_id) AS binary)), 1) < '{ANSWER_CUT}' AND length(w) > 3 THEN concat(left(w, 3), '+', substr(w, 4)) WHEN length(w) > 4 THEN concat(left(w, 2), '+x') ELSE w END))")
    return paras(spark, d).select((F.col("doc_id") * 100_000 + F.col("para_idx")).alias("reply_id"), F.array_join(line, "\n").alias("reply"))


def llm_reply_parse(spark, d):
    return report.parse_replies(_replies(spark, d), gold(spark, d))


def llm_prf(spark, d):
    g = gold(spark, d)
    answers = report.reply_pieces(report.parse_replies(_replies(spark, d), g).where("valid"))
    return score.prf(score.predictions(g, answers, seen_forms(spark, d)))


def cache_antijoin(spark, d):
    test = paras(spark, d).where(text.is_held_out()).select(F.explode(F.split(F.lower("text"), " ")).alias("form"))
    return report.missing(test, seen_forms(spark, d), "form")


def latest_answer(spark, d):
    rows = _replies(spark, d).select("reply_id", F.posexplode(F.split("reply", "\n")).alias("line", "t"))
    rows = rows.select((F.col("reply_id") * 10_000 + F.col("line")).alias("at"), F.substring_index("t", ": ", 1).alias("word"), F.substring_index("t", ": ", -1).alias("segmentation"))
    return report.latest(rows, "word", "at")


def unigram_em(spark, d):
    pieces = unigram.train(symbols.word_types(paras(spark, d)), 300)
    return spark.createDataFrame(pieces, "token string, logprob double")


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_extract, corpus_dedupe_split, word_offsets, annotate_words, align_tags_interval_join, surface_majority_pos, pos_transitions, pos_reward_factors, legacy_sentence_transitions, event_transitions,
        symbol_sequence, adjacent_pair_counts, pair_scores_legacy, bpe_merges_k8, posbpe_merges_k8, content_bpe_merges_k8, word_initial_bpe_merges_k8, bpe_merges_batched, bpe_encode, encode_with_breaks,
        l2w_lexicon, l2w_affixes, l2w_segment, l2w_online_cuts, lcs_stem, gold_items, boundary_prf, boundary_prf_weighted, boundary_prf_subsets, compression_metrics, boundary_absorption, span_diagnostics,
        span_diagnostics_strict, top_spanned, seed_jaccard, seed_agreement, vocab_report, vocab_kl, length_entropy, run_metrics_mean_sd, best_method, metric_pivot, budget_sweep, runs_per_cell, data_statistics,
        l2w_variant_report, example_picks, token_ids, token_id_stream, ctx_windows, ngram_bits_per_char, llm_reply_parse, llm_prf, cache_antijoin, latest_answer, unigram_em,
    )
} | {"pair_scores_pos": _scores(beta=1, factor=980), "pair_scores_penalty": _scores(factor=980), "pair_scores_content": _scores(content=bpe.METHODS["pos_content"]["content"])}

__all__ = ["ORACLES", "QUERIES"]
