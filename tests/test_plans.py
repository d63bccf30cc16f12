"""That costly steps stand once in a plan and run once a distinct form, and that quick forms of a step equal the slow ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import passes, symbols, text
from lexweave.plans import catalogue
from lexweave.plans.models import MERGES

SF = "/root/testdata/sf0.001"


def optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


@pytest.mark.parametrize("name", ["gold_items", "l2w_lexicon", "surface_majority_pos"])
def test_words_are_counted_before_rules_run(spark, name):
    lowest = optimized(catalogue.QUERIES[name](spark, SF))
    scanned = "\n".join(lowest[max(k for k, line in enumerate(lowest) if "Aggregate" in line) + 1 :])
    for costly in ("mente", "[^\\p{L}", "instr", "^[\\p{L}"):
        assert costly not in scanned


def test_gold_parts_are_found_once(spark):
    assert "\n".join(optimized(catalogue.gold_items(spark, SF))).count("mente,keit") <= 2


def test_lines_are_squeezed_once(spark):
    assert "\n".join(optimized(catalogue.paragraph_extract(spark, SF))).count("u2028") == 1


def test_texts_are_cut_once(spark):
    plan = optimized(catalogue.bpe_encode(spark, SF))
    assert "\n".join(plan).count("tokens(") == 1 and not any("Filter" in line and "tokens(" in line for line in plan)


def test_kinds_equal_tagged_words(spark):
    paras = spark.createDataFrame([(1, "en", 0, "Paris sees Paris, (the) -- cities 3 Walking"), (2, "en", 0, "Walking to Paris")], "doc_id long, lang string, para_idx long, text string")
    want = text.tagged_words(paras).groupBy("surface", "upos", "lemma").agg(F.count("*").alias("n"))
    got = text.tagged_types(paras).groupBy("surface", "upos", "lemma").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cut_equals_wrapped_symbols(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("then ioas ") for _ in range(rng.randrange(60))).strip() for _ in range(200)]
    odd = [None, "", "a", "the ⟨th⟩ then", "the ", "th␀e", "😀the 😀", "▁the▁ t"]
    merges = [*MERGES, ("a", "a"), ("zz", "z"), ("t", "he▁")]
    rows = spark.createDataFrame([(t,) for t in texts + odd], "text string")
    both = rows.select(passes.cut(F.col("text"), merges).alias("a"), symbols.tokens_of(symbols.encoded(symbols.sequence_of(F.col("text")), merges)).alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_array_passes_equal_wrapped_symbols(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("aab😀é") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["", "a", "aaaa aaa", "▁a b"]
    tags = [[rng.choice(["NOUN", "DET"]) for _ in t.split(" ")] for t in texts]
    rows = spark.createDataFrame(list(zip(texts, tags, strict=True)), "text string, tags array<string>").repartition(3)
    merges = [("a", "a"), ("a", "▁"), ("aa", "a▁"), ("é", "😀"), ("▁", "b"), ("zz", "z")]
    seq = rows.withColumn("seq", symbols.encoded(symbols.sequence_of(F.col("text")), merges))
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(passes.pair_counts(rows, merges), symbols.pair_counts(seq))
    kept = passes.tagged_texts(rows)
    assert same(passes.classed_pairs(kept, merges), symbols.classed_pairs(seq))
    classes, table = passes.classes_and_transitions(kept)
    assert same(classes, symbols.classed_pairs(rows.withColumn("seq", symbols.sequence_of(F.col("text")))))
    assert same(table, text.transitions(rows)) and same(passes.transitions(kept), text.transitions(rows))


def test_long_batches_are_taken_in_stretches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(passes, "STRETCH", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", "", "défgh ij", "k", "lm"])], ["text"])
    found = [([*map(len, p.column(0).to_pylist())], "".join("|" if s < 0 else names[s] for s in symbols_)) for symbols_, names, _, p in passes._stretches(batch)]
    assert [s for _, s in found] == ["abc||", "défgh▁ij|", "k|lm|"]


@pytest.mark.parametrize("name", ["adjacent_pair_counts", "pair_scores_pos"])
def test_symbols_are_counted_before_the_shuffle_in_arrays(spark, name):
    plan = "\n".join(optimized(catalogue.QUERIES[name](spark, SF)))
    assert "Generate explode(transform(" not in plan and "MapInArrow" in plan


def test_seeds_are_counted_in_one_pass(spark):
    from lexweave.operators import score, vocab

    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("the ions") for _ in range(6)).split()) or "t" for _ in range(80)]
    rows = spark.createDataFrame([(rng.choice(["en", "es", None]), t, rng.random() < 0.4) for t in texts], "lang string, text string, held boolean").repartition(3)
    models = {0: list(MERGES), 1: list(MERGES[3:])}
    cut = rows.select("lang", "text", "held", *[passes.cut(F.col("text"), m).alias(f"t{k}") for k, m in models.items()])
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    for k in models:
        want = vocab.vocabulary(cut.select("lang", F.col(f"t{k}").alias("tokens")), "lang")
        assert same(passes.vocabularies(rows, models).where(F.col("seed") == k).drop("seed"), want)
    sums = passes.agreements(rows, models).select("lang", "a", "b", F.round(2 * F.col("both") / (2 * F.col("both") + F.col("apart")), 6).alias("agreement"))
    assert same(sums, score.agreements(cut, {0: "t0", 1: "t1"}))
    known = rows.where("lang IS NOT NULL")
    want = vocab.held_out_bits(cut.where("lang IS NOT NULL").withColumnRenamed("t0", "tokens"))
    assert same(vocab.bits_of(passes.ended_pairs(known, models[0]), known), want)
    for name in ("seed_jaccard", "seed_agreement", "ngram_bits_per_char"):
        plan = "\n".join(optimized(catalogue.QUERIES[name](spark, SF)))
        assert "MapInArrow" in plan and "Generate explode(tokens" not in plan


def test_few_rows_are_ranked(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("lang"), F.md5(F.col("id").cast("string").cast("binary")).alias("key"), "id").union(spark.createDataFrame([("c", "ff", -1)], "lang string, key string, id long"))
    first = text.first_by_key(rows, 1500)
    want = {}
    for r in rows.collect():
        want.setdefault(r["lang"], []).append(r["key"])
    got = first.collect()
    assert {(r["lang"], r["key"], r["rn"]) for r in got} == {(k, x, i + 1) for k, v in want.items() for i, x in enumerate(sorted(v)[:1500])}
    # What is ranked is what a window over the plan's last filter sees: hardly more than what is taken.
    plan = "\n".join(optimized(first))
    assert "_last" in plan[plan.index("row_number") :]


def test_sizes_count_the_symbols(spark):
    rows = spark.createDataFrame([(t,) for t in ("the then in the end", "", None, "aaa a", "th th")], "text string")
    models = [MERGES[:2], MERGES[:9], (("a", "a"),), MERGES]
    got = rows.select(passes.sizes(F.col("text"), models).alias("n"), *[passes.cut(F.col("text"), m).alias(f"t{k}") for k, m in enumerate(models)]).collect()
    assert all(r["n"] == (None if r["t0"] is None else [len(r[f"t{k}"]) for k in range(4)]) for r in got)
    assert "⟩⟨" not in "\n".join(optimized(catalogue.run_metrics_mean_sd(spark, SF)))
