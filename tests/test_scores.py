"""Boundary scores, compression, spans, vocabularies and reports on rows with known answers; sources and sinks; streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexweave.operators import report, score, vocab
from lexweave.sources import tables
from lexweave.streaming import counts


def test_prf(spark):
    rows = spark.createDataFrame([([4], [2, 4], 3.0, 3), ([2, 6], [2], 1.0, 2), ([], [3], 1.0, 2)], "cuts array<int>, pred array<int>, freq double, n_pieces int")
    r = score.prf(rows).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.666667, 0.571429)
    assert (r["weighted_precision"], r["weighted_recall"], r["weighted_f1"]) == (0.5, 0.8, 0.615385)
    assert (r["n_words"], r["tokens_per_word"]) == (3, 2.333333)
    nothing = score.prf(rows.where("n_pieces = 3").withColumn("pred", F.array().cast("array<int>")).withColumn("cuts", F.array().cast("array<int>"))).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0.0, 0.0, 0.0)


def test_compression_and_spans(spark):
    rows = spark.createDataFrame([("en", ["of▁the▁", "c", "at"], ["of", "the", "cat"], ["ADP", "DET", "NOUN"])], "lang string, tokens array<string>, words array<string>, tags array<string>")
    table = spark.createDataFrame([("ADP", "DET", 0.5), ("DET", "NOUN", 0.25)], "pos_l string, pos_r string, p double")
    r = score.compression(rows, table).first()
    assert (r["tokens_per_word"], r["chars_per_token"], r["share_leading_marker"]) == (1.0, 2.666667, 0.0)
    assert (r["share_trailing_marker"], r["share_cross_word"], r["boundaries_absorbed"], r["mean_transition_p_all"]) == (0.333333, 0.333333, 1.0, 0.375)
    assert score.spans(rows, table).first()["share_span"] == 1.0 and score.spans(rows, table, strict=True).first()["share_span"] == 0.0
    assert {(x["what"], x["value"]) for x in score.top_spanned(rows).collect()} == {("token", "of▁the▁"), ("transition", "ADP->DET")}
    first = spark.createDataFrame([("en", ["▁of", "▁the"], ["of", "the"], ["ADP", "DET"])], rows.schema)
    assert score.boundaries(first).first()["token"] == "▁the"


def test_agreement(spark):
    a = spark.createDataFrame([(1, "en", ["ab", "▁cde", "fgh"])], "i long, lang string, tokens array<string>")
    b = spark.createDataFrame([(1, "en", ["ab▁", "cd", "efgh"])], "i long, lang string, tokens array<string>")
    assert score.agreement(a, b, ("i",)).first()["agreement"] == 0.666667


def test_vocabularies(spark):
    make = lambda ts: spark.createDataFrame([(t, 1) for t in ts], "token string, n long")
    a, b = make(["▁", "a", "b", "ab"]), make(["▁", "a", "c", "abc"])
    r = vocab.report(a, b, "x").first()
    assert (r["jaccard"], r["avg_len"], r["entropy"], r["kl"]) == (0.333333, 1.333333, 0.918296, 13.948676)
    both = a.withColumn("seed", F.lit(0)).union(b.withColumn("seed", F.lit(1)))
    assert tuple(vocab.overlap(both, "seed").first()) == (0, 1, 2, 6, 0.333333)
    apart = make(["a"]).withColumn("seed", F.lit(0)).union(make(["b"]).withColumn("seed", F.lit(1)))
    assert vocab.overlap(apart, "seed").first()["jaccard"] == 0.0
    ids = {r["token"]: r["id"] for r in vocab.ids(a).collect()}
    assert ids == {"a": 2, "ab": 3, "b": 4, "▁": 5}
    rows = spark.createDataFrame([(1, ["a", "zz"])], "k long, tokens array<string>")
    assert sorted((r["i"], r["id"]) for r in vocab.id_rows(rows, vocab.ids(a), "k").collect()) == [(0, 2), (1, 1), (2, 0)]


def test_windows(spark):
    rows = spark.createDataFrame([("en", 1, 0, ["t"] * 199), ("en", 2, 0, ["t"] * 99)], "lang string, doc_id long, para_idx long, tokens array<string>")
    assert sorted((r["window"], r["n"]) for r in vocab.windows(rows).collect()) == [(0, 128), (1, 128), (2, 43)]


def test_bits(spark):
    rows = spark.createDataFrame([("en", ["a"], "a")], "lang string, tokens array<string>, text string")
    # Two transitions, each seen once of once, with a vocabulary of two and the unknown.
    assert vocab.ngram_bits(rows, rows).first()["bits_per_char"] == round(-2 * math.log2(2 / 4) / 2, 6)


def test_reports(spark):
    rows = [("en", m, s, b, "f1", v + s / 10) for m, v in (("x", 0.4), ("y", 0.5)) for s in (0, 1) for b in (8, 16)]
    runs = spark.createDataFrame([*rows, ("es", "x", 0, 8, "f1", 0.2)], "lang string, method string, seed int, budget int, metric string, value double")
    got = {(r["lang"], r["method"], r["budget"]): (r["mean"], r["sd"]) for r in report.mean_sd(runs, "lang", "method", "budget").collect()}
    assert got["en", "x", 8] == (0.45, 0.070711) and got["es", "x", 8] == (0.2, 0.0)
    assert {r["lang"]: r["method"] for r in report.best(runs).collect()} == {"en": "y", "es": "x"}
    assert {r["lang"]: r["method"] for r in report.best(runs, higher_better=False).collect()} == {"en": "x", "es": "x"}
    assert {r["method"]: (r["en"], r["es"]) for r in report.by_language(runs, ["en", "es"]).collect()} == {"x": (0.45, 0.2), "y": (0.55, None)}
    assert {(r["runs"], r["cells"]) for r in report.runs_per_cell(runs).collect()} == {(2, 4), (1, 1)}
    assert report.by_budget(runs, [8, 16]).columns == ["lang", "method", "b8", "b16"]
    assert report.tex_rows(runs.limit(1).select("lang", "seed"), ["lang", "seed"]).first()["line"].endswith(r" \\")


def test_replies(spark):
    replies = spark.createDataFrame([(1, "cats: cat+z\ncats: cat+s\ncats: kat+s\ndog: d-og\nnote\ncow: cow")], "reply_id long, reply string")
    wanted = spark.createDataFrame([("cats",), ("dog",)], "word string")
    found = {r["word"]: (r["segmentation"], r["valid"]) for r in report.parse_replies(replies, wanted).collect()}
    assert found == {"cats": ("cat+s", True), "dog": ("d-og", False)}
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "word string, at long, seg string")
    assert {r["word"]: r["seg"] for r in report.latest(log, "word", "at").collect()} == {"a": "z", "b": "w"}
    assert [r["word"] for r in report.missing(wanted, log, "word").orderBy("word").collect()] == ["cats", "dog"]


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "lines.txt").write_text(" a  b \n\n c\n", encoding="utf-8")
    assert [r["line"] for r in tables.read_lines(spark, f"{p}/lines.txt").collect()] == ["a b", "c"]
    tables.write_split(spark.createDataFrame([("en", "t", "train")], "lang string, text string, split string"), f"{p}/split")
    assert spark.read.parquet(f"{p}/split").where("split = 'train'").count() == 1
    tagged = spark.createDataFrame([(1, 0, 1, "b", "X", "b", 2, 3), (1, 0, 0, "a", "DET", "a", 0, 1)], "doc_id long, para_idx long, k long, surface string, upos string, lemma string, start long, end long")
    tables.write_tagged(tables.tagged_paragraphs(tagged), f"{p}/tagged")
    back = tables.read_tagged(spark, f"{p}/tagged").first()
    assert back["text"] == "a b" and [w["surface"] for w in back["words"]] == ["a", "b"]
    (tmp_path / "legacy.json").write_text(json.dumps([[{"word": "a", "pos": "DET"}], []]))
    assert tables.read_legacy_tagged(spark, f"{p}/legacy.json").count() == 2
    assert tables.read_transitions(spark, f"{p}/none").count() == 0
    tables.write_transitions(spark.createDataFrame([("A", "B", 1, 1.0)], "pos_l string, pos_r string, n long, p double"), f"{p}/trans")
    assert tables.read_transitions(spark, f"{p}/trans").first()["p"] == 1.0
    (tmp_path / "gold.csv").write_text("wordform,preceding_part,stem\nNA,,null\n")
    assert tuple(tables.read_gold(spark, f"{p}/gold.csv").first()) == ("NA", "", "null")
    merges = spark.createDataFrame([("m", 1, "ab", "c"), ("m", 0, "a", "b")], "model_id string, rank long, l string, r string")
    tables.write_model(merges, f"{p}/model")
    assert tables.read_model(spark, f"{p}/model", "m") == [("a", "b"), ("ab", "c")]
    rows = spark.createDataFrame([("en", 1), ("es", 2)], "lang string, v long")
    tables.upsert(rows, f"{p}/up", ["lang"])
    tables.upsert(spark.createDataFrame([("es", 3)], "lang string, v long"), f"{p}/up", ["lang"])
    assert {(r["lang"], r["v"]) for r in spark.read.parquet(f"{p}/up").collect()} == {("en", 1), ("es", 3)}
    run = {"lang": "en", "method": "bpe", "seed": 0, "vocab_budget": 8000, "heldout": {"tokens_per_word": 1.5}, "morph": {"lexicon": {"all": {"f1": 0.4, "n_words": 3}}}}
    for name in ("bpe_v8000_s0", "bpe_v8000_other"):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "metrics.json").write_text(json.dumps(run, indent=1))
    runs = tables.read_runs(spark, f"{p}/runs/*/metrics.json")
    long = {(r["variant"], r["subset"], r["metric"]): r["value"] for r in tables.long_runs(runs).collect()}
    assert long["heldout", "all", "tokens_per_word"] == 1.5 and long["lexicon", "all", "f1"] == 0.4
    answer = spark.createDataFrame([("w", "w", True, "m")], tables.ANSWER)
    for _ in range(2):
        tables.append_answers(answer, f"{p}/answers")
    assert spark.read.schema(tables.ANSWER).json(f"{p}/answers").count() == 2
    tables.write_report([rows, rows.select("v", "lang")], f"{p}/report")
    assert spark.read.option("header", True).csv(f"{p}/report").count() == 4


def test_streams_equal_batches(spark, tmp_path):
    from lexweave.operators import symbols, text

    rows = [("The cat sat on the mat", "2024-01-01 00:00:00"), ("A dog and the cat", "2024-01-01 02:00:00")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "text string, at string").selectExpr("text", "cast(at AS timestamp) AS at").write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema("text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for name, made, want in (
        ("pos", counts.transition_counts(stream), text.transitions(text.word_arrays(batch)).drop("p")),
        ("sym", counts.symbol_pair_counts(stream), symbols.pair_counts(batch.select(symbols.sequence_of(F.col("text")).alias("seq")))),
    ):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(spark.table(name).collect()) == sorted(want.collect())
    counts.transition_counts(stream, "at").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("late").where("window.start = timestamp '2024-01-01 00:00:00'").count() > 0


@pytest.mark.parametrize("strict", [False, True])
def test_example_picks(spark, strict):
    gold = spark.createDataFrame([(f"wordform{c}", [4], "test") for c in "abcde"], "word string, cuts array<int>, split string")
    seg = spark.createDataFrame([(f"wordform{c}", ["word", f"form{c}"]) for c in "abcde"], "word string, pieces array<string>")
    seen = spark.createDataFrame([("wordformc",)] if strict else [], "form string")
    got = {r["word"][-1] for r in score.example_picks(seg, gold, seen).collect()}
    assert got == ({"a", "d", "e"} if strict else {"a", "c", "e"})
