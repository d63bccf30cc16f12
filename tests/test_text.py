"""Paragraphs, words, tags, alignment and transitions on small rows with known answers."""

from pyspark.sql import functions as F

from lexweave.functions import scalars as S
from lexweave.operators import text


def rows(spark, texts, lang="en"):
    return spark.createDataFrame([(i, lang, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def test_paragraphs_are_filtered_lines(spark):
    long = "word " * 60
    docs = rows(spark, [f"  {long}\n\n== {long}\n{{{{{long}\n| {long}\n* {long}\nshort\n" + "x" * 1501, "a  \x1c b " + long, None])
    found = text.paragraphs(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["para_idx"]) for r in found] == [(0, 0), (1, 0)]
    assert found[0]["text"] == long.strip() and found[1]["text"].startswith("a b word")


def test_split_takes_train_then_test_and_drops_copies(spark):
    paras = spark.createDataFrame([(i, "en", 0, f"text {i % 30}") for i in range(60)], "doc_id long, lang string, para_idx long, text string")
    found = text.dedupe_split(paras, train=20, test=6).collect()
    assert len({r["text"] for r in found}) == len(found) == 26
    assert sorted(r["split"] for r in found) == ["test"] * 6 + ["train"] * 20


def test_word_offsets_point_into_the_text(spark):
    paras = spark.createDataFrame([(1, "en", 0, "The cat, 😀 sat.")], "doc_id long, lang string, para_idx long, text string")
    for r in text.word_offsets(paras).collect():
        assert "The cat, 😀 sat."[r["start"] : r["end"]] == r["surface"]


def test_align_takes_the_first_token_that_is_no_punctuation(spark):
    words = spark.createDataFrame([(0, 0, 0, "Hello,", 0, 6), (0, 0, 1, "(world)!", 7, 15), (0, 0, 2, "--", 16, 18), (0, 0, 3, "gap", 19, 22)], "doc_id long, para_idx long, k long, surface string, start long, end long")
    tokens = spark.createDataFrame(
        [(0, 0, 0, "INTJ", "hello"), (0, 0, 5, "PUNCT", ","), (0, 0, 7, "PUNCT", "("), (0, 0, 8, "NOUN", "world"), (0, 0, 13, "PUNCT", ")"), (0, 0, 14, "PUNCT", "!"), (0, 0, 16, "PUNCT", "-")],
        "doc_id long, para_idx long, tok_start long, upos string, lemma string",
    )
    found = {r["surface"]: (r["upos"], r["lemma"]) for r in text.align(words, tokens).collect()}
    assert found == {"Hello,": ("INTJ", "hello"), "(world)!": ("NOUN", "world"), "--": ("PUNCT", "-"), "gap": ("X", "gap")}


def test_transitions_and_factors(spark):
    tags = [["DET", "NOUN", "VERB"], ["DET", "NOUN", "VERB"], ["DET", "NOUN"], ["DET", "ADJ", "NOUN"]]
    table = text.transitions(spark.createDataFrame([(t,) for t in tags], "tags array<string>"))
    assert {(r["pos_l"], r["pos_r"]): (r["n"], r["p"]) for r in table.collect()} == {("DET", "NOUN"): (3, 0.75), ("DET", "ADJ"): (1, 0.25), ("NOUN", "VERB"): (2, 1.0), ("ADJ", "NOUN"): (1, 1.0)}
    assert {r["key"]: r["factor"] for r in text.reward_factors(table).collect()} == {"DET->NOUN": 0.85, "DET->ADJ": 1.35, "NOUN->VERB": 0.65, "ADJ->NOUN": 0.65}


def test_surface_pos_is_the_majority(spark):
    tagged = spark.createDataFrame([("run", "VERB"), ("run", "VERB"), ("run", "NOUN"), ("a", "X"), ("a", "DET")], "surface string, upos string")
    assert {r["surface"]: (r["upos"], r["n"]) for r in text.surface_pos(tagged).collect()} == {"run": ("VERB", 2), "a": ("DET", 1)}


def test_stems(spark):
    pairs = [("walking", "walk"), ("hablo", "hablar"), ("unhappily", "happy"), ("rewalked", "walk"), ("cat", "cat"), ("went", "go")]
    df = spark.createDataFrame(pairs, "w string, l string").withColumn("span", F.expr(S.common_stem("w", "l"))).withColumn("cuts", F.expr(S.stem_cuts("span", "w")))
    found = {r["w"]: (tuple(r["span"]) if r["span"] else None, r["cuts"]) for r in df.collect()}
    assert found == {"walking": ((0, 4), [4]), "hablo": ((0, 4), [4]), "unhappily": ((2, 6), [2, 6]), "rewalked": ((2, 6), [2, 6]), "cat": ((0, 3), []), "went": (None, None)}


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        S.pieces(F.lit("rewalking"), F.array(F.lit(6), F.lit(2), F.lit(9), F.lit(0))).alias("pieces"), S.cuts_of(F.array(F.lit("▁un"), F.lit("▁"), F.lit("happy"))).alias("cuts"), S.is_word(F.lit("naïve")).alias("w"),
        S.is_word(F.lit("a1")).alias("n"), S.thousands(F.lit(1234567)).alias("t"), S.cell(F.lit(0.4), F.lit(0.016), 100.0).alias("cell"), S.learning_rate(F.lit(49), 100).alias("lr"), S.tex_escaped(F.lit("a_b%")).alias("tex"),
    ).first()
    assert got["pieces"] == ["re", "walk", "ing"] and got["cuts"] == [2, 7] and got["w"] and not got["n"]
    assert got["t"] == "1,234,567" and got["cell"] == "40.0$\\pm$1.6" and 0 < got["lr"] < 3e-4 and got["tex"] == "a\\_b\\%"
