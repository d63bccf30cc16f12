"""Merges, encodings, stem boundaries and the unigram model against plain versions."""

import random

from pyspark.sql import functions as F

from lexweave.operators import bpe, l2w, symbols, unigram

M = "▁"


def seqs(spark, texts, tags=None):
    tags = tags or [["X"] * len(t.split(" ")) for t in texts]
    df = spark.createDataFrame(list(zip(texts, tags, strict=True)), "text string, tags array<string>")
    return df.withColumn("seq", symbols.sequence_of(F.col("text")))


def plain(texts, steps):
    rows, found = [list(t.replace(" ", M)) for t in texts], []
    for _ in range(steps):
        counts = {}
        for r in rows:
            for p in zip(r, r[1:]):  # noqa: B905
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        found.append((a, b, counts[a, b]))
        rows = [merge(r, a, b) for r in rows]
    return found


def merge(row, a, b):
    out, i = [], 0
    while i < len(row):
        if row[i : i + 2] == [a, b]:
            out.append(a + b)
            i += 2
        else:
            out.append(row[i])
            i += 1
    return out


def slow_encode(text, merges):
    rank, row = {m: k for k, m in enumerate(merges)}, list(text.replace(" ", M))
    while True:
        known = [rank[p] for p in zip(row, row[1:]) if p in rank]  # noqa: B905
        if not known:
            return row
        row = merge(row, *merges[min(known)])


def corpus(seed, n=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abca") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_merge_is_left_to_right(spark):
    df = spark.createDataFrame([("aaa",), ("abab",)], "text string").select(symbols.sequence_of(F.col("text")).alias("s"))
    assert [r[0] for r in df.select(symbols.merged(F.col("s"), "a", "a")).collect()][0] == "⟨aa⟩⟨a⟩"
    assert [r[0] for r in df.select(symbols.merged(F.col("s"), "a", "b")).collect()][1] == "⟨ab⟩⟨ab⟩"
    counts = symbols.pair_counts(df.limit(1).withColumnRenamed("s", "seq")).collect()
    assert [(r["l"], r["r"], r["n"]) for r in counts] == [("a", "a", 2)]


def test_three_trainers_agree(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        want = plain(texts, 12)
        rows = seqs(spark, texts)
        assert [(r["l"], r["r"], r["n"]) for r in bpe.native(rows, 6).collect()] == want[:6]
        assert bpe.batched(rows, 12) == want
        alphabet = len({c for t in texts for c in t})
        got = bpe.train([(t.split(" "), ["X"] * len(t.split(" "))) for t in texts], alphabet + 12)
        assert [(a, b, s // 10**9) for a, b, s in got] == want


def test_weighted_scores(spark):
    table = spark.createDataFrame([("DET", "NOUN", 0.75)], "pos_l string, pos_r string, p double")
    classes = symbols.classed_pairs(seqs(spark, ["ab a"], [["DET", "NOUN"]]))
    score = lambda **w: {(r["l"], r["r"]): r["score"] / 1e9 for r in symbols.weighted(classes, table, **w).collect()}
    assert score() == {("a", "b"): 1, ("b", M): 1, (M, "a"): 1}
    assert score(beta=1, factor=980) == {("a", "b"): 1, ("b", M): 1.715, (M, "a"): 0.98}
    assert score(content=("DET",))["a", "b"] == 2 and score(content=("NOUN",))["a", "b"] == 1
    none = table.limit(0)
    assert symbols.weighted(classes, none, beta=1, factor=980).where("l = 'b'").first()["score"] == 989_800_000
    assert symbols.legacy_scores(classes, none).where("l = 'b'").first()["score"] == 1_568_000_000


def test_weighted_trainers_agree(spark):
    texts = corpus(5)
    rng = random.Random(9)
    tags = [[rng.choice(["NOUN", "DET", "VERB"]) for _ in t.split(" ")] for t in texts]
    rows = seqs(spark, texts, tags)
    from lexweave.operators.text import transitions

    for method in ("pos", "pos_content"):
        spec = {k: v for k, v in bpe.METHODS[method].items() if k != "kind"}
        native = [(r["l"], r["r"], r["score"]) for r in bpe.native_weighted(rows, transitions(rows), 5, **spec).collect()]
        alphabet = len({c for t in texts for c in t})
        assert bpe.train([(t.split(" "), g) for t, g in zip(texts, tags, strict=True)], alphabet + 5, method) == native


def test_encoding_equals_the_slow_rule(spark):
    texts = corpus(3)
    merges = [(a, b) for a, b, _ in plain(texts, 15)]
    rows = seqs(spark, texts + ["", "zzz", "a"])
    got = rows.select("text", symbols.tokens_of(symbols.encoded(F.col("seq"), merges)).alias("t")).collect()
    assert all(r["t"] == slow_encode(r["text"], merges) and "".join(r["t"]) == r["text"].replace(" ", M) for r in got)


def test_breaks_are_not_merged(spark):
    df = spark.createDataFrame([(["re", "do"],)], "p array<string>").select(symbols.encoded(symbols.with_breaks(F.col("p")), [("e", "d"), ("r", "e")]).alias("s"))
    assert df.select(symbols.tokens_of(F.col("s"))).first()[0] == ["re", "d", "o"]


def test_word_merges_stay_in_words(spark):
    types = spark.createDataFrame([("ab", 3), ("abc", 2), ("b", 9)], "word string, freq long")
    got = [(r["l"], r["r"], r["n"]) for r in bpe.native_words(types, 3).collect()]
    assert got == [(M, "b", 9), ("a", "b", 5), (M, "ab", 5)]
    assert bpe.train_words({"ab": 3, "abc": 2, "b": 9}, 7) == got


def test_affix_rule(spark):
    lex = spark.createDataFrame([("known", [2])], "form string, cuts array<int>")
    parts = spark.createDataFrame([("suffix", "ing", 20), ("suffix", "ng", 20), ("prefix", "re", 20)], "kind string, affix string, n long")
    words = spark.createDataFrame([("rewalking",), ("king",), ("being",), ("Known",)], "word string")
    got = {r["word"]: (r["cuts"], r["pieces"]) for r in l2w.segment(words, lex, parts).collect()}
    assert got == {"rewalking": ([2, 6], ["re", "walk", "ing"]), "king": ([], ["king"]), "being": ([3], ["bei", "ng"]), "Known": ([2], ["Kn", "own"])}


def test_unigram_learns_frequent_pieces(spark):
    types = spark.createDataFrame([("walking", 50), ("talking", 40), ("walked", 30), ("talked", 30), ("a", 5)], "word string, freq long")
    pieces = dict(unigram.train(types, 30))
    assert len(pieces) <= 30 and {M, "a", "w", "k"} <= set(pieces)
    longest = max(map(len, pieces))
    assert "".join(unigram.best_pieces(M + "walking", pieces, longest)) == M + "walking"
    assert len(unigram.best_pieces(M + "walking", pieces, longest)) <= 4


def test_grid_trains_every_model(spark):
    rows = [("en", m, s, i, 0, t.split(" "), ["X"] * len(t.split(" "))) for m in ("bpe", "word_bpe") for s in (0, 1) for i, t in enumerate(corpus(s))]
    samples = spark.createDataFrame(rows, "lang string, method string, seed int, doc_id long, para_idx long, words array<string>, tags array<string>")
    got = bpe.grid(samples, 12).collect()
    assert {(r["method"], r["seed"]) for r in got} == {(m, s) for m in ("bpe", "word_bpe") for s in (0, 1)}
    assert [(r["l"], r["r"]) for r in sorted(got, key=lambda r: r["rank"]) if r["method"] == "bpe" and r["seed"] == 1] == [(a, b) for a, b, _ in plain(corpus(1), 8)]


def test_expected_counts_equal_all_segmentations():
    import itertools
    import math

    score = {"▁": -2.0, "a": -1.0, "b": -1.5, "▁a": -1.2, "ab": -0.7, "ba": -2.5}
    types = [("ab", 3), ("aba", 2), ("b", 1), ("c", 5)]
    want: dict = {}
    for word, freq in types:
        w, ways = M + word, []
        for n in range(len(w)):
            for at in itertools.combinations(range(1, len(w)), n):
                parts = [w[a:b] for a, b in zip((0, *at), (*at, len(w)), strict=True)]
                if all(p in score for p in parts):
                    ways.append((parts, math.exp(sum(score[p] for p in parts))))
        for parts, p in ways:
            for part in parts:
                want[part] = want.get(part, 0) + freq * p / sum(x for _, x in ways)
    got = unigram.counted(types, score)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tokenizers_encode_columns(spark):
    from lexweave.operators.tokenizers import Merges, Unigram

    df = spark.createDataFrame([("ab b",), ("",), (None,)], "t string")
    free, words = Merges([("a", "b"), ("ab", M)], "ab"), Merges([(M, "a")], "ab", words=True)
    pieces = Unigram({M: -3.0, "a": -1.0, "b": -1.0, M + "ab": -1.5})
    rows = df.select(free.encode(F.col("t")).alias("f"), words.encode(F.col("t")).alias("w"), pieces.encode(F.col("t")).alias("p")).collect()
    assert (rows[0]["f"], rows[0]["w"], rows[0]["p"]) == (["ab" + M, "b"], [M + "a", "b", M, "b"], [M + "ab", M, "b"])
    assert rows[2]["f"] is None and free.vocab() == ["a", "ab", "ab" + M, "b", M]


def test_breaks_stay_in_training():
    got = bpe.train([(["a␀b", "a␀b"], ["X", "X"])], 5)
    assert ("a", "b") not in [(l, r) for l, r, _ in got] and ("b", M) in [(l, r) for l, r, _ in got]


def test_grid_scores_cover_every_cell(spark):
    from lexweave.plans.cells import QUERIES

    rows = QUERIES["grid_scores"](spark, "/root/testdata/sf0.001").collect()
    assert {r["method"] for r in rows} == set(bpe.METHODS) and len(rows) == 4 * 8 * 6
    assert all(r["value"] is not None and r["value"] >= 0 for r in rows)
