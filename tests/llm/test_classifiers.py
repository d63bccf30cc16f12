"""Toxicity, language identification, quality and secrets: held-out accuracy and edge cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import langid, quality, secret_scan, toxicity
from lexweave.llm.common import held_out

SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, " \n\t"), (900004, "12 34"), (900005, "word " * 30_000), (900006, "word")]


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_is_crc32(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == crc_held_out(r["id"]) for r in rows)


def odd_rows(spark):
    return spark.createDataFrame(ODD + [(None, "no id"), (900006, "word")], "doc_id long, text string")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.classify(docs.select("doc_id", "text").union(odd_rows(spark)), labels).collect()
    assert len(found) == docs.count() + len(ODD) + 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["doc_id"] in truth and r["held_out"]]
    assert sum(p for p, t in held if not t) == 0
    assert sum(p for p, t in held if t) >= 0.6 * sum(t for _, t in held)


def test_toxicity_swaps_identities():
    assert toxicity.swapped("no group here") == []
    first, neutral = toxicity.swapped("Muslim men came. The rest.")
    assert "christian women" in first and "people people" in neutral


def test_toxicity_counterfactuals_take_the_bias_away(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]

    def text(*extra):
        return " ".join([*rng.choice(words, 12), *extra])

    rows = [(text("muslim", "vile"), 1) for _ in range(120)] + [(text("christian"), 0) for _ in range(120)] + [(text("vile"), 1) for _ in range(60)] + [(text(), 0) for _ in range(300)]
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    probe = ["the muslim neighbours cook", "the christian neighbours cook"]
    plain, fair = (toxicity.fit(labelled, strength=s).logits(probe) for s in (0.0, 10.0))
    assert abs(fair[0] - fair[1]) < 0.2 * abs(plain[0] - plain[1])
    assert toxicity.fit(labelled, strength=10.0).logits(["a vile thing"])[0] > 1


def test_toxicity_query_uses_the_penalty(spark):
    rng = np.random.default_rng(8)
    words = [f"mot{i}" for i in range(80)]
    terms = {1: "musulmans", 0: "chrétiens"}
    docs = [(i, " ".join(rng.choice(words, 15)) + (f". Les {terms[i % 2]} sont là." if i % 3 else "") + (" vile" if i % 2 else "")) for i in range(600)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    probe = spark.createDataFrame([(9000, "Les musulmans chantent."), (9001, "Les chrétiens chantent.")], "doc_id long, text string")
    scores = {}
    for strength in (0.0, 10.0):
        found = {r["doc_id"]: r["score"] for r in toxicity.classify(rows.union(probe), labels, strength=strength).collect()}
        scores[strength] = found[9000] - found[9001]
    assert scores[0.0] > 0.1 and abs(scores[10.0]) < 0.3 * scores[0.0]
    assert toxicity.mentioning("x", {}) == [] and sum(len(toxicity.mentioning(t)) for _, t in docs) > 80


def test_toxicity_without_labels_or_rows(spark):
    docs = odd_rows(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), none).count() == 0
    clash = toxicity.score(docs.selectExpr("*", "1 AS score", "2 AS other"), toxicity.Model(np.empty(0, np.uint32), np.empty(0), 0.0))
    assert clash.columns == ["doc_id", "held_out", "score", "other", "predicted"]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    found = langid.learn_and_identify(docs).collect()
    held = [r for r in found if crc_held_out(r["doc_id"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.96
    assert np.mean([r["rejected"] for r in found]) < 0.02


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.identify(odd_rows(spark).selectExpr("*", "1 AS score", "'x' AS lang_pred"), model).collect()}
    for i in (900001, 900002, 900003, 900004):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[900005]["lang_pred"] in model.languages and 0 <= got[900005]["score"] <= 1
    empty = langid.learn(docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in langid.identify(odd_rows(spark), empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_quality_prefers_good_text_and_draws_k(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.resample(docs, labels, keep=0.8).collect()}
    assert sum(r["selected"] for r in found.values()) == round(0.8 * len(found))
    ordered = sorted(found.values(), key=lambda r: -r["key"])
    assert all(r["selected"] for r in ordered[: round(0.8 * len(found))])
    rate = {q: np.mean([found[r["doc_id"]]["selected"] for r in labels.where(f"quality = {q}").collect()]) for q in (0, 1)}
    assert rate[1] > 0.9 and rate[0] < 0.2


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.resample(odd_rows(spark), labels, keep=0.5).collect()
    assert {r["log_weight"] for r in found} == {0.0} and len(found) == len(ODD) + 2
    assert quality.resample(odd_rows(spark).limit(0), labels).count() == 0
    assert not any(r["selected"] for r in quality.resample(odd_rows(spark), labels, keep=0.0).collect())


@pytest.mark.parametrize("k", [1, 7, 250, 300])
def test_kth_largest(spark, k):
    keyed = spark.range(300).selectExpr("cast(id % 50 as double) as key", "id as doc_id")
    rows = sorted(((r["key"], r["doc_id"]) for r in keyed.collect()), key=lambda r: (-r[0], r[1]))
    assert quality.kth_largest(keyed, k, bins=8, few=3) == rows[k - 1]
    assert quality.kth_largest(keyed, 301) is None


def test_secrets_on_findings_and_texts(spark):
    model = secret_scan.fit(secret_scan.findings(spark, 2500))
    token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [
        (1, f'😀 token = "{token}" end'),
        (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixes it"),
        (3, "see src/handler/controller/manager/index for more"),
        (4, "internationalisationally speaking"),
        (5, None),
        (6, ""),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS start")
    found = secret_scan.scan(docs, model).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in found] == [(1, 11, 51)]
    assert secret_scan.scan(docs.limit(0), model).count() == 0
    other = secret_scan.described(secret_scan.findings(spark, 1200, seed=99))
    assert other.groupBy("secret").count().count() == 2


def test_secrets_of_other_shapes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    likely = secret_scan.transitions(docs)
    assert len(likely) == 37**2 and likely[37 * 20 + 8] > likely[37 * 17 + 24]  # th is likelier than qx
    model = secret_scan.fit(secret_scan.findings(spark), likely)
    texts = [(1, 'password = "aB3!xK9%" done'), (2, "api_key: Zk8Qw2LpX9vR"), (3, "page=chapter-12 of it"), (4, "room: handler-204 upstairs"), (5, "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" " + "plain words " * 100_000), (5, "nothing")]
    found = {r["doc_id"] for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), model, likely).collect()}
    assert found == {1, 2, 5}


def test_transitions_count_every_pair_of_every_text(spark):
    long = "".join(chr(97 + i * i * 7 % 26) + "é" * (i % 3) + "😀" * (i % 5 == 0) for i in range(9_000)) + "Zq" * 50
    texts = [(1, None), (2, ""), (3, "x"), (4, "é"), (5, long), (5, long), (None, "K9 ß\nİx"), (6, "a" * 4096 + "qz"), (7, "7" * 4097)]
    texts += [(i, f"J{i}x") for i in range(10, 3_010)]
    n = np.ones((37, 37))
    for _, t in texts:
        signs = [secret_scan.SIGNS.find(x) + 1 for x in (t or "").lower()]
        np.add.at(n, (signs[:-1], signs[1:]), 1)
    table = secret_scan.transitions(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert np.allclose(table, np.log(n / n.sum(1, keepdims=True)).ravel(), rtol=0, atol=1e-12)
    assert set(secret_scan.transitions(spark.createDataFrame([], "doc_id long, text string"))) == {math.log(1 / 37)}


def test_secrets_in_documents_match_their_pattern(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secret_scan.fit(secret_scan.findings(spark))
    found = {(r["doc_id"], r["start"], r["end"]) for r in secret_scan.scan(docs, model).collect()}
    truth = {(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"])}
    assert truth <= found and len(found - truth) <= 2
