"""Near duplicates against a brute-force join, and components against union-find."""

import inspect
import random
import re
from math import comb

import pytest

from lexweave.llm import near_dedup
from lexweave.llm.components import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k=4, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(edits):
        base[rng.randrange(size)] = rng.choice(words)
    return base


def fixture():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(12):
        base = family(rng, words, rng.randrange(30, 120), 0)
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, " ".join(copy)))
            at += 1
    shared = " ".join(rng.choice(words) for _ in range(25))
    for _ in range(60):  # a passage that many texts share makes large nodes
        rows.append((at, shared + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))))
        at += 1
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(60):  # a large group of near copies, each with its own edits
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(80)] = rng.choice(words)
        rows.append((at, " ".join(copy)))
        at += 1
    odd = [None, "", " \t\n", "One", "one", "one two three", "ONE  two\nthree", "one two", "a b c d", "a b c d", "a b c d e", "é a b c", "É a b c", "x " * 20_000]
    return rows + [(at + k, t) for k, t in enumerate(odd)]


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS label", "3 AS kept")
    found = near_dedup.cluster(docs.repartition(5), k=k, small=8).collect()
    truth = brute(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == truth
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = near_dedup.cluster(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, "A b c d e")], "doc_id long, text string")
    found = sorted(near_dedup.cluster(docs).collect(), key=str)
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in found if r["doc_id"]) == [(7, 7, True), (7, 7, True), (9, 7, False)]
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)]
    assert near_dedup.cluster(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r["id"]: r["root"] for r in found} == {x: find(x) for x in root} and len(found) == len(root)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketch_seldom_refuses_a_pair_at_the_threshold(spark):
    slack = inspect.signature(near_dedup.cluster).parameters["slack"].default
    rows = [(d, 0, [0] * 8, [sum(1 << 4 * b for b in range(16) if 16 * w + b < d) for w in range(8)]) for d in range(0, 129)]
    pairs = spark.createDataFrame(rows, "d int, x int, p array<long>, q array<long>")
    pairs = pairs.selectExpr("d", "struct(100L AS n, p AS packed) AS p", "struct(100L AS n, q AS packed) AS q")
    most = max(r["d"] for r in pairs.where(near_dedup._promising("p", "q", 80, slack)).collect())
    chance = 0.2 * 15 / 16
    assert sum(comb(128, d) * chance**d * (1 - chance) ** (128 - d) for d in range(most + 1, 129)) < 1e-5


def test_one_row_of_each_class_stays(spark):
    w = " ".join(f"w{i}" for i in range(40))
    other = "other words that are here alone"
    rows = [(1, w, "a"), (1, w, "a"), (1, w, "b"), (2, w + " x", "c"), (None, w, "d"), (None, other, "e"), (None, other, "e"), (3, "p q r s t u v", "f"), (3, "k l m n o p q r", "g"), (4, "", "h"), (4, "", "h"), (5, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "1 AS h", "2 AS row", "3 AS kept")
    out = near_dedup.representatives(docs, k=5)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(1, w), (0, other), (3, "p q r s t u v"), (3, "k l m n o p q r"), (4, ""), (5, "")])
    assert near_dedup.representatives(docs.limit(0)).count() == 0


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.cluster(docs).collect()}
    assert found == {i: c for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}
