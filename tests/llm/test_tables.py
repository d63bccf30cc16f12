"""Mixing, sharding, fingerprints, decontamination and personal data against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb

from lexweave.llm import decontaminate, fingerprint, mixing, pii, queries, sharding

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ mixing


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by rounds: clamp, share again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        asked = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if asked[s] > most * sizes[s]]
        if not over:
            return target | asked
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, docs):
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += words(text)
    target, taken = filled(sizes), Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) <= 1e-6 * max(1, target[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1.001


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    first = mixing.mix(docs).collect()
    check_mix(first, rows)
    assert sorted(first) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_mixing_edges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "é", "Z", "big", "big", "big"]), " w" * rng.randrange(0, 9)) for i in range(300)]
    rows += [(1000, "one", "x " * 5001), (1001, "none", ""), (1002, "none", None), (1003, "one", None), (1003, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS whole", "3 AS row")
    check_mix(mixing.mix(docs).collect(), rows)
    made = mixing.materialised(docs)
    assert made.columns == docs.columns
    got, want = Counter(), Counter()
    for r in made.collect():
        got[r["doc_id"]] += words(r["text"])
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    assert {1001, 1002} <= set(got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.materialised(docs.limit(0)).count() == 0


def test_mixing_equals_its_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None, "é", "Z", "big", "big", "big"]), "\u00a0w\x1c \x0b" * rng.randrange(0, 9)) for i in range(400)]
    rows += [(1000, "one", "x " * 5001), (1001, "none", ""), (1002, "none", None), (1003, "one", None), (1004, "𐐷", "y"), (1005, "\ue000", "y z")]
    edges, empty = str(tmp_path / "edges"), str(tmp_path / "empty")
    made = spark.createDataFrame(rows, "doc_id long, source string, text string")
    made.coalesce(1).write.parquet(f"{edges}/documents.parquet")
    made.limit(0).coalesce(1).write.parquet(f"{empty}/documents.parquet")
    for folder, files in ((SF, "documents.parquet"), (edges, "documents.parquet/*.parquet"), (empty, "documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{files}'")
        want = con.execute(queries.ORACLES["op2_mixing"])
        names = [c[0] for c in want.description]
        assert sorted(queries.op2_mixing(spark, folder).select(*names).collect()) == sorted(want.fetchall())


# ---------------------------------------------------------------- sharding


def test_shards_are_even_and_slots_gapless(spark):
    found = queries.op7_sharding(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bounded_loads_move_few_rows(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    place = {}
    for n in (24, 25):
        rows = sharding.assign(docs, shards=n, epsilon=0.3, cell_rows=50).collect()
        place[n] = {r["doc_id"]: r["shard"] for r in rows}
        loads = Counter(place[n].values())
        assert max(loads.values()) <= 1.3 * 6000 / n + 1
    moved = sum(place[24][i] != place[25][i] for i in range(6000))
    assert moved < 0.2 * 6000


def plain_ring(ids, shards, virtual, seed, hashes):
    """Each key's own shard on the ring, by a walk over the points."""
    points = sharding._points(shards, virtual, seed)
    return {i: next((s for p, s in points if p >= hashes[i] >> (64 - sharding.RING_BITS)), points[0][1]) for i in ids}


def test_rows_stay_at_their_point_where_there_is_room(spark):
    from pyspark.sql import functions as F

    docs = spark.range(400).selectExpr("id AS doc_id", "concat('t', id) AS text")
    hashes = {r["doc_id"]: r["h"] % (1 << 64) for r in docs.select("doc_id", F.xxhash64(F.lit(3), F.col("doc_id")).alias("h")).collect()}
    own = plain_ring(hashes, 8, 16, 3, hashes)
    found = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards=8, virtual=16, epsilon=20.0).collect()}
    assert found == own
    tight = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards=8, virtual=16, epsilon=0.2).collect()}
    counts, most = Counter(own.values()), int(1.2 * 400 / 8)
    assert max(Counter(tight.values()).values()) <= most
    assert sum(tight[i] != own[i] for i in own) == sum(max(0, n - most) for n in counts.values())


def test_many_shards_end(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    counts = Counter(r["shard"] for r in sharding.assign(docs, shards=1000).collect())
    assert len(counts) == 1000 and set(counts.values()) == {20}
    assert len(sharding._points(1000, 64, 3)) == 64_000


def test_sharding_edges(spark):
    rows = [(None, None), (None, "x"), (5, ""), (5, ""), (5, "é"), *[(i, "t" * i) for i in range(10, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS arc", "3 AS rank")
    found = sharding.assign(docs, shards=4, keep=("text", "arc", "rank")).collect()
    loads = Counter(r["shard"] for r in found)
    assert len(found) == len(rows) and max(loads.values()) - min(loads.values()) <= 1
    assert all(r["arc"] == 2 and r["rank"] == 3 for r in found)
    assert len({(r["shard"], r["slot"]) for r in found}) == len(rows)
    assert sharding.assign(docs.limit(0)).count() == 0
    assert sharding.assign(docs.limit(2), shards=24).count() == 2


# ------------------------------------------------------------ fingerprints


def test_fingerprints_are_multiset_sums():
    pieces = ["one.\n", "two! ", "three\n", "three\n", ""]
    a, b = fingerprint.Hash().add(pieces), fingerprint.Hash().add(pieces[::-1])
    assert a.text() == b.text() and fingerprint.likeness(a, b) == 1
    more = a.copy().add(["four\n"])
    assert more.text() != a.text() and more.add(["four\n"], -1).text() == a.text()
    assert "".join(fingerprint.paragraphs("A b. C d!\n\ne")) == "A b. C d!\n\ne"
    assert set(fingerprint.of("").text()) == {"0"}
    rng = random.Random(1)
    for n in (20, 400, 5000):
        base = [f"p{rng.random()}\n" for _ in range(n)]
        for share in (0.1, 0.5, 1.0):
            other = [f"q{rng.random()}\n" if rng.random() < share else p for p in base]
            truth = len(set(base) & set(other)) / len(set(base) | set(other))
            assert abs(fingerprint.likeness(fingerprint.Hash().add(base), fingerprint.Hash().add(other)) - truth) < 0.45


def edited_rows(rows):
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        yield i, t, n, t[: len(t) - q] + n[:q]


def test_fingerprints_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in fingerprint.with_next(docs.repartition(3), buckets=13).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(found) == len(rows)
    for i, t, n, e in edited_rows(rows):
        r = found[i]
        own, new = fingerprint.of(t), fingerprint.of(e)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.text(), new.text())
        assert r["near_edited"] == fingerprint.likeness(own, new) and r["near_next"] == fingerprint.likeness(own, fingerprint.of(n))
    assert len({r["fingerprint"] for r in found.values()}) == len({t for _, t in rows})


def test_fingerprint_edges(spark):
    rows = [(1, None), (2, ""), (5, "x😀é" * 3), (9, "a" * 200_000), (10, "same.\n"), (11, "same.\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS n_chars")
    found = {r["doc_id"]: r for r in fingerprint.with_next(docs).collect()}
    for i, t, _, e in edited_rows(rows):
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
    assert found[10]["near_next"] == 1 and found[1]["near_next"] == 1
    assert fingerprint.with_next(docs.limit(0)).count() == 0
    one = fingerprint.with_next(docs.where("doc_id = 10")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert fingerprint.with_next(ties).count() == 3


def test_likeness_of_very_long_texts():
    for n in (4_000, 16_000, 100_000):
        base, other = ([f"{side} {n} {i}" for i in range(n // 4)] for side in ("old", "new"))
        same = fingerprint.Hash().add([f"kept {n} {i}" for i in range(n - n // 4)])
        assert abs(fingerprint.likeness(same.copy().add(base), same.copy().add(other)) - 0.6) < 0.2


# --------------------------------------------------------- decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        assert decontaminate.edit_distance(item, text) == plain_distance(item, text)


def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(docs, items, block_items=15).collect()}
    texts = {r["doc_id"]: decontaminate.normalised(r["text"]) for r in docs.collect()}
    truth = {(i, r["item_id"]) for i, t in texts.items() for r in items.collect() if decontaminate.normalised(r["text"]) in t}
    assert truth == {k for k, d in found.items() if d == 0}
    clean = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert clean == set(texts) - {i for i, _ in found}


def test_edited_leaks_are_found(spark):
    rng = random.Random(6)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(list(enumerate(items)))
    for rate, least in ((0.0, 1.0), (0.04, 0.98), (0.1, 0.9)):
        hits = 0
        for n in range(150):
            i = n % len(items)
            text = list(items[i])
            for _ in range(int(rate * len(text))):
                text[rng.randrange(len(text))] = rng.choice(["", "x", "yz"])
            document = decontaminate.normalised("Some words before it. " + "".join(text) + " and some after")
            hits += any(k == i for _, k, _ in index.leaks([document]))
        assert hits >= least * 150


def test_decontamination_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item.upper() + "!"), (3, item), (4, "word " * 40_000 + item), (None, item), (6, "tiny")], "doc_id long, text string").selectExpr("*", "1 AS item_id")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "tiny"), (6, "A short item of words")], "item_id long, text string")
    found = sorted((r["doc_id"] or -1, r["item_id"], r["distance"]) for r in decontaminate.find(docs, items).collect())
    assert found == [(-1, 1, 0), (-1, 2, 0), (3, 1, 0), (3, 1, 0), (3, 2, 0), (3, 2, 0), (4, 1, 0), (4, 2, 0)]
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {1, 2, 6}
    assert decontaminate.find(docs, items.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), items).count() == 0


def test_exact_copies_are_found_at_every_word_offset():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(8, 15)))
    for least in (48, 55, 65, 80):
        items = []
        for _ in range(30):
            item = word()
            while len(item) < least:
                item += " " + word()
            items.append(item)
        index = decontaminate.Index(list(enumerate(items)))
        for before in range(4):
            texts = [" ".join([word() for _ in range(before)] + [item, word()]).encode() for item in items]
            assert {(d, i) for d, i, e in index.leaks(texts) if not e} >= {(i, i) for i in range(30)}


def test_copies_near_the_tolerance_are_found():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(n)) for n in (9, 12, 20, 30, 45, 60) for _ in range(6)]
    index, hits, tried = decontaminate.Index(list(enumerate(items))), 0, 0
    while tried < 200:
        i = rng.randrange(len(items))
        text = list(items[i])
        for _ in range(int(rng.uniform(0.15, 0.25) * len(text))):
            text[rng.randrange(len(text))] = rng.choice(["", "x", "yz"])
        document = decontaminate.normalised("Some words before " + "".join(text) + " and some after")
        if 0.15 * len(items[i]) <= decontaminate.edit_distance(items[i], document.decode()) <= int(0.2 * len(items[i])):
            tried += 1
            hits += any(k == i for _, k, _ in index.leaks([document]))
    assert hits >= 0.98 * tried


def test_many_edit_distances_equal_one_by_one():
    rng = random.Random(10)
    some = lambda n: "".join(rng.choice("abc\u00e9\u4e2d") for _ in range(n))
    pairs = [(some(rng.randrange(1, 200)), some(rng.randrange(0, 250))) for _ in range(400)]
    assert decontaminate.edit_distances(pairs) == [decontaminate.edit_distance(*p) for p in pairs]


def test_short_items_and_scripts_without_spaces():
    long = "\u6211\u4eec\u5728\u5317\u4eac\u7684\u56fe\u4e66\u9986\u91cc\u8bfb\u4e86\u5f88\u591a\u5173\u4e8e\u5386\u53f2\u548c\u54f2\u5b66\u7684\u4e66\u5e76\u4e14\u5199\u4e0b\u4e86\u7b14\u8bb0"
    items = [(1, long), (2, "tiny"), (3, "two words"), (4, "\u56fe\u4e66\u9986"), (5, "")]
    texts = ["\u6628\u5929\u4e0b\u5348" + long + "\u7136\u540e\u56de\u5bb6", "A tiny thing", "\u201ctiny\u201d", "tinyness two wordsmiths", "Here: two  words!", "", "\u8fd9\u4e2a\u56fe\u4e66\u9986\u5f88\u5927"]
    index = decontaminate.Index(items, least=1)
    found = {(d, index.ids[i]) for d, i, e in index.leaks([decontaminate.normalised(t) for t in texts]) if not e}
    assert found == {(0, 1), (0, 4), (1, 2), (2, 2), (4, 3), (6, 4)}


# ----------------------------------------------------------- personal data

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            bad = {"ip": kind == "ip" and any(int(x) > 255 for x in m[0].split(".")), "card": not (14 <= len(d) <= 19 and luhn(d or "0")), "phone": not 10 <= len(d) <= 15}.get(kind, False)
            if not bad:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data_keeps_base_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [
        (900000, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 😀 x@y.zz 256.1.1.1 +1 555 123 4567-"),
        (900001, None),
        (900002, ""),
        (900003, "mail me at john (at) example (dot) com or call (564) 555-4526 now; ip 10[.]0[.]0[.]1 card 4111.1111.1111.1111"),
        (900004, "1 " * 20_000 + "a" * 40_000 + "@" + "b.c" * 9000),
        (900005, "4111 1111-1111 1111 +1 (564) 555-4526, 001.02.3.255 0.0.0.00256 1.1.1.99999999999999999999"),
        (900006, "order 1234567890123 page 20240101101112 the at of dot in"),
    ]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 AS base", "2 AS spans")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert len(found) == len(texts)
    for i, t in texts.items():
        base, spans = base_spans(t), found[i]["spans"].split(",") if found[i]["spans"] else []
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(spans) and len(spans) == len(base) + found[i]["n_added"]
        assert [found[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s.startswith(k) for s in base) for k, _ in PATTERNS]
    assert found[900003]["spans"] == "email:11:38,phone:47:61,ip:70:84,card:90:109"
    assert found[900006]["spans"] == ""


def disguised(rng):
    """(text, spans that must be added) with disguised personal data, and texts with look-alikes."""
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    for _ in range(60):
        name, host = "".join(rng.choices("abcdefgh", k=6)), "".join(rng.choices("klmnop", k=5))
        number = card()
        yield from (
            ("please mail ", "email", f"{name} (at) {host} (dot) com"),
            ("contact us: ", "email", f"{name}[at]{host}[dot]org"),
            ("the server ip ", "ip", f"10[.]{rng.randrange(256)}[.]3[.]{rng.randrange(256)}"),
            ("host address ", "ip", f"192(dot)168(dot){rng.randrange(256)}(dot)7"),
            ("visa card ", "card", ".".join(number[k : k + 4] for k in range(0, 16, 4))),
            ("call me, phone ", "phone", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        )
        yield from (
            ("isbn ", None, f"{digits(3)}/{digits(1)}/{digits(6)}/{digits(3)}"),
            ("invoice ", None, digits(12)),
            ("order ", None, f"{digits(5)}.{digits(5)}.{digits(6)}"),
            ("date id ", None, digits(11)),
        )


def test_disguised_data_is_added(spark):
    rows = list(disguised(random.Random(12)))
    docs = spark.createDataFrame([(i, f"Some words {before}{what} and more.") for i, (before, _, what) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    right = wrong = 0
    for i, (before, kind, what) in enumerate(rows):
        at = len("Some words " + before)
        spans, base = set(found[i]["spans"].split(",")) - {""}, set(base_spans(f"Some words {before}{what} and more."))
        right += kind is not None and f"{kind}:{at}:{at + len(what)}" in spans - base
        wrong += len(spans - base - {f"{kind}:{at}:{at + len(what)}"})
    planted = sum(k is not None for _, k, _ in rows)
    assert right >= 0.9 * planted and wrong <= 0.05 * planted, (right, wrong, planted)


def test_texts_with_very_many_matches_take_linear_time(spark):
    texts = ["4111 1111 1111 1111, 12345 67890 +1 234 567 8901; " * 6000, "1234567 " * 40_000, "1" * 300_000, "12.34.56.789 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    found = {r["doc_id"]: (r["n_card"], r["n_phone"], r["n_ip"]) for r in pii.detect(docs).collect()}
    assert found == {0: (6000, 6000, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0)} and time.time() - began < 90


def test_personal_data_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(empty).count() == 0
    plain = spark.createDataFrame([(1, "nothing here"), (1, "nothing here"), (None, None)], "doc_id long, text string")
    assert [r["spans"] for r in pii.detect(plain).collect()] == ["", "", ""]
