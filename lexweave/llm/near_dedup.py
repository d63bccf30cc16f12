"""Near duplicates by a chosen-path set similarity join.

A document is its set of word shingles. Documents with equal sets form one class from the start. Of
every class a minhash sketch is made, and its representative descends several independent trees:
at each node it takes `branches` paths, each named by one minhash coordinate that the node chooses
and the value found there, so similar sets share paths. A node with few sets is compared
exhaustively, larger ones branch on. Every pair with a sketch that may reach the threshold is
confirmed on the full sets.

What large groups of near copies would cost is saved by links already known: in each node, every set
is first compared with some members that share many paths, drawn anew in each of some rounds. Nodes whose sets are all
connected by then end there, and in the others only pairs across components are compared. No such
pair is dropped; it is only not needed when both are in one component.

A pair of similarity s survives a level with probability 1 - (1 - s * p)**branches, p being that of
the levels below: 0.94 at s = 0.8 with two branches, at any depth. With four independent trees a
pair at the threshold is missed about once in 80,000 times. All trees share one sketch, which refuses
such a pair with probability 8.7e-6 (exact binomial tail: more than 44 of 128 nibbles differ). Both
together miss a pair at the threshold about once in 47,000 times; 2.2e-6 of those at 0.81 are refused.

Defined results: null, empty and blank texts have no shingle and stay alone; a text with fewer words
than a shingle is one shingle; rows with the same doc_id must hold the same text; rows
without doc_id stay alone, with a null component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_pieces, mix, sweep, utf8, word_hashes, word_stream
from .components import components

COORDINATES, STORED = 128, 64
_GEN = np.random.default_rng(90125)
_ODD = _GEN.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_XOR = _GEN.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACE = _GEN.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
BITMAP = 1 << 25
#: Hashes that are worked on at once.
BLOCK = 1 << 16


def _distinct(full: np.ndarray) -> np.ndarray:
    """The sorted distinct values, in place."""
    full.sort()
    return full[np.concatenate((np.ones(min(1, len(full)), bool), full[1:] != full[:-1]))]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row, some at a time."""
    full = np.empty(max(0, len(words) - k + 1), np.uint64)
    for at in range(0, len(full), BLOCK):
        part = full[at : at + BLOCK]
        total = np.zeros(len(part), np.uint64)
        for j in range(k):
            total += words[at + j : at + j + len(part)] * _PLACE[j]
        part[:] = mix(total)
    return full


def _of_words(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) >= k:
        return _distinct(_shingles(words, k))
    if not len(words):
        return np.empty(0, np.uint64)
    # The number of words keeps a short text from equalling a shingle.
    words = np.append(words, np.uint64(len(words)))
    return mix((words * np.append(_PLACE[: len(words) - 1], _PLACE[15])).sum(keepdims=True, dtype=np.uint64))


def shingle_sets(texts, k: int = 4):
    """The sorted distinct shingle hashes of each text."""
    raw = utf8(texts)
    for a, b in in_pieces(raw):
        if b - a == 1:
            yield _of_words(np.concatenate([np.empty(0, np.uint64), *(h for h, *_ in word_stream(raw[a:b]))]), k)
            continue
        h, doc, _, _, _ = word_hashes(raw[a:b])
        first = np.searchsorted(doc, np.arange(b - a + 1))
        full = _shingles(h, k)
        for d in range(b - a):
            at, end = first[d], first[d + 1]
            yield _distinct(full[at : end - k + 1].copy()) if end - at >= k else _of_words(h[at:end], k)


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: STORED coordinates as int32, and four bits of all COORDINATES in eight int64."""
    low = np.full((len(sets), COORDINATES), ~np.uint64(0))
    parts = [(i, s[at : at + BLOCK]) for i, s in enumerate(sets) for at in range(0, len(s), BLOCK)]
    while parts:  # some at a time, whatever the size of a set
        n, size = 0, 0
        while n < len(parts) and (not n or size + len(parts[n][1]) <= BLOCK):
            size += len(parts[n][1])
            n += 1
        some, parts = parts[:n], parts[n:]
        flat, owner = np.concatenate([s for _, s in some]), np.array([i for i, _ in some])
        at = np.concatenate(([0], np.cumsum([len(s) for _, s in some])[:-1])).astype(np.int64)
        found = np.empty((COORDINATES, n), np.uint64)
        for j in range(COORDINATES):
            found[j] = np.minimum.reduceat((flat ^ _XOR[j]) * _ODD[j], at)
        np.minimum.at(low, owner, found.T)
    low = mix(low)
    stored = (low[:, :STORED] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    four = (low & np.uint64(15)).reshape(len(sets), 8, 16)
    packed = (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
    return np.ascontiguousarray(stored), np.ascontiguousarray(packed)


def sketches(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, n, d0, d1, coords, packed) of every document; the last four are null where n is 0. d0 and d1 name the set."""

    def run(batches):
        for pdf in batches:
            out = {c: [] for c in ("n", "d0", "d1", "coords", "packed")}
            held: list[np.ndarray] = []

            def flush():
                some = [s for s in held if len(s)]  # noqa: B023
                made = iter(zip(*sketch(some), strict=True)) if some else iter(())
                for s in held:  # noqa: B023
                    out["n"].append(len(s))  # noqa: B023
                    if not len(s):
                        for c in ("d0", "d1", "coords", "packed"):
                            out[c].append(None)  # noqa: B023
                        continue
                    coords, packed = next(made)
                    out["d0"].append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))  # noqa: B023
                    out["d1"].append(int(mix(s ^ _XOR[0]).sum(dtype=np.uint64).view(np.int64)))  # noqa: B023
                    out["coords"].append(coords)  # noqa: B023
                    out["packed"].append(packed)  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for s in shingle_sets(pdf["text"].tolist(), k):
                held.append(s)
                size += len(s)
                if size > BLOCK:
                    flush()
                    size = 0
            flush()
            frame = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": pd.array(out["n"], "Int64"), "d0": pd.array(out["d0"], "Int64"), "d1": pd.array(out["d1"], "Int64")})
            frame["coords"], frame["packed"] = out["coords"], out["packed"]
            yield frame

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, d0 long, d1 long, coords array<int>, packed array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, k: int):
    """(doc_id, shingles) of at least the documents in `ids` (id), and what was sent for it.

    The ids go to the readers as a bitmap of their hashes, of 4 MB whatever their number; it only
    spares work, and the joins that follow pick the rows. The caller destroys it when they are done."""
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("w")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("map"))
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for r in words.collect():  # BITMAP / 32768 rows of 4 KB at most
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        bitmap[(r["w"] - 1) * 4096 : (r["w"] - 1) * 4096 + len(part)] = part
    send = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        wanted = send.value
        for pdf in batches:
            b = pdf["bit"].to_numpy(np.int64)
            pdf = pdf[(wanted[b >> 3] >> (b & 7)) & 1 == 1]
            own, sets, size = [], [], 0
            for i, s in zip(pdf["doc_id"].tolist(), shingle_sets(pdf["text"].tolist(), k), strict=True):
                own.append(i)
                sets.append(s.view(np.int64))
                size += len(s)
                if size > 2 * BLOCK:  # no more at once than some texts or one long one
                    yield pd.DataFrame({"doc_id": own, "shingles": sets})
                    own, sets, size = [], [], 0
            if own:
                yield pd.DataFrame({"doc_id": own, "shingles": sets})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITMAP)).alias("bit"))
    return rows.mapInPandas(run, "doc_id long, shingles array<long>"), send


def _alike(a: str, b: str) -> Column:
    """Estimated similarity from the packed coordinates: a nibble is equal by chance once in 16 times."""
    different = F.lit(0)
    for i in range(8):
        x = F.col(f"{a}.packed")[i].bitwiseXOR(F.col(f"{b}.packed")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        different = different + F.bit_count(x)
    return ((1 - different / float(COORDINATES)) - 1 / 16) / (15 / 16)


def _promising(a: str, b: str, percent: int, slack: float) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (_alike(a, b) >= percent / 100 - slack)


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    pairs = checkpointed(pairs)
    sweep(docs.sparkSession)
    sets, sent = _full_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), k)
    sets = checkpointed(sets)
    sent.destroy()
    one = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    counted = two.select("u", "v", common.alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return checkpointed(counted.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("u", "v"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of nodes in which more than one component is left, with the node's size."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    # A table of its own, so that the join shuffles both sides and large nodes can be split.
    return rows.join(checkpointed(sizes.select("node", "size")), "node")


def _viable(docs: DataFrame, hot: DataFrame, brief: DataFrame, k: int, percent: int, slack: float, rare: int) -> tuple[DataFrame, DataFrame]:
    """Of large nodes whose sets do not part: the rows that may have a partner without a common rare shingle, and the pairs (u, v) with one.

    Rare shingles are those that at most `rare` sets of these nodes have. Sets that share one are paired
    by it, which makes few pairs. For all others the rare shingles bound the intersection, and exactly:
    copies of one text with many edits of their own, alike but not alike enough, go at once."""
    own = checkpointed(hot.select(F.col("rep").alias("doc_id"), "label").distinct())
    sets, sent = _full_sets(docs, own.select(F.col("doc_id").alias("id")), k)
    sets = checkpointed(sets.join(own.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    sent.destroy()
    each = sets.select(F.col("doc_id").alias("rep"), F.explode("shingles").alias("h"))
    # A shingle with one holder names it; only those with a few are joined back to theirs.
    held_by = checkpointed(each.groupBy("h").agg(F.count("*").alias("holders"), F.min("rep").alias("one")).where(F.col("holders") <= rare))
    scarce = checkpointed(each.join(held_by.where("holders > 1").select("h"), "h"))
    counts = held_by.where("holders = 1").groupBy(F.col("one").alias("rep")).agg(F.count("*").alias("c")).union(scarce.groupBy("rep").agg(F.count("*").alias("c")))
    private = counts.groupBy("rep").agg(F.sum("c").alias("private"))
    own = own.withColumnRenamed("doc_id", "rep")
    known = checkpointed(brief.join(own, "rep").join(private, "rep", "left").withColumn("private", F.coalesce("private", F.lit(0))))

    held = scarce.join(known.select("rep", "label", F.struct("n", "packed").alias("p")), "rep")
    a = held.select("h", F.col("rep").alias("u"), F.col("label").alias("lu"), "p")
    b = held.select("h", F.col("rep").alias("v"), F.col("label").alias("lv"), F.col("p").alias("q"))
    sharing = a.join(b, "h").where((F.col("u") < F.col("v")) & (F.col("lu") != F.col("lv")) & _promising("p", "q", percent, slack)).select("u", "v").distinct()

    known = known.drop("label")
    rows = hot.select("node", "rep", "label").join(known, "rep")
    least = rows.groupBy("node").agg(F.min("n").alias("least"))
    # Intersection >= percent / (100 + percent) of both sizes together.
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    rows = rows.join(least, "node").where((100 + percent) * (F.col("n") - F.col("private")) >= percent * (F.col("n") + partner))
    rows = checkpointed(rows.drop("least"))
    return _mixed(rows), sharing


def _met(rows: DataFrame, percent: int, slack: float, block: int = 400) -> DataFrame:
    """The pairs (u, v) of different components that meet in a node and may reach the threshold.

    Nodes are compared in blocks of about `block` rows against each other, so that no task gets a whole large node."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = ["node", "b1", "b2"]
    rows = rows.select("node", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "label", F.struct("n", "private", "packed").alias("p"))
    a = rows.select(*key, F.col("rep").alias("u"), F.col("label").alias("lu"), F.col("own").alias("ou"), F.col("p"))
    b = rows.select(*key, F.col("rep").alias("v"), F.col("label").alias("lv"), F.col("own").alias("ov"), F.col("p").alias("q"))
    met = (F.col("u") < F.col("v")) & (F.col("lu") != F.col("lv")) & ((F.col("b1") == F.col("b2")) | (F.col("ou") != F.col("ov")))
    most = F.least(F.col("p.n") - F.col("p.private"), F.col("q.n") - F.col("q.private"))
    bound = (100 + percent) * most >= percent * (F.col("p.n") + F.col("q.n"))
    return a.join(b, key).where(met & bound & _promising("p", "q", percent, slack)).select("u", "v").distinct()


def cluster(docs: DataFrame, *, k: int = 4, percent: int = 80, trees: int = 4, branches: int = 2, small: int = 40, depth: int = 4, rounds: int = 3, leads: int = 8, tries: int = 4, rare: int = 24, slack: float = 0.17) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of `docs` (doc_id, text): links at `percent` % Jaccard similarity of shingles of `k` words."""
    every = checkpointed(sketches(docs, k))
    some = every.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = checkpointed(some.groupBy("d0", "d1", "n").agg(F.min(F.struct("doc_id", "coords", "packed")).alias("x")).select(F.col("x.doc_id").alias("rep"), "d0", "d1", "n", "x.coords", "x.packed"))

    paths = F.array(*[F.xxhash64(F.lit(j), F.element_at("coords", j + 1)) for j in range(trees * branches)])
    top = reps.select("rep", F.explode(paths).alias("node"))
    shared = top.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    rows = checkpointed(top.join(shared, "node"))
    # Sets that share many values lie in the middle of their group, and so lead it best.
    votes = rows.where(F.col("size") > small).select("rep").distinct().join(reps.select("rep", "coords"), "rep").select("rep", F.posexplode(F.slice("coords", trees * branches + 1, 24)).alias("c", "v"))
    central = votes.join(votes.groupBy("c", "v").agg(F.count("*").alias("votes")).where("votes > 1"), ["c", "v"]).groupBy("rep").agg(F.sum("votes").alias("votes"))
    rank = rows.groupBy("rep").agg(F.sum("size").alias("sizes")).join(central, "rep", "left").select("rep", F.coalesce("votes", "sizes").alias("rank"))
    rows = checkpointed(rows.drop("size").join(rank, "rep"))
    del top, shared, votes, central, rank
    sweep(docs.sparkSession)

    brief = reps.select("rep", "n", "packed")  # joined where rows have met
    links, labels, tested = None, None, None

    def labelled(frame: DataFrame) -> DataFrame:
        if labels is None:
            return frame.withColumn("label", F.col("rep"))
        return frame.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    for r in range(rounds):  # join what is plainly one group, so that only pairs across components are left
        known = labelled(rows)
        order = F.xxhash64(F.lit(r), "node", "rep")
        least = [F.min(F.when(F.pmod(F.xxhash64(F.lit(r), "rep"), F.lit(leads)) == j, F.struct((-F.col("rank")).alias("rank"), order.alias("order"), "rep", "label"))) for j in range(leads)]
        chosen = known.groupBy("node").agg(F.array_compact(F.array(*least)).alias("leads"))
        other = F.filter("leads", lambda x: x["label"] != F.col("label"))
        asked = known.join(chosen, "node").select("rep", F.explode(other).alias("x")).select(F.least("rep", "x.rep").alias("u"), F.greatest("rep", "x.rep").alias("v"), "rep").distinct()
        if tested is not None:
            asked = asked.join(tested, ["u", "v"], "left_anti")
        asked = asked.join(brief.select(F.col("rep").alias("u"), F.struct("n", "packed").alias("p")), "u").join(brief.select(F.col("rep").alias("v"), F.struct("n", "packed").alias("q")), "v")
        asked = asked.where(_promising("p", "q", percent, slack)).withColumn("alike", _alike("p", "q"))
        nearest = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("alike").desc(), "u", "v"))
        pairs = checkpointed(asked.withColumn("nearest", nearest).where(F.col("nearest") <= (1 if r == 0 else tries)).select("u", "v").distinct())
        tested = pairs if tested is None else tested.union(pairs)
        del known, chosen, asked  # so that their shuffle files may go
        found = _confirmed(docs, pairs, k, percent)
        links = found if links is None else checkpointed(links.union(found))
        labels = checkpointed(components(links).select(F.col("id").alias("rep"), F.col("root").alias("label")))
        del pairs, found
        sweep(docs.sparkSession)

    frontier, leaves, hot = checkpointed(labelled(rows).select("node", "rep", "label", F.lit(None).cast("long").alias("parent"))), [], []
    for level in range(depth):
        open_ = checkpointed(_mixed(frontier))
        leaves.append(open_.where(F.col("size") <= small))
        # A node that kept half of its parent's sets is a group of likes, which more paths would only copy.
        alike = F.coalesce(2 * F.col("size") >= F.col("parent"), F.lit(False)) | F.lit(level == depth - 1)
        hot.append(open_.where((F.col("size") > small) & alike))
        large = open_.where((F.col("size") > small) & ~alike)
        if level == depth - 1 or large.isEmpty():
            break
        # The node chooses the coordinates; those of the first level are not used again.
        free = STORED - trees * branches
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(free))
        nexts = [first, *[F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit((free - 1) // max(1, branches - 1))) + F.lit(j * ((free - 1) // max(1, branches - 1))), F.lit(free)) for j in range(branches - 1)]]
        grown = large.join(reps.select("rep", "coords"), "rep")
        children = F.array(*[F.xxhash64("node", F.lit(7), c, F.element_at("coords", (c + trees * branches + 1).cast("int"))) for c in nexts])
        frontier = checkpointed(grown.select(F.explode(children).alias("node"), "rep", "label", F.col("size").alias("parent")))
        del grown
        sweep(docs.sparkSession)
    leaf, warm = reduce(DataFrame.union, leaves), checkpointed(reduce(DataFrame.union, hot))
    leaf = leaf.join(brief, "rep").withColumn("private", F.lit(0))
    pairs = _met(leaf, percent, slack)
    if not warm.isEmpty():
        viable, sharing = _viable(docs, warm, brief, k, percent, slack, rare)
        pairs = pairs.union(_met(viable, percent, slack)).union(sharing).distinct()
    more = _confirmed(docs, pairs, k, percent)
    roots = components(links.union(more)).select(F.col("id").alias("rep"), "root")

    classes = reps.select("rep", "d0", "d1", F.col("n").alias("size")).join(roots, "rep", "left").select("d0", "d1", "size", F.coalesce("root", "rep").alias("root"))
    out = every.select("doc_id", "n", "d0", "d1").join(classes, (every["d0"] == classes["d0"]) & (every["d1"] == classes["d1"]) & (every["n"] == classes["size"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of near copies in `docs` (doc_id, text, ...), with all its columns: that of the least doc_id.

    Unlike in `cluster`, rows need not have an id of their own. Of rows that share a doc_id, the one of the
    least text hash bears it; the others, and rows without doc_id, are compared under an id made of their text,
    which comes after all others. Equal rows are one. Columns may have any names."""
    own = F.xxhash64(F.lit(31), F.col("doc_id"), F.col("text"))
    thin = docs.select("doc_id", own.alias("h"))
    shared = checkpointed(thin.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("least")).where("n > 1 OR doc_id IS NULL"))
    if shared.isEmpty():
        found = cluster(docs.select("doc_id", "text"), **options)
        return docs.join(found.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    made = F.lit(1 << 62) + F.shiftrightunsigned(own, 2)
    rows = docs.select("doc_id", "text", own.alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(shared.select(F.col("doc_id").alias("id"), "least"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    bears = F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == F.col("h")))
    rows = rows.select(F.when(bears, F.col("doc_id")).otherwise(made).alias("key"), "text", "row", (F.col("least").isNotNull() | F.col("doc_id").isNull()).alias("twice"))
    found = cluster(rows.select(F.col("key").alias("doc_id"), "text"), **options)
    rows = rows.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    once = rows.where("NOT twice").union(rows.where("twice").dropDuplicates(["key"]))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
