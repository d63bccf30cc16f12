"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring of hashes; a row belongs to the first point at or after
the hash of its doc_id. A shard takes at most its capacity, ceil or floor of (1 + epsilon) * rows /
shards; what a full shard cannot take continues clockwise to the next point of a shard with room.
With epsilon 0 all shards are full, so their row counts are at most one apart (law `rows`). With a
larger epsilon fewer rows leave their own point, and fewer move when a shard is added.

The overflow is settled on the counts of the arcs, of which there are shards * virtual at any size
of the input. The rows of an arc are ranked by hash within cells of the ring whose number grows with
the rows, so no task ever orders more than some thousands of rows.

With epsilon 0 about 7 in 100 rows move when a 25th shard comes, with epsilon 0.3 about 4, which is the ideal.

Defined results: rows without doc_id are placed by their texts; rows with the same doc_id lie at the same
point and are told apart by size and text hash, then arbitrarily; other columns are dropped unless named in
`keep`, whatever their names; null text has size 8 and the
crc32 of the empty text; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Bits of a ring position.
RING_BITS = 30


def _points(shards: int, virtual: int, seed: int) -> list[tuple[int, int]]:
    """(position, shard) around the ring. Where two points meet, the later one (of the higher shard) moves on
    to the next free place, so every shard has all its points, whatever the number of shards."""
    found: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            x = (seed * 0x9E3779B97F4A7C15 + shard * 0xBF58476D1CE4E5B9 + v * 0x94D049BB133111EB + 1) & ((1 << 64) - 1)
            for _ in range(2):
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
                x ^= x >> 31
            place = x >> (64 - RING_BITS)
            while place in found:
                place = (place + 1) % (1 << RING_BITS)
            found[place] = shard
    return sorted(found.items())


def _settle(counts: list[int], owners: list[int], shards: int, epsilon: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which shard takes which ranks of each arc.

    Arcs are served clockwise from the start of the ring, first each by its own shard, then what is
    left by the shards with room that follow. Arcs of full shards are skipped by pointers."""
    total = sum(counts)
    most = [max(-(-total // shards), int((1 + epsilon) * total / shards))] * shards
    if epsilon == 0:
        most = [total // shards + (s < total % shards) for s in range(shards)]
    load, out, left = [0] * shards, [], []

    def give(arc: int, at: int, end: int, s: int) -> int:
        take = min(end - at, most[s] - load[s])
        if take:
            out.append((arc, at, at + take, s, load[s]))
            load[s] += take
        return at + take

    for arc, n in enumerate(counts):
        at = give(arc, 0, n, owners[arc])
        if at < n:
            left.append((arc, at, n))
    following = list(range(1, len(owners))) + [0]

    def with_room(arc: int) -> int:
        passed = []
        while load[owners[arc]] >= most[owners[arc]]:
            passed.append(arc)
            arc = following[arc]
        for p in passed:
            following[p] = arc
        return arc

    for arc, at, n in left:
        near = arc
        while at < n:
            near = with_room(following[near])
            at = give(arc, at, n, owners[near])
    return out


def _arcs(points: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """Bits of a grid over the ring, and for each of its cells the first arc and the points inside."""
    bits = min(RING_BITS, max(8, len(points).bit_length() + 1))
    positions, cells, at = [p for p, _ in points], [], 0
    for g in range(1 << bits):
        end = bisect.bisect_left(positions, (g + 1) << (RING_BITS - bits), at)
        cells.append((g, at, positions[at:end]))
        at = end
    return bits, cells


def _place(keyed: DataFrame, owners: list[int], shards: int, epsilon: float, cell_rows: int) -> DataFrame:
    """`keyed` with shard and slot; it has ring (position), tie columns crc and size, and doc_id."""
    spark = keyed.sparkSession
    total = keyed.count()
    bits = min(RING_BITS, max(6, (max(1, total) // cell_rows).bit_length()))
    keyed = keyed.withColumn("cell", F.shiftright(F.col("ring"), RING_BITS - bits))
    cells = checkpointed(keyed.groupBy("arc", "cell").agg(F.count("*").alias("n")))
    counts = [0] * len(owners)
    for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # a row for each point of the ring at most
        counts[r["arc"]] = r["n"]
    segments = spark.createDataFrame(_settle(counts, owners, shards, epsilon), "arc int, low long, high long, shard int, base long")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("arc", "cell").orderBy("ring_full", "doc_id", "size", "text_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["arc", "cell"]).withColumn("rank", F.col("rank") + F.col("offset"))
    fits = (ranked["arc"] == segments["arc"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # At most one segment for each point and shard.
    placed = ranked.join(F.broadcast(segments), fits)
    return placed.select(ranked["*"], "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot")).drop("arc", "cell", "rank", "offset", "ring", "ring_full")


def assign(docs: DataFrame, *, shards: int = 24, virtual: int = 64, epsilon: float = 0.0, seed: int = 3, cell_rows: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, size, text_crc32, shard, slot, *keep). Slots count up from 0 in each shard."""
    kept = [docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.length(raw) + 8).cast("long"), F.crc32(raw)
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), crc, size)).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    keyed = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), hashed.alias("ring_full"), F.shiftrightunsigned(hashed, 64 - RING_BITS).alias("ring"), *kept)
    if not keep:
        keyed = checkpointed(keyed)
    points = _points(shards, virtual, seed)
    bits, cells = _arcs(points)
    # Two to four rows a point, whatever the size of the input.
    grid = docs.sparkSession.createDataFrame(cells, "grid long, first int, inside array<long>")
    keyed = keyed.withColumn("grid", F.shiftright(F.col("ring"), RING_BITS - bits)).join(F.broadcast(grid), "grid")
    keyed = keyed.withColumn("arc", F.expr(f"cast((first + size(filter(inside, p -> p < ring))) % {len(points)} AS int)")).drop("grid", "first", "inside")
    placed = _place(keyed, [s for _, s in points], shards, epsilon, cell_rows)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])
