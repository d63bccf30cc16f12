"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in spark.checkpoint.dir,
    or one of our own where that is unset and Spark runs in this process alone, as in local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexweave-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read from there afterwards.

    A checkpoint keeps the estimated size of its plan, which for joins is a product of sizes: over many
    rounds these become numbers of millions of digits. So the rows get a plan without an estimate."""
    spark = df.sparkSession
    shared_folder(spark)
    saved = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(saved.queryExecution().toRdd(), saved.schema(), False), spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver's garbage is collected, which in a long driver program may be too late for the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no model may learn from: crc32(id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A double in [0, 1) that depends on the seed and the columns alone."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)


# ---------------------------------------------------------------- words of many texts at once

#: Bytes that are hashed at once; each takes some 40 bytes of memory meanwhile.
PIECE = 250_000
#: Odd constants of the word hash; any odd 64-bit numbers do.
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def _kinds(letters_only: bool, marks: bool) -> np.ndarray:
    """By byte: 0 separates; runs of equal other kinds are words."""
    kind = np.ones(256, np.int8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    byte = _LOWER.astype(int)
    letter, digit, space = (byte >= 97) & (byte <= 122), (byte >= 48) & (byte <= 57), kind == 0
    if letters_only:
        kind[(byte < 128) & ~letter] = 0
    if marks:
        kind[~space & (byte < 128) & ~letter & ~digit] = 2
    return kind


_KIND = {(a, b): _kinds(a, b) for a in (False, True) for b in (False, True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only pieces are hashed, so there are never many."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        base = np.full(size, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes], letters_only: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some UTF-8 texts of `PIECE` bytes together, A-Z lower-cased.

    A word is a run of bytes other than space and 0x09-0x0D; with `letters_only`, other ASCII
    characters that are no letters separate too; with `marks`, runs of other ASCII characters are words
    of their own. Returns (hash, text number, start, end, bytes): the starts and
    ends index the joined bytes."""
    joined = b" ".join(texts) + b" "
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    kind = _KIND[letters_only, marks][raw]
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    bounds = np.concatenate((change, [len(raw)]))
    inside = kind[np.minimum(bounds[:-1], len(raw) - 1)] > 0
    start, end = bounds[:-1][inside], bounds[1:][inside]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(ends_of_text, start, side="right"), start, end, raw


def _long_word(text: bytes, at: int, kind: np.ndarray) -> tuple[np.uint64, int]:
    """The hash of the word that begins at `at`, a piece at a time, and where it ends."""
    total, end, own, power = 0, at, kind[text[at]], 1
    up, _ = _powers(PIECE + 1)
    while end < len(text):
        raw = np.frombuffer(text, np.uint8, min(PIECE, len(text) - end), end)
        other = np.flatnonzero(kind[raw] != own)
        raw = _LOWER[raw[: other[0]] if len(other) else raw]
        total += int((_BYTE[raw] * up[: len(raw)]).sum(dtype=np.uint64)) * power
        power = power * pow(int(_BASE), len(raw), 1 << 64) % (1 << 64)
        end += len(raw)
        if len(other):
            break
    return mix(np.array([(total + end - at) % (1 << 64)], np.uint64))[0], end


def word_stream(texts: list[bytes], letters_only: bool = False, marks: bool = False):
    """`word_hashes` of any texts in order, with numbers among all of them, a piece at a time.

    A long text comes in several pieces, which are cut between words. A word longer than a piece comes
    alone; of its bytes only the first are returned."""
    kind = _KIND[letters_only, marks]
    for a, b in in_pieces(texts):
        if b - a > 1 or len(texts[a]) <= PIECE:
            h, doc, start, end, raw = word_hashes(texts[a:b], letters_only, marks)
            yield h, doc + a, start, end, raw
            continue
        text, at = texts[a], 0
        while at < len(text):
            end = min(at + PIECE, len(text))
            if end < len(text):
                k = kind[np.frombuffer(text, np.uint8, end - at + 1, at)]
                border = np.flatnonzero((k[1:] != k[:-1]) | (k[1:] == 0))
                if not len(border):
                    h, end = _long_word(text, at, kind)
                    yield np.array([h]), np.array([a]), np.array([0]), np.array([end - at]), _LOWER[np.frombuffer(text, np.uint8, 64, at)]
                    at = end
                    continue
                end = at + int(border[-1]) + 1
            h, doc, start, stop, raw = word_hashes([text[at:end]], letters_only, marks)
            yield h, doc + a, start, stop, raw
            at = end


def in_pieces(texts: list[bytes], most: int = PIECE):
    """Index ranges of `texts` of at most `most` bytes together; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) + 1 > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(values) -> list[bytes]:
    """Texts as UTF-8; null is empty. Lone surrogates, which Spark never makes, are replaced."""
    return [v.encode("utf-8", "replace") if isinstance(v, str) else b"" for v in values]
