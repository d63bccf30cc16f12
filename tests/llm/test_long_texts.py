"""Very long texts and words in pieces, and what of them must not depend on the pieces."""

import random

import numpy as np

from lexweave.llm import common, decontaminate, near_dedup, quality, toxicity
from test_near_dedup import shingles


def long_texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    return [" ".join(rng.choice(words) for _ in range(150_000)), "x" * 700_000, "one two " + "y" * 600_000 + " three four", "short text here now", "", "é" * 400_000]


def test_pieces_give_the_same_words(monkeypatch):
    texts = [t.encode() for t in long_texts()]
    for kinds in ({}, {"letters_only": True}, {"marks": True}):
        pieces = list(common.word_stream(texts, **kinds))
        monkeypatch.setattr(common, "PIECE", 1 << 24)
        whole = common.word_hashes(texts, **kinds)
        monkeypatch.undo()
        assert len(pieces) > 3 and max(len(p[4]) for p in pieces) <= common.PIECE + 2
        assert (np.concatenate([p[0] for p in pieces]) == whole[0]).all() and (np.concatenate([p[1] for p in pieces]) == whole[1]).all()
        assert (np.concatenate([p[3] - p[2] for p in pieces]) == whole[3] - whole[2]).all()


def test_shingles_of_long_texts():
    texts = long_texts()
    sets = list(near_dedup.shingle_sets(texts, 4))
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for t in texts]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets[1:])
    one, two = near_dedup.sketch([s for s in sets if len(s)]), [near_dedup.sketch([s]) for s in sets if len(s)]
    assert all((one[0][k] == t[0][0]).all() and (one[1][k] == t[1][0]).all() for k, t in enumerate(two))


def test_features_and_ngrams_of_long_texts():
    texts = [t.encode() for t in long_texts()]
    for k, t in enumerate(texts):
        alone = [(0, f) for d, fs in quality.ngrams([t]) for f in fs.tolist()]
        together = [(0, f) for d, fs in quality.ngrams(texts) for n, f in zip(d.tolist(), fs.tolist(), strict=True) if n == k]
        assert sorted(alone) == sorted(together)
    model = toxicity.Model(np.empty(0, np.uint32), np.empty(0), -1.0)
    assert (model.logits(long_texts()) == -1).all()


def test_items_across_the_parts_of_long_texts():
    rng = random.Random(3)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(14)) for _ in range(20)]
    index = decontaminate.Index([*enumerate(items), (50, "tiny item")], least=1)
    filler = " ".join("".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(330_000))
    for at in (0, 511_000, 512_000, 1_023_500, len(filler)):
        gap = filler.rfind(" ", 0, at + 1) + 1 if at < len(filler) else at
        text = filler[:gap] + " " + items[7] + " tiny item " + filler[gap:]
        found = {(index.ids[i], e) for _, i, e in index.leaks([decontaminate.normalised(text)])}
        assert found == {(7, 0), (50, 0)}
    assert not list(index.leaks([decontaminate.normalised("xtiny itemx " * 60_000)]))
