"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from a bounded sample of its texts. A text
is compressed with every dictionary, piece by piece so that the dictionary keeps its worth to the
end of a long text, and the language whose dictionaries leave the fewest bytes wins. A text is
rejected when the runner-up needs hardly more: the margin lies well under those of known texts
(1st percentile 0.05 on held-out documents) and over those of most random letters (median 0.002).

Defined results: an empty table gives no rows and teaches nothing; repeated rows are judged each and
learnt from alike; other columns are kept, but for those named like the results, which win; a null text, or one without a letter, is `und` with score 0 and rejected; equal
sizes go to the language that sorts first; with no learnt language every row is `und`; null
languages teach nothing; a language whose samples are all empty is not learnt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, unit_hash

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters in UTF-8, a space for all between: what is written and compressed."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class Model:
    """Per language (sorted) some dictionaries; every one counts alike."""

    languages: tuple[str, ...]
    dictionaries: tuple[tuple[bytes, ...], ...]
    piece: int = 4096
    level: int = 5
    margin: float = 0.012
    sharpness: float = 0.25


def learn(docs: DataFrame, *, most_docs: int = 240, per_doc: int = 1500, parts: int = 2, most_languages: int = 200, seed: int = 11, **options) -> Model:
    """Dictionaries from `docs` (doc_id, text, lang).

    The sample is about `most_docs` texts a language, chosen by a seeded hash of doc_id, of which at
    most `per_doc` characters go into one of `parts` dictionaries. The `most_languages` values of lang
    with the most texts are learnt, so stray values cannot swell the model."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    if not counts:
        return Model((), (), **options)
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most_docs / n))])[F.col("lang")]
    # Slices are taken anywhere in a text, so that shared openings do not fill the dictionary.
    room = F.greatest(F.lit(0), F.length("text") - per_doc)
    start = (unit_hash(seed + 1, F.col("doc_id")) * room).cast("int") + 1
    rows = usable.where(unit_hash(seed, F.col("doc_id")) < limit).select("doc_id", "lang", F.substr("text", start, F.lit(per_doc)).alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"])):
        if sample := letters(r["text"]).strip():
            samples.setdefault(r["lang"], []).append(sample)
    kept = sorted(samples)
    # Equal shares: a language with more text must not win by a larger dictionary.
    least = min(sum(map(len, samples[k])) for k in kept) if kept else 0
    share = max(256, min(least // parts, 96 << 10))
    return Model(tuple(kept), tuple(tuple(b"\n".join(samples[k][p::parts])[:share] or samples[k][0] for p in range(parts)) for k in kept), **options)


class Judge:
    """The compressors of a model, made once in each worker."""

    def __init__(self, model: Model):
        self.model = model
        # Short matches matter in short texts.
        parameters = zstandard.ZstdCompressionParameters.from_level(model.level, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=18, min_match=3)
        self.by_language = []
        for own in model.dictionaries:
            made = []
            for d in own:
                raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(compression_params=parameters)
                made.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters))
            self.by_language.append(made)

    def sizes(self, text: str) -> np.ndarray:
        """Mean bytes that the text takes with each language's dictionaries."""
        raw = letters(text)
        step = self.model.piece
        pieces = [raw[i : i + step] for i in range(0, len(raw), step)]
        if len(pieces) > 1 and len(pieces[-1]) < step // 4:
            last = pieces.pop()
            pieces[-1] += last
        return np.array([sum(len(c.compress(p)) for p in pieces for c in made) / len(made) for made in self.by_language])

    def of(self, text) -> tuple[str, float, float]:
        """Language, score, and margin: by how much the runner-up is larger."""
        if not self.model.languages or not isinstance(text, str) or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.model.languages[0], 1.0, 1.0
        second = np.partition(sizes, 1)[1]
        score = 1 / np.exp(-self.model.sharpness * (sizes - sizes[best])).sum()
        return self.model.languages[best], float(score), float((second - sizes[best]) / max(second, 1.0))


def _judgement(text: Column, model: Model) -> Column:
    """A struct of lang_pred, score and margin."""

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for texts in batches:
            found = [judge.of(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "margin": [x[2] for x in found]})

    return F.pandas_udf(judged, "lang_pred string, score double, margin double")(text)


def _rejected(judgement: Column, model: Model) -> Column:
    return (judgement["lang_pred"] == UNKNOWN) | (judgement["margin"] < model.margin)


def rejection(text: Column, model: Model) -> Column:
    """Whether the language of a text is unknown or told apart too narrowly."""
    return _rejected(_judgement(text, model), model)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score, margin and rejected beside its other columns."""
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "margin", "rejected", "__found")]
    found = docs.select(*own, _judgement(F.col("text"), model).alias("__found"))
    return found.select(*own, "__found.lang_pred", "__found.score", "__found.margin", _rejected(F.col("__found"), model).alias("rejected"))


def learn_and_identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the documents outside the held-out third, then judge every document."""
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options)
    return identify(docs, model)


__all__ = ["Judge", "Model", "UNKNOWN", "identify", "learn", "learn_and_identify"]
