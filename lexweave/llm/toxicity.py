"""Toxicity by a classifier that is regularised with counterfactuals.

A logistic model over words and word beginnings is learnt from labelled texts. Every sentence of a
labelled text that names a group of people is also rewritten, and no other sentence with it: once with
another group of the same kind, once with a neutral word. Of the texts that name no group, some get
a neutral sentence that does, so the method acts on any corpus. Beside the log-loss, training pays
`strength` times the squared difference of the logits of a text and its rewritings, so a bare mention of a
group neither raises nor lowers the score. The model says how many rewritings took part.

Defined results: a null or empty text has no features and gets the score of the intercept; without
labelled rows of both kinds, every score is the share of toxic labels (0.5 without any label); an
empty table gives no rows; very long texts are read whole, a piece at a time;
repeated rows are scored each; other columns of the input are kept where their names are not those
of the result (doc_id, held_out, score, predicted), which win.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, held_out, in_pieces, mix, unit_hash, utf8, word_stream

# ------------------------------------------------------------------ fixed values of the rewritings
#: By language: kinds of groups, of which a term is swapped with the next one of its kind; a neutral word; neutral sentences.
IDENTITIES = {
    "en": (
        ("women", "men"),
        ("woman", "man"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "arab"),
        ("gay", "lesbian", "bisexual", "straight", "transgender"),
        ("immigrants", "refugees", "natives"),
        ("disabled", "blind", "deaf"),
    ),
    "fr": (
        ("femmes", "hommes"),
        ("femme", "homme"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
        ("noir", "blanc", "asiatique", "arabe"),
        ("lesbienne", "bisexuel", "hétérosexuel", "transgenre"),
        ("immigrés", "réfugiés", "autochtones"),
        ("handicapé", "aveugle", "sourd"),
    ),
    "de": (
        ("frauen", "männer"),
        ("frau", "mann"),
        ("muslime", "christen", "juden", "buddhisten", "atheisten"),
        ("muslimisch", "christlich", "jüdisch", "buddhistisch", "atheistisch"),
        ("schwarz", "weiß", "asiatisch", "arabisch"),
        ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
        ("einwanderer", "flüchtlinge", "einheimische"),
        ("behindert", "taub"),
    ),
    "es": (
        ("mujeres", "hombres"),
        ("mujer", "hombre"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("musulmán", "cristiano", "judío", "budista", "ateo"),
        ("negro", "asiático", "árabe"),
        ("lesbiana", "bisexual", "heterosexual", "transgénero"),
        ("inmigrantes", "refugiados", "nativos"),
        ("discapacitado", "ciego", "sordo"),
    ),
}
NEUTRAL = {"en": "people", "fr": "personnes", "de": "menschen", "es": "personas"}
SENTENCES = {
    "en": ("there are {} in this town.", "my neighbour spoke about {} today."),
    "fr": ("il y a {} dans cette ville.", "mon voisin a parlé de {} hier."),
    "de": ("hier in der stadt gibt es {}.", "mein nachbar sprach heute über {}."),
    "es": ("hay {} en esta ciudad.", "mi vecino habló hoy de {}."),
}


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted uint32
    weights: np.ndarray
    intercept: float
    rewritings: int = 0

    def logits(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        raw = utf8(t.lower() if isinstance(t, str) else t for t in texts)
        for a, b in in_pieces(raw) if len(self.features) else ():
            seen = []
            for doc, feature in features(raw[a:b]):
                at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
                hit = self.features[at] == feature
                seen.append(np.unique(doc[hit].astype(np.int64) * len(self.features) + at[hit]))
            both = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
            out[a:b] += np.bincount(both // len(self.features), self.weights[both % len(self.features)], b - a)
        return out


def features(raw: list[bytes], stems: tuple[int, ...] = (4, 5)):
    """(text number, feature) of every word and every beginning of a longer word, a piece at a time."""
    for h, doc, start, end, joined in word_stream(raw, letters_only=True):
        docs, found = [doc], [(h >> np.uint64(32)).astype(np.uint32)]
        for n in stems:
            long = end - start > n
            first = np.zeros(int(long.sum()), np.uint64)
            up, _ = _powers(n + 1)
            for k in range(n):
                first += _BYTE[joined[start[long] + k]] * up[k]
            docs.append(doc[long])
            found.append((mix(first + np.uint64(0xABCDEF)) >> np.uint64(32)).astype(np.uint32))
        yield np.concatenate(docs), np.concatenate(found)


def _following(identities) -> tuple[dict[str, str], dict[str, str]]:
    """The term that takes the place of each, and its neutral word; of languages that share a term, the first counts."""
    after, plain = {}, {}
    for lang, kinds in identities.items():
        for kind in kinds:
            for k, t in enumerate(kind):
                after.setdefault(t, kind[(k + 1) % len(kind)])
                plain.setdefault(t, NEUTRAL.get(lang, NEUTRAL["en"]))
    return after, plain


def swapped(text: str, identities=IDENTITIES, most_sentences: int = 4) -> list[str]:
    """For each of the first `most_sentences` sentences that name a group: the text with the names in that sentence
    exchanged within their kind, and with neutral words. None if it names no group."""
    after, plain = _following(identities)
    if not after:
        return []
    named = re.compile(r"\b(" + "|".join(sorted(after, key=len, reverse=True)) + r")\b")
    sentences = re.split(r"(?<=[.!?\n])", text.lower())
    at = [k for k, s in enumerate(sentences) if named.search(s)][:most_sentences]
    return ["".join([*sentences[:k], named.sub(lambda m, words=words: words[m[1]], sentences[k]), *sentences[k + 1 :]]) for k in at for words in (after, plain)]


def mentioning(text: str, identities=IDENTITIES) -> list[str]:
    """The text with a neutral sentence before it that names a group, chosen by the text: of one text in four, if any."""
    terms = [(lang, t) for lang, kinds in identities.items() for kind in kinds for t in kind]
    pick = zlib.crc32(text.encode("utf-8", "replace"))
    if not terms or pick % 4:
        return []
    lang, term = terms[pick // 4 % len(terms)]
    forms = SENTENCES.get(lang, SENTENCES["en"])
    return [forms[pick // 4 // len(terms) % len(forms)].format(term) + "\n" + text.lower()]


def _rows_of(texts) -> list[np.ndarray]:
    raw = utf8(t.lower() for t in texts)
    out: list[np.ndarray] = []
    for a, b in in_pieces(raw):
        own: list[np.ndarray] = [np.empty(0, np.uint32)] * (b - a)
        for doc, feature in features(raw[a:b]):
            order = np.argsort(doc, kind="stable")
            parts = np.split(feature[order], np.searchsorted(doc[order], np.arange(1, b - a)))
            own = [np.union1d(x, p) for x, p in zip(own, parts, strict=True)]
        out += own
    return out


def fit(labelled: DataFrame, *, strength: float = 1.0, most_rows: int = 4_000, most_features: int = 4096, least_gain: float = 25.0, l2: float = 1e-6, steps: int = 600, seed: int = 7, identities=IDENTITIES) -> Model:
    """Learn from `labelled` (doc_id, text, toxic).

    At most about `most_rows` rows of each label are gathered, chosen by a seeded hash of doc_id;
    their weights make up for the rows left out. The `most_features` features that tell the labels apart best
    are learnt, but none that does by less than `least_gain` (G-statistic). These bounds hold for the sample that
    is learnt from only."""
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] is not None}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    take = {0: min(1.0, most_rows / n0), 1: min(1.0, most_rows / n1)}
    chosen = labelled.where(F.col("toxic").isin(0, 1) & (unit_hash(seed, F.col("doc_id")) < F.when(F.col("toxic") == 1, take[1]).otherwise(take[0])))

    def each(batches):
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            own = _rows_of(texts)
            twins = [swapped(t, identities) or mentioning(t, identities) for t in texts]
            made = iter(_rows_of([t for x in twins for t in x]))
            yield pd.DataFrame({"toxic": pdf["toxic"], "own": [x.tobytes() for x in own], "twins": [[next(made).tobytes() for _ in x] for x in twins]})

    rows = chosen.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(each, "toxic int, own binary, twins array<binary>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    x = [np.frombuffer(bytes(r["own"]), np.uint32) for r in rows]
    pairs = [(i, np.frombuffer(bytes(t), np.uint32)) for i, r in enumerate(rows) for t in r["twins"]]
    del rows
    weight = np.where(y == 1, 1 / take[1], 1 / take[0])
    weight /= weight.sum()

    ids = np.unique(np.concatenate(x))
    in1, in0 = np.zeros(len(ids)), np.zeros(len(ids))
    for features_of, positive, share in zip(x, y, weight, strict=True):
        (in1 if positive else in0)[np.searchsorted(ids, features_of)] += share
    p1, p0 = (y * weight).sum(), ((1 - y) * weight).sum()
    a, b, c, d = in1, in0, p1 - in1, p0 - in0
    log = lambda v, e: v * np.log(np.maximum(v, 1e-12) / e)
    df, nd = a + b, c + d
    gain = 2 * len(x) * (log(a, df * p1) + log(b, df * p0) + log(c, np.maximum(nd * p1, 1e-12)) + log(d, np.maximum(nd * p0, 1e-12)))
    gain[a * p0 <= b * p1] = 0
    best = np.argsort(-gain, kind="stable")[:most_features]
    kept = np.sort(ids[best[gain[best] >= least_gain]])
    if identities:  # whatever the rewritings change must be seen to change
        kept = np.unique(np.concatenate([kept, *(np.setxor1d(x[i], t) for i, t in pairs)])) if pairs else kept
    if not len(kept):
        return Model(np.empty(0, np.uint32), np.empty(0), float(np.log(p1 / p0)))

    def matrix(sets):
        at = [np.flatnonzero(np.isin(kept, s, assume_unique=True)) for s in sets]
        return np.repeat(np.arange(len(sets)), [len(v) for v in at]), np.concatenate(at) if at else np.empty(0, int)

    ri, ci = matrix(x)
    ti, tj = matrix([t for _, t in pairs])
    owner = np.array([i for i, _ in pairs], int)
    w, bias = np.zeros(len(kept)), float(np.log(p1 / p0))
    m, v, lr = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0.1
    for step in range(1, steps + 1):
        z = np.bincount(ri, w[ci], len(x)) + bias
        g = weight * (1 / (1 + np.exp(-z)) - y)
        if len(pairs):
            gap = z[owner] - bias - np.bincount(ti, w[tj], len(pairs))
            pull = 2 * strength * gap * weight[owner]
            grad = np.bincount(ci, (g + np.bincount(owner, pull, len(x)))[ri], len(kept)) - np.bincount(tj, pull[ti], len(kept))
        else:
            grad = np.bincount(ci, g[ri], len(kept))
        full = np.append(grad + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(kept.astype(np.uint32), w, float(bias), len(pairs))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """`docs` (doc_id, text) with held_out, score and predicted."""

    @F.pandas_udf("double")
    def p(text: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(model.logits(text.tolist()), -30, 30))))

    kept = [c for c in docs.columns if c.lower() not in ("doc_id", "held_out", "score", "predicted", "text")]
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p("text").alias("score"), *kept)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learn from the labelled documents outside the held-out third, then score every document."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    most = options.get("most_rows", 4_000)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Two thousandths of slack keep the later choice by the same hash whole.
    few = F.lit(False)
    for value in (0, 1):
        few = few | ((F.col("toxic") == value) & (unit_hash(options.get("seed", 7), F.col("doc_id")) < 1.002 * most / max(1, n.get(value) or 0)))
    small = known.where(few)  # about 2 * most rows at any size of the input
    labelled = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    return score(docs, fit(labelled, **options))
