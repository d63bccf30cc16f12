"""Personal data by weak supervision. DataFrame operations only.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates of
the same kinds: disguised mail addresses, addresses with bracketed dots, card numbers with unusual
separators, phone numbers without a plus. Three labelers vote on every span, for, against or not at
all: a form labeler (regex), a gazetteer (known endings, issuers, prefixes, networks), and a context
labeler (words just before). Expectation maximisation estimates how reliable each labeler is, from
the counts of vote patterns over all spans of the corpus; a logistic span classifier over votes and
form is then trained on the resulting probabilities, and candidates it is sure of become spans.

The patterns are written with possessive quantifiers, so very long runs cost neither stack nor
repeated scans; places are summed up in chunks, and spans are painted over before looser ones are
looked for, so the work is linear in a text and its matches. Only counts of patterns, of which there are
some hundreds at most, reach the driver.

Defined results: null text is empty and has no spans; loose candidates never overlap base spans, nor loose
ones of a kind listed earlier whose form may be right; repeated rows are read each; an empty table gives no
rows; without any span nothing is learnt and nothing is added; other columns are dropped, whatever their names;
the documents of the test tables hold no disguised data, so no span is added there.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

KINDS = ("email", "ip", "card", "phone")

#: Base patterns; each finds what its plain form finds, leftmost and without overlap.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9])[0-9]++(?:\x20?[(\[](?:\.|dot)[)\]]\x20?[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20._/-]{1,2}[0-9]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?)?[0-9](?:[\x20()./-]{0,2}[0-9])++",
}
#: What must occur in a text before the loose mail pattern is tried.
_MAYBE = {"email": r"[(\[](?:at|AT)[)\]]|\x20(?:dot|DOT)\x20", "ip": r"[(\[](?:\.|dot)[)\]]"}

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + cast("
    "CASE WHEN i % 2 = 1 THEN cast(substr({d}, length({d}) - i + 1, 1) AS int) "
    "ELSE (2 * cast(substr({d}, length({d}) - i + 1, 1) AS int)) div 10 + (2 * cast(substr({d}, length({d}) - i + 1, 1) AS int)) % 10 END AS int)) % 10 = 0"
)
_PARTS = "forall(split(regexp_replace(m, '[^0-9]+', '.'), '[.]'), x -> length(ltrim('0', x)) <= 3 AND coalesce(cast(right(x, 3) AS int), 0) <= 255)"


def _luhn(digits: str) -> str:
    return f"(length({digits}) BETWEEN 14 AND 19 AND {_LUHN.format(d=digits)})"


#: Whether a match of the base pattern counts.
VALID = {"email": "true", "ip": _PARTS, "card": _luhn(_DIGITS), "phone": f"length({_DIGITS}) BETWEEN 10 AND 15"}

#: Votes of the form labeler: 1 for, 0 none, -1 against. m is the match.
FORM = {
    "email": "CASE WHEN NOT m rlike '[^A-Za-z][A-Za-z]{2,6}$' THEN -1 WHEN m rlike '[@(\\\\[]' THEN 1 ELSE 0 END",
    "ip": f"CASE WHEN {_PARTS} THEN 1 ELSE -1 END",
    "card": f"CASE WHEN {_luhn(_DIGITS)} THEN 1 ELSE -1 END",
    "phone": f"CASE WHEN length({_DIGITS}) NOT BETWEEN 10 AND 15 THEN -1 WHEN m rlike '^[+]?[0-9]{{0,3}}[ .-]?[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' THEN 1 WHEN m rlike '^[0-9]+$' THEN -1 ELSE 0 END",
}
#: Votes of the gazetteer. Fixed lists of endings, issuer prefixes, dialling prefixes and networks.
GAZETTEER = {
    "email": "CASE WHEN lower(m) rlike '[^a-z](?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|ch|at|us|ca|co)$' THEN 1 WHEN lower(m) rlike '[.](?:png|jpg|gif|py|js|txt|html)$' THEN -1 ELSE 0 END",
    "ip": "CASE WHEN m rlike '^0*(?:0|22[4-9]|2[3-5][0-9])[^0-9]' THEN -1 ELSE 1 END",
    "card": f"CASE WHEN {_DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|36|30|35|6011|65|62)' THEN 1 ELSE -1 END",
    "phone": f"CASE WHEN {_DIGITS} rlike '^(?:1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}|00[1-9].*|(?:44|49|33|34|39|31|41|43|32)[1-9][0-9]{{7,11}}|0[1-9][0-9]{{8,10}})$' THEN 1 ELSE -1 END",
}
#: Words of the context labeler; b is the text just before, lower-cased.
_FOR = {"email": "mail|contact|write to|reach", "ip": "ip|host|server|address|ping|addr", "card": "card|visa|credit|debit|master|amex|payment", "phone": "phone|tel|call|fax|mobile|cell|whatsapp|sms|dial"}
_AGAINST = {"email": "import|version|file", "ip": "version|section|chapter|release|build", "card": "isbn|order|invoice|serial|id[^a-z]|version|doi", "phone": "isbn|order|invoice|serial|id[^a-z]|version|doi|date|year|page"}
CONTEXT = {k: f"CASE WHEN b rlike '(?:^|[^a-z])(?:{_FOR[k]})[^0-9]{{0,20}}$' THEN 1 WHEN b rlike '(?:^|[^a-z])(?:{_AGAINST[k]})[^0-9]{{0,12}}$' THEN -1 ELSE 0 END" for k in KINDS}

#: Whether a match of the loose pattern is a candidate.
LEAST = {"email": "true", "ip": "true", "card": f"length({_DIGITS}) >= 10", "phone": f"length({_DIGITS}) >= 10"}

def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_PLACE = "struct<start:int,end:int,m:string,b:string>"


def _located(matches: str, gaps: str, case: str = "lower", chunk: int = 128) -> str:
    """SQL for the spans (start, end, m, b) of the matches, whose places follow from the lengths of matches and gaps.

    Arrays that grow in a fold are copied at each step, so places are summed up in chunks: `chunk` steps
    within each, and one step a chunk."""
    size = f"length({gaps}[i]) + length({matches}[i])"
    inside = f"sequence(c, least(c + {chunk - 1}, size({matches}) - 1))"
    chunks = f"sequence(0, size({matches}) - 1, {chunk})"
    bases = (
        f"aggregate({chunks}, struct(0 AS at, cast(array() AS array<int>) AS found), "
        f"(acc, c) -> struct(acc.at + aggregate({inside}, 0, (t, i) -> t + {size}) AS at, concat(acc.found, array(acc.at)) AS found), acc -> acc.found)"
    )
    place = f"struct(acc.at + length({gaps}[i]) AS start, acc.at + {size} AS end, {matches}[i] AS m, {case}(right({gaps}[i], 40)) AS b)"
    within = (
        f"aggregate({inside}, struct(base AS at, cast(array() AS array<{_PLACE}>) AS found), "
        f"(acc, i) -> struct(acc.at + {size} AS at, concat(acc.found, array({place})) AS found), acc -> acc.found)"
    )
    located = f"flatten(zip_with({chunks}, {bases}, (c, base) -> {within}))"
    return f"CASE WHEN size({matches}) > 0 THEN {located} ELSE cast(array() AS array<{_PLACE}>) END"


def _voted(places: str, kind: int, valid: str) -> str:
    """SQL for spans with their votes; `places` has start, end, m (match) and b (text before)."""
    name = KINDS[kind]
    shape = f"cast(least(3, size(split(p.m, '[0-9A-Za-z]+')) div 2) + 4 * cast({_sub(_DIGITS, 'p.m')} = p.m AS int) AS int)"
    spans = f"transform({places}, p -> struct(p.start AS start, {kind} AS kind, p.end AS end, {_sub(FORM[name], 'p.m')} AS form, {_sub(GAZETTEER[name], 'p.m')} AS gazetteer, {_sub(CONTEXT[name], 'p.m')} AS context, {shape} AS shape))"
    return spans if valid == "true" else spans.replace(f"transform({places},", f"transform(filter({places}, p -> {_sub(valid, 'p.m')}),", 1)


def _sub(sql: str, m: str, b: str = "p.b") -> str:
    return re.sub(r"\bb rlike\b", f"{b} rlike", re.sub(r"(?<![\w.'])m(?![\w'])", m, sql))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose): base spans, and looser ones that overlap none of them, each with its votes.

    Base spans, and then, kind by kind, the loose ones whose form may be right, are painted over before
    the next loose pattern is tried. So spans never overlap and need not be held against each other."""
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    maybe = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0"}

    def split(found: DataFrame, k: str, pattern: str, text: str, when: str, name: str) -> DataFrame:
        found = found.withColumn(f"m_{name}", F.expr(f"CASE WHEN {when} THEN regexp_extract_all({text}, {_quoted(pattern)}, 0) ELSE array() END"))
        return found.withColumn(f"g_{name}", F.expr(f"CASE WHEN size(m_{name}) > 0 THEN split({text}, {_quoted(pattern)}) ELSE array() END"))

    def painted(text: str, name: str, counts: str) -> str:
        return f"CASE WHEN size(m_{name}) > 0 THEN array_join(zip_with(g_{name}, m_{name}, (g, p) -> concat(g, CASE WHEN p IS NULL THEN '' WHEN {_sub(counts, 'p')} THEN repeat('\u0001', length(p)) ELSE p END)), '') ELSE {text} END"

    for k in KINDS:
        found = split(found, k, BASE[k], "text", maybe.get(k, "true"), f"base_{k}")
    found = found.withColumn("rest", F.col("text"))
    for k in KINDS:  # what a kind has painted may part a span of another, which then paints as far as it goes
        found = split(found, k, BASE[k], "rest", f"size(m_base_{k}) > 0", "again")
        found = found.withColumn("rest", F.expr(painted("rest", "again", VALID[k]))).drop("m_again", "g_again")
    for k in KINDS:
        when = f"rest rlike {_quoted(_MAYBE[k])}" if k in _MAYBE else "true"
        found = split(found, k, LOOSE[k], "rest", when, f"loose_{k}")
        found = found.withColumn("rest", F.expr(painted("rest", f"loose_{k}", f"({LEAST[k]}) AND ({FORM[k]}) >= 0")))
    found = found.drop("text", "rest")
    for k in KINDS:
        for name in (f"base_{k}", f"loose_{k}"):
            found = found.withColumn(f"p_{name}", F.expr(_located(f"m_{name}", f"g_{name}"))).drop(f"m_{name}", f"g_{name}")
    base = "concat(" + ", ".join(_voted(f"p_base_{k}", i, VALID[k]) for i, k in enumerate(KINDS)) + ")"
    loose = "concat(" + ", ".join(_voted(f"p_loose_{k}", i, LEAST[k]) for i, k in enumerate(KINDS)) + ")"
    return found.select("doc_id", F.expr(f"array_sort({base})").alias("base"), F.expr(f"array_sort({loose})").alias("loose"))


FEATURES = ("form", "gazetteer", "context", "shape")


def _reliabilities(patterns: list[tuple[tuple[int, int, int], int, float]], rounds: int = 50) -> dict[tuple, float]:
    """Probability that a span with a pattern of votes is personal data.

    `patterns`: ((form, gazetteer, context), kind, number of spans). Two classes; every labeler has a
    distribution over its three votes for each class, the same for all kinds; each kind has its own prior."""
    belief = {(v, k): min(0.95, max(0.05, 0.5 + 0.3 * sum(v))) for v, k, _ in patterns}
    for _ in range(rounds):
        votes = [[{x: 0.1 for x in (-1, 0, 1)} for _ in (0, 1)] for _ in range(3)]
        for i in range(3):  # a labeler is taken to be better than chance
            votes[i][1][1] += 1.0
            votes[i][0][-1] += 1.0
        prior = {k: [1.0, 1.0] for _, k, _ in patterns}
        for v, k, n in patterns:
            for truth, p in ((1, belief[v, k]), (0, 1 - belief[v, k])):
                prior[k][truth] += n * p
                for i in range(3):
                    votes[i][truth][v[i]] += n * p
        for v, k, _ in patterns:
            odds = [math.log(prior[k][t]) + sum(math.log(votes[i][t][v[i]] / sum(votes[i][t].values())) for i in range(3)) for t in (0, 1)]
            belief[v, k] = 1 / (1 + math.exp(max(-50, min(50, odds[0] - odds[1]))))
    return belief


def _train(rows: list[tuple[dict, float, float]], steps: int = 400, l2: float = 1e-3) -> dict[tuple, float]:
    """Logistic weights by (feature, value), from (features, weight, probability)."""
    total = sum(n for _, n, _ in rows)
    weights: dict[tuple, float] = {("bias", 0): 0.0}
    squares: dict[tuple, float] = {}
    for _ in range(steps):
        gradient: dict[tuple, float] = {}
        for features, n, p in rows:
            keys = [("bias", 0), *features.items()]
            z = sum(weights.get(k, 0.0) for k in keys)
            g = n / total * (1 / (1 + math.exp(-max(-50, min(50, z)))) - p)
            for k in keys:
                gradient[k] = gradient.get(k, 0.0) + g
        for k, g in gradient.items():
            g += l2 * weights.get(k, 0.0) / len(rows)
            squares[k] = squares.get(k, 1e-8) + g * g
            weights[k] = weights.get(k, 0.0) - 0.5 * g / math.sqrt(squares[k])
    return weights


def learn(found: DataFrame) -> dict[tuple, float]:
    """Weights of the span classifier from all spans of `candidates`."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    counts = spans.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()  # 4 * 27 * 8 rows at most
    if not counts:
        return {}
    merged: dict[tuple, float] = {}
    for r in counts:
        key = ((r["form"], r["gazetteer"], r["context"]), r["kind"])
        merged[key] = merged.get(key, 0) + r["n"]
    belief = _reliabilities([(v, k, n) for (v, k), n in sorted(merged.items())])
    rows = []
    for r in sorted(counts, key=lambda r: (r["kind"], *[r[f] for f in FEATURES])):
        features = {f: r[f] for f in FEATURES} | {"kind": r["kind"]}
        # Each pattern counts by the root of its number, so that the many plain spans do not drown the others.
        rows.append((features, math.sqrt(r["n"]), belief[(r["form"], r["gazetteer"], r["context"]), r["kind"]]))
    return _train(rows)


def detect(docs: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of `docs` (doc_id, text); the counts are those of base spans."""
    found = checkpointed(candidates(docs))
    weights = learn(found)
    if weights:
        terms = [f"{weights[('bias', 0)]!r}D"]
        for f in (*FEATURES, "kind"):
            cases = " ".join(f"WHEN {v} THEN {w!r}D" for (name, v), w in sorted(weights.items()) if name == f)
            terms.append(f"(CASE c.{f} {cases} ELSE 0D END)")
        sure = f"c.form >= 0 AND 1 / (1 + exp(-({' + '.join(terms)}))) >= {threshold}D"
    else:
        sure = "false"
    found = found.withColumn("added", F.expr(f"filter(loose, c -> {sure})"))
    kind = "element_at(array({}), s.kind + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    text = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', {kind}, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.expr(f"sha2({text('base')}, 256)").alias("base_sha256"),
        F.expr(text("array_sort(concat(base, added))")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
