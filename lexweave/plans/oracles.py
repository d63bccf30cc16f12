"""DuckDB twins of the registered queries."""

from __future__ import annotations

from ..operators.bpe import METHODS
from ..operators.l2w import MIN_COUNT
from ..operators.score import FOLLOWING, PREFIXES
from ..operators.text import lemma, upos
from .models import ANSWER_CUT, BUDGETS, MERGES, SEEDS, seed_merges, variants

STEPS = 8


def key(seed: int) -> str:
    return f"md5(concat_ws(':', '{seed}', doc_id, para_idx))"


WORD = r"'^[\p{L}\p{Mn}\p{Mc}]+$'"
HELD = f"left({key(0)}, 1) IN ('0', '1')"
PARAS = r"""paras AS MATERIALIZED (
  SELECT doc_id, lang, para_idx, text FROM (
    SELECT doc_id, lang, para_idx, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM (
      SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS para_idx FROM documents))
  WHERE length(text) BETWEEN 200 AND 1500 AND NOT (starts_with(text, '==') OR starts_with(text, '{{') OR starts_with(text, '|') OR starts_with(text, '*')))"""
WORDS = """words AS MATERIALIZED (
  SELECT doc_id, lang, para_idx, k, surface, (sum(length(surface) + 1) OVER w - length(surface) - 1)::BIGINT AS start, (sum(length(surface) + 1) OVER w - 1)::BIGINT AS "end"
  FROM (SELECT doc_id, lang, para_idx, unnest(string_split(text, ' ')) AS surface, (generate_subscripts(string_split(text, ' '), 1) - 1)::BIGINT AS k FROM paras)
  WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY k))"""


def cored(rows: str) -> str:
    return rf"(SELECT *, regexp_replace(surface, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS core FROM {rows})"


TAGGED = f"tagged AS MATERIALIZED (SELECT doc_id, lang, para_idx, k, surface, start, \"end\", {upos('k', 'core')} AS upos, {lemma('core')} AS lemma FROM {cored('words')})"


def counted(rows: str, part: str = "doc_id, para_idx", order: str = "k", a: str = "upos") -> str:
    return (
        f"(SELECT pos_l, pos_r, n, n / sum(n) OVER (PARTITION BY pos_l) AS p FROM (SELECT pos_l, pos_r, count(*) AS n FROM "
        f"(SELECT {a} AS pos_l, lead({a}) OVER (PARTITION BY {part} ORDER BY {order}) AS pos_r FROM {rows}) WHERE pos_r IS NOT NULL GROUP BY ALL))"
    )


TRANS = f"trans AS MATERIALIZED {counted('tagged')}"
TRAIN_TRANS = f"trans AS MATERIALIZED {counted(f'(SELECT * FROM tagged WHERE NOT {HELD})')}"
SEQ = "seqs AS MATERIALIZED (SELECT doc_id, lang, para_idx, text, regexp_replace(replace(text, ' ', '▁'), '(.)', '⟨\\1⟩', 'gs') AS seq FROM paras)"


def sql(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + "\n" + last


def encoded(seq: str, merges) -> str:
    for a, b in merges:
        seq = f"replace({seq}, '⟨{a}⟩⟨{b}⟩', '⟨{a}{b}⟩')"
    return seq


def tokens(seq: str) -> str:
    return f"string_split(({seq})[2:-2], '⟩⟨')"


def segmented(name: str, rows: str, merges=MERGES) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, {tokens(encoded('seq', merges))} AS tokens FROM {rows})"


TEST_SEQ = f"(SELECT * FROM seqs WHERE {HELD})"
TRAIN_SEQ = f"(SELECT * FROM seqs WHERE NOT {HELD})"
SEEN = f"seen AS MATERIALIZED (SELECT DISTINCT lower(surface) AS form FROM words WHERE NOT {HELD})"

# ---------------------------------------------------------------------------- pair scores

CLASSED = """toks AS MATERIALIZED (
  SELECT doc_id, para_idx, i, s, (coalesce(sum(length(s) - length(replace(s, '▁', ''))) OVER (PARTITION BY doc_id, para_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS m
  FROM (SELECT doc_id, para_idx, unnest(t) AS s, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, para_idx, string_split(seq[2:-2], '⟩⟨') AS t FROM {seqs}))),
near AS (SELECT doc_id, para_idx, s AS l, m AS ml, lead(s) OVER w AS r, lead(m) OVER w AS mr FROM toks WINDOW w AS (PARTITION BY doc_id, para_idx ORDER BY i)),
ruled AS MATERIALIZED (
  SELECT *, CASE WHEN l = '▁' THEN 1 WHEN r = '▁' THEN 2 WHEN NOT starts_with(l, '▁') AND NOT starts_with(r, '▁') AND ml = mr THEN 3 ELSE 4 END AS rule,
    CASE WHEN NOT starts_with(l, '▁') THEN ml END AS wl, CASE WHEN r = '▁' AND NOT starts_with(l, '▁') THEN mr + 1 END AS wr FROM near WHERE r IS NOT NULL)"""


def weight(beta: int = 0, factor: int = 1000, content=(), legacy: str | bool = False) -> str:
    adj = "least(greatest(floor(p * 1e6 + 0.5)::BIGINT, 10000), 950000)"
    if legacy:
        gain = "1000000" if legacy == "penalties" else f"(1000000 + CASE WHEN p IS NULL THEN 600000 ELSE {adj} END)"
        return f"CASE WHEN rule IN (1, 2) THEN {gain} * {1000 if legacy == 'transitions' else 980} ELSE 1000000000 END"
    inside = f"CASE WHEN y.pos_l IN ({', '.join(map(repr, content))}) THEN 2000000000 ELSE 1000000000 END" if content else "1000000000"
    return f"CASE rule WHEN 1 THEN {factor} * 1000000 WHEN 2 THEN CASE WHEN wl IS NOT NULL AND wr IS NOT NULL THEN (1000000 + {beta} * coalesce({adj}, 10000)) * {factor} ELSE 1000000 * {factor} END WHEN 3 THEN {inside} ELSE 1000000000 END"


def scored(w: str) -> str:
    """Scores of the pairs in `ruled`; transitions are looked up only between words of rule 2."""
    return f"""(SELECT l, r, sum(w)::BIGINT AS score FROM (
  SELECT l, r, {w} AS w FROM (SELECT x.*, a.upos AS pos_l, b.upos AS pos_r FROM ruled x LEFT JOIN tagged a ON a.doc_id = x.doc_id AND a.para_idx = x.para_idx AND a.k = x.wl
    LEFT JOIN tagged b ON b.doc_id = x.doc_id AND b.para_idx = x.para_idx AND b.k = x.wr) y
  LEFT JOIN trans t ON t.pos_l = y.pos_l AND t.pos_r = y.pos_r AND y.rule = 2) GROUP BY l, r)"""


def pair_scores(**weights) -> str:
    return sql(PARAS, WORDS, TAGGED, TRANS, SEQ, CLASSED.format(seqs="seqs"), f"SELECT * FROM {scored(weight(**weights))}")


def weighted_merges(**weights) -> str:
    parts = [PARAS, WORDS, TAGGED, TRANS, SEQ.replace("seqs AS", "s0 AS")]
    for i in range(STEPS):
        renamed = CLASSED.format(seqs=f"s{i}")
        for name in ("toks", "near", "ruled"):
            renamed = renamed.replace(f"{name} AS", f"{name}{i} AS").replace(f"FROM {name}", f"FROM {name}{i}")
        parts.append(renamed)
        parts.append(f"m{i} AS MATERIALIZED (SELECT {i}::BIGINT AS rank, l, r, score FROM {scored(weight(**weights)).replace('FROM ruled', f'FROM ruled{i}')} ORDER BY score DESC, l, r LIMIT 1)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT doc_id, lang, para_idx, replace(seq, '⟨' || l || '⟩⟨' || r || '⟩', '⟨' || l || r || '⟩') AS seq FROM s{i}, m{i})")
    return sql(*parts, " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(STEPS)))


def plain_merges(first: str, count: str, *before: str) -> str:
    parts = [*before, f"s0 AS MATERIALIZED ({first})"]
    for i in range(STEPS):
        parts.append(f"t{i} AS (SELECT f, string_split(seq[2:-2], '⟩⟨') AS l FROM s{i})")
        parts.append(f"m{i} AS MATERIALIZED (SELECT {i}::BIGINT AS rank, a AS l, b AS r, {count}::BIGINT AS n FROM (SELECT f, unnest(l[:-2]) AS a, unnest(l[2:]) AS b FROM t{i}) WHERE b IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT f, replace(seq, '⟨' || l || '⟩⟨' || r || '⟩', '⟨' || l || r || '⟩') AS seq FROM s{i}, m{i})")
    return sql(*parts, " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(STEPS)))


# ------------------------------------------------------------------------- stems and gold

STEM = """(CASE WHEN instr({w}, {l}) > 0 THEN {{'first': instr({w}, {l}) - 1, 'last': instr({w}, {l}) - 1 + length({l})}}
  ELSE (SELECT {{'first': i - 1, 'last': i - 1 + n}} FROM (SELECT i, n FROM range(1, length({w}) + 1) a(i), range(3, length({w}) + 1) b(n)
    WHERE i + n - 1 <= length({w}) AND instr({l}, substring({w}, i, n)) > 0 ORDER BY n DESC, i LIMIT 1)) END)"""
SPANS = f"""pairs AS (SELECT surface, lemma, count(*) AS n FROM tagged WHERE NOT {HELD} AND regexp_matches(surface, {WORD}) AND lemma <> '' GROUP BY ALL),
spans AS MATERIALIZED (SELECT form, word, n, s.first AS first, s.last AS last, list_sort(list_filter([s.first, s.last], lambda c: c > 0 AND c < length(word))) AS cuts
  FROM (SELECT lower(surface) AS form, surface AS word, n, {STEM.format(w='lower(surface)', l='lower(lemma)')} AS s FROM pairs) WHERE s IS NOT NULL)"""
LEXICON = "lexicon AS MATERIALIZED (SELECT form, cuts FROM (SELECT form, cuts, row_number() OVER (PARTITION BY form ORDER BY sum(n) DESC, cuts) AS rn FROM spans GROUP BY form, cuts) WHERE rn = 1)"
AFFIXES = f"""affixes AS MATERIALIZED (SELECT kind, affix, sum(n)::BIGINT AS n FROM (
  SELECT 'prefix' AS kind, left(form, first::INT) AS affix, n FROM spans UNION ALL SELECT 'suffix', substring(form, last::INT + 1), n FROM spans) WHERE affix <> '' GROUP BY kind, affix HAVING sum(n) >= {MIN_COUNT})"""
SEGMENTS = f"""vocabulary AS MATERIALIZED (SELECT DISTINCT surface AS word FROM words WHERE regexp_matches(surface, {WORD})),
behind AS (SELECT word, max(length(affix)) AS ns FROM vocabulary, affixes WHERE kind = 'suffix' AND ends_with(lower(word), affix) AND length(word) - length(affix) >= 3 GROUP BY word),
ended AS (SELECT word, ns, length(word) - coalesce(ns, 0) AS hi FROM vocabulary LEFT JOIN behind USING (word)),
ahead AS (SELECT word, max(length(affix)) AS lo FROM ended, affixes WHERE kind = 'prefix' AND starts_with(left(lower(word), hi), affix) AND hi - length(affix) >= 3 GROUP BY word),
cut AS (SELECT word, form IS NOT NULL AS known, list_sort(CASE WHEN form IS NOT NULL THEN cuts::BIGINT[] ELSE list_filter([lo, CASE WHEN ns IS NOT NULL THEN hi END], lambda c: c IS NOT NULL) END) AS cuts
  FROM ended LEFT JOIN ahead USING (word) LEFT JOIN lexicon ON form = lower(word)),
segments AS MATERIALIZED (SELECT word, known, cuts, list_transform(range(1, len(ends)), lambda i: substring(word, ends[i] + 1, ends[i + 1] - ends[i])) AS pieces
  FROM (SELECT *, list_concat([0], list_filter(cuts, lambda c: c > 0 AND c < length(word)), [length(word)]) AS ends FROM cut))"""
L2W = (PARAS, WORDS, TAGGED, SPANS, LEXICON, AFFIXES, SEGMENTS)


def _gold() -> str:
    after = "CASE " + " ".join(f"WHEN length(surface) >= {len(e) + 3} AND ends_with(lower(surface), '{e}') THEN right(surface, {len(e)})" for e in FOLLOWING) + " ELSE '' END"
    before = "CASE " + " ".join(f"WHEN length(rest) >= {len(e) + 3} AND starts_with(lower(rest), '{e}') THEN left(rest, {len(e)})" for e in PREFIXES) + " ELSE '' END"
    return f"""raw AS (SELECT surface, count(*) AS freq, min(upos) AS pos, min(lemma) AS lemma, {after} AS post FROM tagged WHERE regexp_matches(surface, {WORD}) GROUP BY surface),
cutoff AS (SELECT *, left(surface, length(surface) - length(post)) AS rest FROM raw),
parts AS (SELECT *, {before} AS pre FROM cutoff),
source AS (SELECT surface AS word, pre, substring(rest, length(pre) + 1) AS stem, post, freq, pos,
  CASE WHEN substring(md5(surface), 2, 1) < '8' THEN lower(substring(rest, length(pre) + 1)) ELSE lemma END AS lemma, CASE WHEN left(md5(surface), 1) IN ('0', '1') THEN 'test' ELSE 'train' END AS split FROM parts WHERE length(surface) > 2),
gold AS MATERIALIZED (SELECT word, list_filter([CASE WHEN pre <> '' THEN length(pre) END, CASE WHEN post <> '' THEN length(pre) + length(stem) END], lambda c: c IS NOT NULL) AS cuts, split, freq::DOUBLE AS freq, pos, lemma
  FROM source WHERE lower(lemma) = lower(stem) AND lower(pre || stem || post) = lower(word) AND length(word) >= 2)"""


GOLD = _gold()
PIECES = f"pieces AS MATERIALIZED (SELECT word, {tokens(encoded(chr(39).join(['regexp_replace(word, ', '(.)', ', ', '⟨' + chr(92) + '1⟩', ', ', 'gs', ')']), MERGES))} AS pieces FROM gold)"


def predicted(pieces: str, name: str = "preds") -> str:
    ends = "[list_sum(list_transform(pieces[1:i], lambda t: length(replace(t, '▁', ''))))::BIGINT FOR i IN range(1, len(pieces) + 1)]"
    return f"""{name} AS MATERIALIZED (SELECT *, len(list_intersect(cuts, pred)) AS tp, len(list_filter(pred, lambda c: NOT list_contains(cuts, c))) AS fp, len(list_filter(cuts, lambda c: NOT list_contains(pred, c))) AS fn FROM (
  SELECT word, gold.cuts::BIGINT[] AS cuts, split, freq, len(pieces) AS n_pieces, list_filter(list_distinct({ends}), lambda c: c > 0 AND c < length(word)) AS pred, lower(word) IN (SELECT form FROM seen) AS seen
  FROM gold JOIN {pieces} USING (word) WHERE replace(array_to_string(pieces, ''), '▁', '') = word))"""


def _prf_columns() -> list[str]:
    out = []
    for w, x in (("", "1.0"), ("weighted_", "freq")):
        tp, fp, fn = (f"sum({x} * {c})" for c in ("tp", "fp", "fn"))
        p = f"CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp}) END"
        r = f"CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn}) END"
        out += [f"round(({p})::DOUBLE, 6) AS {w}precision", f"round(({r})::DOUBLE, 6) AS {w}recall", f"round((CASE WHEN ({p}) + ({r}) = 0 THEN 0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END)::DOUBLE, 6) AS {w}f1"]
    return [*out, "count(*) AS n_words", "round(avg(n_pieces), 6) AS tokens_per_word"]


PRF = ", ".join(_prf_columns())
SUBSETS = "(SELECT *, unnest(list_filter(['all', CASE WHEN split = 'test' THEN 'test_split' END, CASE WHEN seen THEN 'seen' ELSE 'unseen' END], lambda x: x IS NOT NULL)) AS subset FROM {0})"
SCORED = (PARAS, WORDS, TAGGED, GOLD, SEEN, PIECES, predicted("pieces"))

# --------------------------------------------------------------------------- running text

EDGES = """places AS (SELECT doc_id, para_idx, lang, unnest(tokens) AS token, unnest([list_sum(list_transform(tokens[1:i], lambda t: length(t)))::BIGINT FOR i IN range(1, len(tokens) + 1)]) AS stop FROM seg),
edges AS MATERIALIZED (SELECT a.lang, a.doc_id, a.para_idx, a.upos AS pos_l, b.upos AS pos_r, p.token FROM tagged a JOIN tagged b ON b.doc_id = a.doc_id AND b.para_idx = a.para_idx AND b.k = a.k + 1
  JOIN places p ON p.doc_id = a.doc_id AND p.para_idx = a.para_idx AND a."end" < p.stop AND a."end" >= p.stop - length(p.token))"""
HELD_TEXT = (PARAS, WORDS, TAGGED, TRAIN_TRANS, SEQ, segmented("seg", TEST_SEQ), EDGES)
INNER = "contains(trim(token, '▁'), '▁')"


def span_query(strict: bool) -> str:
    spanned = INNER + (" AND NOT ends_with(token, '▁')" if strict else "")
    return sql(*HELD_TEXT, f"""SELECT lang, round(sum(coalesce(p, 0)) / count(*), 6) AS p_all, round(coalesce(sum(coalesce(p, 0)) FILTER ({spanned}), 0) / greatest(1, count(*) FILTER ({spanned})), 6) AS p_span,
  round(count(*) FILTER ({spanned}) / count(*), 6) AS share_span FROM edges LEFT JOIN trans USING (pos_l, pos_r) GROUP BY lang""")


def seed_parts() -> list[str]:
    return [segmented(f"seg{s}", TEST_SEQ, seed_merges(s)) for s in SEEDS]


def seed_pairs() -> list[tuple[int, int]]:
    return [(a, b) for a in SEEDS for b in SEEDS if a < b]


def ends_of(t: str) -> str:
    return f"list_filter(list_distinct([list_sum(list_transform({t}[1:i], lambda x: length(replace(x, '▁', ''))))::BIGINT FOR i IN range(1, len({t}) + 1)]), lambda c: c > 0)"


def agreement() -> str:
    parts = [PARAS, SEQ, *seed_parts(), *[f"c{s} AS MATERIALIZED (SELECT doc_id, para_idx, lang, {ends_of('tokens')} AS cuts FROM seg{s})" for s in SEEDS]]
    each = [
        f"SELECT lang, {a}::BIGINT AS a, {b}::BIGINT AS b, round(2 * sum(s) / (2 * sum(s) + sum(d)), 6) AS agreement FROM (SELECT x.lang, len(list_intersect(x.cuts, y.cuts)) AS s, len(x.cuts) + len(y.cuts) - 2 * len(list_intersect(x.cuts, y.cuts)) AS d FROM c{a} x JOIN c{b} y USING (doc_id, para_idx)) GROUP BY lang"
        for a, b in seed_pairs()
    ]
    return sql(*parts, " UNION ALL ".join(each))


def jaccard() -> str:
    parts = [PARAS, SEQ, *seed_parts(), "v AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT lang, {s}::BIGINT AS seed, unnest(tokens) AS token FROM seg{s}" for s in SEEDS) + ")"]
    return sql(*parts, """sizes AS (SELECT lang, seed, count(*) AS n FROM v GROUP BY ALL)""", """SELECT x.lang, x.seed AS a, y.seed AS b, coalesce(c.common, 0) AS common, x.n + y.n - coalesce(c.common, 0) AS "either", round(coalesce(c.common, 0) / (x.n + y.n - coalesce(c.common, 0)), 6) AS jaccard
  FROM sizes x JOIN sizes y ON x.lang = y.lang AND x.seed < y.seed LEFT JOIN (SELECT p.lang, p.seed AS a, q.seed AS b, count(*) AS common FROM v p JOIN v q ON p.lang = q.lang AND p.token = q.token AND p.seed < q.seed GROUP BY ALL) c ON c.lang = x.lang AND c.a = x.seed AND c.b = y.seed""")


VOCABS = (PARAS, SEQ, segmented("sega", "seqs"), segmented("segb", "seqs", seed_merges(1)), *(f"{v} AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM {g}) GROUP BY token)" for v, g in (("va", "sega"), ("vb", "segb"))))


def kl(a: str, b: str) -> str:
    return f"(SELECT round(sum(p * log2(p / q)), 6) AS kl FROM (SELECT least(1.0, greatest(1e-9, coalesce(x.p, 0.0))) AS p, least(1.0, greatest(1e-9, coalesce(y.q, 0.0))) AS q FROM (SELECT token, n / sum(n) OVER () AS p FROM {a}) x FULL JOIN (SELECT token, n / sum(n) OVER () AS q FROM {b}) y USING (token)))"


def length_stats(rows: str, by: str = "") -> str:
    k, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT {k}round(sum(size * n) / sum(n), 6) AS avg_len, round(-sum(share * log2(share)), 6) AS entropy FROM (SELECT *, n / sum(n) OVER ({part}) AS share FROM (SELECT {k}length(replace(token, '▁', '')) AS size, count(*) AS n FROM {rows} GROUP BY ALL) WHERE size > 0) {group})"


def _runs() -> str:
    parts = []
    for method, budget, merges in variants():
        parts.append(f"SELECT lang, '{method}' AS method, {budget} AS budget, doc_id, para_idx, length(text) AS chars, len(string_split(text, ' ')) AS w, len({tokens(encoded('seq', merges))}) AS t FROM seqs")
    seeds = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {s} AS seed, doc_id, para_idx FROM paras WHERE left({key(s)}, 1) < '8'" for s in SEEDS) + ")"
    return f"""enc AS MATERIALIZED ({' UNION ALL '.join(parts)}), samples AS MATERIALIZED ({seeds}),
wide AS (SELECT lang, method, seed, budget, sum(t) / sum(w) AS tokens_per_word, sum(chars) / sum(t) AS chars_per_token FROM enc JOIN samples USING (doc_id, para_idx) GROUP BY ALL),
runs AS MATERIALIZED (SELECT lang, method, seed, budget, 'tokens_per_word' AS metric, tokens_per_word AS value FROM wide UNION ALL SELECT lang, method, seed, budget, 'chars_per_token', chars_per_token FROM wide)"""


RUNS = (PARAS, SEQ, _runs())
LAST = f"metric = 'tokens_per_word' AND budget = {BUDGETS[-1]}"
REPLIES = f"""lines AS MATERIALIZED (SELECT doc_id * 100000 + para_idx AS reply_id, k AS line, surface AS word,
  CASE WHEN left(md5(surface || doc_id), 1) < '{ANSWER_CUT}' AND length(surface) > 3 THEN left(surface, 3) || '+' || substring(surface, 4) WHEN length(surface) > 4 THEN left(surface, 2) || '+x' ELSE surface END AS segmentation FROM words)"""
ANSWERS = "answers AS MATERIALIZED (SELECT word, segmentation, valid FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY valid DESC, reply_id DESC, line DESC) AS rn FROM (SELECT *, replace(segmentation, '+', '') = word AS valid FROM lines WHERE word IN (SELECT word FROM gold))) WHERE rn = 1)"
IDS = (PARAS, SEQ, segmented("seg", TRAIN_SEQ), "ids AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT unnest(tokens) AS token FROM seg))")
CONTENT = METHODS["pos_content"]["content"]

ORACLES = {
    "paragraph_extract": sql(PARAS, "SELECT * FROM paras"),
    "corpus_dedupe_split": sql(PARAS, f"SELECT lang, text, CASE WHEN rn <= 4000 THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY key) AS rn FROM (SELECT lang, text, min({key(0)}) AS key FROM paras GROUP BY lang, text)) WHERE rn <= 4500"),
    "word_offsets": sql(PARAS, WORDS, "SELECT * FROM words"),
    "annotate_words": sql(PARAS, WORDS, TAGGED, "SELECT * FROM tagged"),
    "align_tags_interval_join": sql(
        PARAS, WORDS, f"cores AS MATERIALIZED (SELECT *, CASE WHEN core = '' THEN 0 ELSE instr(surface, core) - 1 END AS lead_ FROM {cored('words')})",
        # The annotator's tokens keep the number of their word, which the tested query does not know.
        f"""tokens AS (SELECT doc_id, para_idx, k, start + lead_ AS tok_start, {upos('k', 'core')} AS upos, {lemma('core')} AS lemma FROM cores WHERE core <> ''
  UNION ALL SELECT doc_id, para_idx, k, start + i - 1, 'PUNCT', mark FROM (SELECT *, unnest(string_split(surface, '')) AS mark, generate_subscripts(string_split(surface, ''), 1) AS i FROM cores) WHERE i - 1 < lead_ OR i - 1 >= lead_ + length(core))""",
        "met AS (SELECT doc_id, para_idx, k, upos, lemma, row_number() OVER (PARTITION BY doc_id, para_idx, k ORDER BY upos = 'PUNCT', tok_start) AS rn FROM tokens)",
        'SELECT doc_id, para_idx, k, surface, coalesce(upos, \'X\') AS upos, coalesce(lemma, surface) AS lemma, start, "end" FROM words LEFT JOIN (SELECT * FROM met WHERE rn = 1) USING (doc_id, para_idx, k)',
    ),
    "surface_majority_pos": sql(PARAS, WORDS, TAGGED, "SELECT surface, upos, n FROM (SELECT surface, upos, count(*) AS n, row_number() OVER (PARTITION BY surface ORDER BY count(*) DESC, upos) AS rn FROM tagged GROUP BY surface, upos) WHERE rn = 1"),
    "pos_transitions": sql(PARAS, WORDS, TAGGED, TRANS, "SELECT pos_l, pos_r, n, p FROM trans"),
    "pos_reward_factors": sql(PARAS, WORDS, TAGGED, TRANS, "SELECT pos_l || '->' || pos_r AS key, least(greatest(p, 0.01), 0.95) AS p, round(1.6 - least(greatest(p, 0.01), 0.95), 4) AS factor FROM trans"),
    "legacy_sentence_transitions": sql(
        r"lines AS (SELECT row_number() OVER () AS s, text FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS text FROM benchmark) WHERE text <> '')",
        "w AS (SELECT s, unnest(string_split(text, ' ')) AS surface, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM lines)",
        f"t AS (SELECT s, k, {upos('k', 'core')} AS upos FROM {cored('w')})", f"SELECT * FROM {counted('t', 's')}",
    ),
    "event_transitions": "SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b)",
    "symbol_sequence": sql(PARAS, SEQ, "SELECT doc_id, para_idx, seq FROM seqs"),
    "adjacent_pair_counts": sql(PARAS, SEQ, "t AS (SELECT string_split(seq[2:-2], '⟩⟨') AS l FROM seqs)", "SELECT a AS l, b AS r, count(*) AS n FROM (SELECT unnest(l[:-2]) AS a, unnest(l[2:]) AS b FROM t) WHERE b IS NOT NULL GROUP BY a, b"),
    "pair_scores_pos": pair_scores(beta=1, factor=980),
    "pair_scores_penalty": pair_scores(factor=980),
    "pair_scores_content": pair_scores(content=CONTENT),
    "pair_scores_legacy": pair_scores(legacy=True),
    "bpe_merges_k8": plain_merges("SELECT 1 AS f, seq FROM seqs", "count(*)", PARAS, SEQ),
    "posbpe_merges_k8": weighted_merges(beta=1, factor=980),
    "content_bpe_merges_k8": weighted_merges(content=CONTENT),
    "word_initial_bpe_merges_k8": plain_merges("SELECT count(*) AS f, regexp_replace('▁' || surface, '(.)', '⟨\\1⟩', 'gs') AS seq FROM words GROUP BY surface", "sum(f)", PARAS, WORDS),
    "bpe_encode": sql(PARAS, SEQ, segmented("seg", "seqs"), "SELECT doc_id, para_idx, array_to_string(tokens, ' ') AS tokens FROM seg"),
    "encode_with_breaks": sql(*L2W, f"SELECT word, array_to_string(list_filter({tokens(encoded('seq', MERGES))}, lambda t: t <> '␀'), ' ') AS tokens FROM (SELECT word, array_to_string(list_transform(pieces, lambda p: regexp_replace(p, '(.)', '⟨\\1⟩', 'gs')), '⟨␀⟩') AS seq FROM segments)"),
    "l2w_lexicon": sql(*L2W, "SELECT form, array_to_string(cuts, ',') AS cuts FROM lexicon"),
    "l2w_affixes": sql(*L2W, "SELECT kind, affix, n FROM affixes"),
    "l2w_segment": sql(*L2W, "SELECT word, array_to_string(cuts, ',') AS cuts, array_to_string(pieces, ',') AS pieces, known FROM segments"),
    "l2w_online_cuts": sql(*L2W, f"""SELECT word, array_to_string(coalesce(CASE WHEN s IS NOT NULL THEN list_sort(list_filter([s.first, s.last], lambda c: c > 0 AND c < length(word))) END, cuts), ',') AS cuts
  FROM (SELECT surface AS word, {STEM.format(w='lower(surface)', l='lower(lemma)')} AS s FROM (SELECT surface, min(lemma) AS lemma FROM tagged WHERE regexp_matches(surface, {WORD}) GROUP BY surface)) LEFT JOIN segments USING (word)"""),
    "lcs_stem": sql(PARAS, WORDS, f"""pairs AS (SELECT DISTINCT a, b FROM (SELECT lower(surface) AS a, lower(lead(surface) OVER (PARTITION BY doc_id, para_idx ORDER BY k)) AS b FROM words) WHERE b IS NOT NULL AND regexp_matches(a, {WORD}) AND regexp_matches(b, {WORD})),
parts AS (SELECT a, b, i, n FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM pairs), range(3, 60) r(n) WHERE i + n - 1 <= length(a) AND instr(b, substring(a, i, n)) > 0),
best AS (SELECT a, b, arg_min({{'i': i, 'n': n}}, -n * 1000 + i) AS x FROM parts GROUP BY a, b)""",
        "SELECT a, b, CASE WHEN instr(a, b) > 0 THEN instr(a, b) - 1 ELSE x.i - 1 END AS first, CASE WHEN instr(a, b) > 0 THEN instr(a, b) - 1 + length(b) ELSE x.i - 1 + x.n END AS last FROM pairs LEFT JOIN best USING (a, b) WHERE instr(a, b) > 0 OR x IS NOT NULL"),
    "gold_items": sql(PARAS, WORDS, TAGGED, GOLD, "SELECT word, array_to_string(cuts, ',') AS cuts, split, freq, pos, lemma FROM gold"),
    "boundary_prf": sql(*SCORED, f"SELECT precision, recall, f1, n_words, tokens_per_word FROM (SELECT {PRF} FROM preds)"),
    "boundary_prf_weighted": sql(*SCORED, f"SELECT weighted_precision, weighted_recall, weighted_f1, n_words FROM (SELECT {PRF} FROM preds)"),
    "boundary_prf_subsets": sql(*SCORED, f"SELECT subset, {PRF} FROM {SUBSETS.format('preds')} GROUP BY subset"),
    "compression_metrics": sql(*HELD_TEXT, f"""a AS (SELECT lang, sum(len(tokens)) AS t, sum(length(text) - length(replace(text, ' ', '')) + 1) AS w FROM seg GROUP BY lang),
b AS (SELECT lang, sum(length(replace(token, '▁', ''))) AS c, count(*) FILTER (starts_with(token, '▁') AND replace(token, '▁', '') <> '') AS lead_, count(*) FILTER (ends_with(token, '▁') AND replace(token, '▁', '') <> '') AS trail,
  count(*) FILTER ({INNER}) AS crossing FROM places GROUP BY lang),
e AS (SELECT lang, count(*) AS n, sum(coalesce(p, 0)) AS p, count(*) FILTER (length(token) > 1) AS an, coalesce(sum(coalesce(p, 0)) FILTER (length(token) > 1), 0) AS ap FROM edges LEFT JOIN trans USING (pos_l, pos_r) GROUP BY lang)""",
        """SELECT lang, round(t / w, 6) AS tokens_per_word, round(c / t, 6) AS chars_per_token, round(lead_ / t, 6) AS share_leading_marker, round(trail / t, 6) AS share_trailing_marker, round(crossing / t, 6) AS share_cross_word,
  round(coalesce(an, 0) / greatest(1, coalesce(n, 0)), 6) AS boundaries_absorbed, round(coalesce(p, 0) / greatest(1, coalesce(n, 0)), 6) AS mean_transition_p_all, round(coalesce(ap, 0) / greatest(1, coalesce(an, 0)), 6) AS mean_transition_p_absorbed FROM a JOIN b USING (lang) LEFT JOIN e USING (lang)"""),
    "boundary_absorption": sql(*HELD_TEXT, "SELECT lang, pos_l, pos_r, count(*) AS n, count(*) FILTER (length(token) > 1) AS absorbed FROM edges GROUP BY ALL"),
    "span_diagnostics": span_query(False),
    "span_diagnostics_strict": span_query(True),
    "top_spanned": sql(*HELD_TEXT, f"SELECT lang, what, value, n FROM (SELECT *, row_number() OVER (PARTITION BY lang, what ORDER BY n DESC, value) AS rn FROM (SELECT lang, what, value, count(*) AS n FROM (SELECT lang, 'token' AS what, token AS value FROM edges WHERE {INNER} UNION ALL SELECT lang, 'transition', pos_l || '->' || pos_r FROM edges WHERE {INNER}) GROUP BY lang, what, value)) WHERE rn = 1"),
    "seed_jaccard": jaccard(),
    "seed_agreement": agreement(),
    "vocab_report": sql(*VOCABS, "a AS (SELECT token, 1 AS n FROM va), b AS (SELECT token, 1 AS n FROM vb)", f"""SELECT 'seed0' AS model, (SELECT count(*) FROM a) AS size, (SELECT count(*) FROM b) AS base_size, (SELECT count(*) FROM a JOIN b USING (token)) AS common,
  round((SELECT count(*) FROM a JOIN b USING (token)) / (SELECT count(*) FROM (SELECT token FROM a UNION SELECT token FROM b)), 6) AS jaccard, l.avg_len, m.avg_len AS base_avg_len, l.entropy, m.entropy AS base_entropy, k.kl FROM {length_stats('a')} l, {length_stats('b')} m, {kl('a', 'b')} k"""),
    "vocab_kl": sql(*VOCABS, f"SELECT kl FROM {kl('va', 'vb')}"),
    "length_entropy": sql(PARAS, SEQ, segmented("seg", "seqs"), "v AS (SELECT DISTINCT lang, unnest(tokens) AS token FROM seg)", f"SELECT * FROM {length_stats('v', 'lang')}"),
    "run_metrics_mean_sd": sql(*RUNS, "SELECT lang, method, budget::BIGINT AS budget, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n FROM runs GROUP BY ALL"),
    "best_method": sql(*RUNS, f"SELECT lang, method, mean FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean, method) AS rn FROM (SELECT lang, method, round(avg(value), 6) AS mean FROM runs WHERE {LAST} GROUP BY ALL)) WHERE rn = 1"),
    "metric_pivot": sql(*RUNS, "SELECT method, " + ", ".join(f"round(avg(value) FILTER (lang = '{x}'), 6) AS {x}" for x in ("de", "en", "es", "fr")) + f" FROM runs WHERE {LAST} GROUP BY method"),
    "budget_sweep": sql(*RUNS, "SELECT lang, method, " + ", ".join(f"round(avg(value) FILTER (budget = {b}), 6) AS b{b}" for b in BUDGETS) + " FROM runs WHERE metric = 'tokens_per_word' GROUP BY lang, method"),
    "runs_per_cell": sql(*RUNS, "SELECT runs, count(*) AS cells FROM (SELECT count(DISTINCT seed) AS runs FROM runs GROUP BY lang, method, budget) GROUP BY runs"),
    "data_statistics": sql(PARAS, WORDS, TAGGED, GOLD, SEEN, f"SELECT lang, count(*) AS paragraphs, round(avg(w) FILTER (NOT held), 6) AS mean_train_words, coalesce(sum(w) FILTER (held), 0)::BIGINT AS test_words, (SELECT count(*) FROM gold) AS gold_words, (SELECT count(*) FROM gold WHERE split = 'test') AS gold_test, (SELECT count(*) FROM gold WHERE lower(word) NOT IN (SELECT form FROM seen)) AS gold_unseen FROM (SELECT lang, len(string_split(text, ' ')) AS w, {HELD} AS held FROM paras) GROUP BY lang"),
    "l2w_variant_report": sql(*L2W, GOLD, SEEN, predicted("segments", "lexical"), f"""onl AS (SELECT word, list_transform(range(1, len(ends)), lambda i: substring(word, ends[i] + 1, ends[i + 1] - ends[i])) AS pieces FROM (SELECT word, list_concat([0], list_filter(c, lambda x: x > 0 AND x < length(word)), [length(word)]) AS ends
  FROM (SELECT g.word, coalesce(CASE WHEN s IS NOT NULL THEN list_sort(list_filter([s.first, s.last], lambda c: c > 0 AND c < length(g.word))) END, segments.cuts) AS c FROM (SELECT word, {STEM.format(w='lower(word)', l='lower(lemma)')} AS s FROM gold) g LEFT JOIN segments USING (word))))""",
        predicted("onl", "ahead_of"), f"scores AS (SELECT 'lexicon' AS variant, subset, {PRF} FROM {SUBSETS.format('lexical')} GROUP BY subset UNION ALL SELECT 'online', subset, {PRF} FROM {SUBSETS.format('ahead_of')} GROUP BY subset)",
        "long AS (SELECT variant, subset, 'precision' AS metric, precision AS value FROM scores UNION ALL SELECT variant, subset, 'recall', recall FROM scores UNION ALL SELECT variant, subset, 'f1', f1 FROM scores)",
        "SELECT variant, metric, " + ", ".join(f"round(avg(value) FILTER (subset = '{x}'), 6) AS \"{x}\"" for x in ("all", "seen", "test_split", "unseen")) + " FROM long GROUP BY variant, metric"),
    "example_picks": sql(PARAS, WORDS, TAGGED, GOLD, SEEN, PIECES, """picks AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY word) AS rn, count(*) OVER (PARTITION BY split) AS n FROM gold
  WHERE length(word) BETWEEN 8 AND 14 AND len(cuts) > 0 AND word = lower(word) AND word NOT IN (SELECT form FROM seen))""",
        "SELECT split, word, array_to_string(list_filter(list_transform(pieces, lambda p: replace(p, '▁', '')), lambda p: p <> ''), '|') AS pieces FROM picks JOIN pieces USING (word) WHERE n < 3 OR rn IN (1, n // 2 + 1, n)"),
    "token_ids": sql(*IDS, "SELECT token, id FROM ids"),
    "token_id_stream": sql(*IDS, segmented("held", TEST_SEQ), "SELECT id, count(*) AS n FROM (SELECT coalesce(id, 1) AS id FROM (SELECT unnest(tokens) AS token FROM held) LEFT JOIN ids USING (token) UNION ALL SELECT 0 FROM held) GROUP BY id"),
    "ctx_windows": sql(PARAS, SEQ, segmented("seg", TEST_SEQ), "total AS (SELECT lang, sum(len(tokens) + 1)::BIGINT AS total FROM seg GROUP BY lang)", 'SELECT lang, i AS "window", least(128, total - 1 - i * 128) AS n FROM (SELECT lang, total, unnest(range(0, (total - 2) // 128 + 1)) AS i FROM total WHERE total > 1)'),
    "ngram_bits_per_char": sql(PARAS, SEQ, segmented("train", TRAIN_SEQ), segmented("test", TEST_SEQ), """big AS (SELECT lang, unnest(list_concat(['</s>'], tokens)) AS l, unnest(list_concat(tokens, ['</s>'])) AS r FROM train),
seen AS MATERIALIZED (SELECT lang, l, r, count(*) AS n FROM big GROUP BY ALL), lefts AS (SELECT lang, l, sum(n) AS nl FROM seen GROUP BY ALL), sizes AS (SELECT lang, count(DISTINCT r) + 1 AS v FROM seen GROUP BY lang),
asked AS (SELECT lang, l, r, count(*) AS m FROM (SELECT lang, unnest(list_concat(['</s>'], tokens)) AS l, unnest(list_concat(tokens, ['</s>'])) AS r FROM test) GROUP BY ALL),
nll AS (SELECT lang, sum(-m * ln((coalesce(n, 0) + 1) / (coalesce(nl, 0) + v))) AS nll, sum(m)::BIGINT AS tokens FROM asked LEFT JOIN seen USING (lang, l, r) LEFT JOIN lefts USING (lang, l) JOIN sizes USING (lang) GROUP BY lang)""",
        "SELECT lang, tokens, chars, round(nll / 0.6931471805599453 / chars, 6) AS bits_per_char FROM nll JOIN (SELECT lang, sum(length(text) + 1)::BIGINT AS chars FROM test GROUP BY lang) USING (lang)"),
    "llm_reply_parse": sql(PARAS, WORDS, TAGGED, GOLD, REPLIES, ANSWERS, "SELECT word, segmentation, valid FROM answers"),
    "llm_prf": sql(PARAS, WORDS, TAGGED, GOLD, SEEN, REPLIES, ANSWERS, "split_ AS (SELECT word, string_split(segmentation, '+') AS pieces FROM answers WHERE valid)", predicted("split_"), f"SELECT {PRF} FROM preds"),
    "cache_antijoin": sql(PARAS, WORDS, SEEN, f"SELECT DISTINCT lower(surface) AS form FROM words WHERE {HELD} AND lower(surface) NOT IN (SELECT form FROM seen)"),
    "latest_answer": sql(PARAS, WORDS, REPLIES, 'SELECT word, "at", segmentation FROM (SELECT word, reply_id * 10000 + line AS "at", segmentation, row_number() OVER (PARTITION BY word ORDER BY reply_id DESC, line DESC) AS rn FROM lines) WHERE rn = 1'),
}
