"""Secret scanning with a random forest that removes false positives. DataFrame operations only.

Candidates are long runs of key characters, and shorter or other ones that follow a sign of assignment.
Each has its length, its character classes and how often they change, how likely its character
transitions are in plain text, the share that dictionary words cover, whether it lies in a path
or address, and the words around it. A random forest, trained from labelled findings, keeps the
candidates that look like secrets.

The transitions are a table of pairs of letters, digits and other signs, counted in all
documents by `transitions()`; without one, all are alike.

`findings()` makes labelled findings from seeded hashes, so that the operator works without a table
of one's own; its size is the bound of the training sample. A table of real findings (before,
candidate, after, secret) takes its place.

Defined results: null and empty texts have no candidates; very long texts are read whole, in time linear in
their length; repeated rows are read each; a candidate found twice is reported twice;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import _located

CANDIDATE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}|(?<=[=:]|[=:][\"']|[=:]\x20|[=:]\x20[\"'])(?=[^\x20\x09-\x0D\"']{0,63}[0-9])(?=[^\x20\x09-\x0D\"']{0,63}[A-Za-z])[^\x20\x09-\x0D\"'=:]{8,64}+"
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Bytes of a text whose pairs are counted at once.
PIECE = 4096

#: Words that identifiers, paths and placeholders are made of.
DICTIONARY = (
    "access account action address admin after agent algorithm application array async author available before block body buffer build button bytes cache "
    "callback change channel character check child class client code column command commit common component config connection console constant container content "
    "context control controller convert count create current custom data database date debug default delete description detail device dialog directory display "
    "document domain download draw driver dummy element email enable encode engine entity entry error event example exception execute export factory field file "
    "filter folder format forward frame from function gateway generic global graph group handler header height hello here host html http identifier image import "
    "index information initial input insert instance integer interface internal item iterator json kernel label language layer layout length level library limit line "
    "list load local location lock logger login main manager map mapping master match memory menu merge message meta method model module mount name network "
    "node number object offset operation option order output package page panel parameter parent parse password path pattern payload performance placeholder "
    "plugin point policy pool port position prefix private process product profile program project property protocol provider proxy public query queue random "
    "range read record reference refresh region register release remote remove render report request resource response result return root route sample scan schema "
    "scope screen script search secret section select sender sequence server service session set setting shape share signal simple size software source space "
    "start state static status storage store stream string style subject submit success super support switch system table target task template test text thread "
    "time title token total track transfer transform tree type update upload user util utils value variable vector version view visible web widget width window "
    "with worker wrapper write your"
).split()
_FOR = "token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private|access.?key|signing"
_AGAINST = "commit|sha[0-9]*|hash|md5|uuid|guid|digest|checksum|example|sample|dummy|placeholder|revision|integrity|etag|https?:|import|include"

#: name: SQL over c (candidate), b (text before), a (text after).
_LETTERS = "length(regexp_replace(c, '[^A-Za-z]', ''))"
_CLASSES = "regexp_replace(regexp_replace(regexp_replace(c, '[0-9]', '0'), '[a-z]', 'a'), '[A-Z]', 'A')"
FEATURES = {
    "size": "length(c)",
    "digits": "length(regexp_replace(c, '[^0-9]', '')) / length(c)",
    "upper": "length(regexp_replace(c, '[^A-Z]', '')) / length(c)",
    "marks": "length(regexp_replace(c, '[A-Za-z0-9]', '')) / length(c)",
    "changes": f"regexp_count({_CLASSES}, '0(?=[aA])|a(?=[0A])|A(?=[0a])') / length(c)",
    "vowels": f"length(regexp_replace(c, '[^AEIOUaeiou]', '')) / greatest(1, {_LETTERS})",
    "rare": "regexp_count(lower(c), '[bcdfghjklmnpqrstvwxz]{4,}|[jqxz](?=[bcdfghjklmnpqrstvwxz])|[a-z][0-9](?=[a-z])') / length(c)",
    "likely": "CASE WHEN length(c) > 1 THEN aggregate(sequence(1, length(c) - 1), 0D, (t, i) -> t + element_at(table, 1 + 37 * instr('" + SIGNS + "', substr(lower(c), i, 1)) + instr('" + SIGNS + "', substr(lower(c), i + 1, 1)))) / (length(c) - 1) ELSE 0D END",
    "distinct": "size(array_distinct(split(c, ''))) / least(32, length(c))",
    "hex": "cast(c rlike '^[0-9a-f]+$' AS int)",
    "covered": "1 - length(regexp_replace(lower(c), '" + "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)) + "', '')) / length(c)",
    "path": "cast(c rlike '/.*/' OR b rlike '[/.~]$' OR a rlike '^[.][a-z]' AS int)",
    "assigned": "cast(b rlike '[=:][ \"]*$' AS int)",
    "quoted": "cast(b rlike '[\"`]$' AS int)",
    "for_it": f"cast(lower(b) rlike '(?:{_FOR})[^a-z]*[a-z]{{0,8}}[^a-z]*$' AS int)",
    "against": f"cast(lower(b) rlike '(?:{_AGAINST})[^a-z]*[a-z]{{0,8}}[^a-z]*$' OR lower(c) rlike 'example|your|xxxx|0000|1234567' AS int)",
}


def transitions(docs: DataFrame) -> list[float]:
    """Log probability of each sign after another in `docs` (doc_id, text), by 37 * first + second; 0 is any sign but letters and digits.

    Every two neighbours in every whole text are counted, as pairs of UTF-8 bytes: a sign begins at each byte but those
    from 0x80 to 0xBF, and the byte before it ends the sign before. Pieces share a byte with the next one. CRC32 differs
    for all pairs of bytes and is a cheaper key than they are; at most 2**16 counts reach the driver."""
    texts = docs.select(F.expr("cast(lower(text) AS binary)").alias("t"))
    pieces = texts.select("t", F.explode(F.expr(f"sequence(0, cast((octet_length(t) - 2) div {PIECE} AS int))")).alias("i"))
    pieces = pieces.select(F.expr(f"substring(t, 1 + {PIECE} * i, {PIECE} + 1)").alias("p")).where(F.octet_length("p") > 1)
    pairs = pieces.select("p", F.explode(F.expr("sequence(1, octet_length(p) - 1)")).alias("i")).select(F.expr("crc32(substring(p, i, 2))").alias("k"))
    pair = {zlib.crc32(bytes((x, y))): (x, y) for x in range(256) for y in range(256)}
    counts = [1.0] * 37**2
    for r in pairs.groupBy("k").agg(F.count("*").alias("n")).collect():
        first, second = pair[r["k"]]
        if not 0x80 <= second <= 0xBF:
            counts[37 * (SIGNS.find(chr(first)) + 1) + SIGNS.find(chr(second)) + 1] += r["n"]
    return [math.log(x / sum(counts[k // 37 * 37 : k // 37 * 37 + 37])) for k, x in enumerate(counts)]


def described(rows: DataFrame, table: list[float] | None = None) -> DataFrame:
    """`rows` with b, c, a (before, candidate, after) and the features, by a table of transitions."""
    values = F.array(*[F.lit(x) for x in table]) if table else F.array_repeat(F.lit(0.0), 37**2)
    rows = rows.withColumn("table", values)
    return rows.withColumns({f"f_{k}": F.expr(v).cast("double") for k, v in FEATURES.items()}).drop("table")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, b, c, a) of each candidate in `docs` (doc_id, text)."""
    quoted = "'" + CANDIDATE.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = docs.select("doc_id", "text", F.expr(f"regexp_extract_all(text, {quoted}, 0)").alias("m")).where(F.size("m") > 0)
    rows = rows.select("doc_id", "m", F.expr(f"split(text, {quoted})").alias("g"))
    # Places are in code points.
    spans = rows.select("doc_id", "g", F.posexplode(F.expr(_located("m", "g", case=""))).alias("i", "p"))
    return spans.select("doc_id", "p.start", "p.end", F.col("p.b").alias("b"), F.col("p.m").alias("c"), F.expr("left(g[i + 1], 20)").alias("a"))


def findings(spark: SparkSession, rows: int = 4000, seed: int = 23) -> DataFrame:
    """Labelled findings (b, c, a, secret): `rows` of them, made from seeded hashes."""
    n = f"cast(pmod(xxhash64(id, {seed}, %d), %d) AS int)"
    pick = lambda salt, values: f"element_at(array({', '.join(repr(v) for v in values)}), 1 + {n % (salt, len(values))})"
    word = lambda salt: pick(salt, DICTIONARY)
    syllables = ("an", "ble", "con", "de", "ea", "en", "er", "es", "ing", "ion", "keit", "la", "le", "lich", "ment", "mo", "nd", "on", "or", "ou", "que", "ra", "re", "sch", "st", "ta", "th", "ti", "tion", "un", "ver", "wh")
    syllable = "concat(" + ", ".join(pick(40 + k, syllables) for k in range(8)) + ")"
    digest = f"sha2(concat('{seed}:', id), 512)"
    b64 = f"regexp_replace(base64(unhex({digest})), '=', '')"
    secret_word = pick(1, ("token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "private_key", "API_TOKEN", "bearer"))
    set_to = pick(2, (" = \"", "=", ": ", ":\"", " = ", " "))
    hash_word = pick(3, ("commit ", "sha1 ", "md5: ", "checksum = ", "digest: ", "revision ", "sha256:", "etag: \"", "uuid "))
    plain = pick(4, ("the ", "and ", "see ", "in ", "", "of ", "import ", "call ", "la ", "und "))
    text = pick(5, ("The code says ", "In file ", "", "and then the ", "Also "))
    hexed, mixed = f"left({digest}, {pick(6, (32, 40, 64))})", f"left({b64}, {pick(7, (20, 24, 32, 40, 64))})"
    camel = f"concat({word(10)}, initcap({word(11)}), initcap({word(12)}), initcap({word(13)}))"
    snake = f"concat_ws('_', {word(10)}, {word(11)}, {word(12)}, {word(13)})"
    path = f"concat_ws('/', {word(10)}, {word(11)}, {word(12)}, {word(13)}, {word(14)})"
    signs = pick(16, ("!", "#", "@", "$", "%", "^", "&", "*"))
    password = f"concat(left({b64}, 4), {signs}, substr({b64}, 9, {pick(17, (3, 5, 7, 9))}), {signs})"
    kinds = (  # before, candidate, secret
        (f"concat({text}, {secret_word}, {pick(18, ('=', ': ', ' = '))})", password, 1),
        (f"concat({text}, {secret_word}, {pick(18, ('=', ': ', ' = '))})", f"left({b64}, {pick(19, (10, 12, 14))})", 1),
        (f"concat({text}, {pick(20, ('room: ', 'time: ', 'see: ', 'date: ', 'page='))})", f"concat({word(10)}, '-', {n % (21, 9000)})", 0),
        (f"concat({text}, {pick(20, ('room: ', 'time: ', 'see: ', 'date: ', 'page='))})", f"concat({n % (22, 28)}, '.', {n % (23, 12)}, '.', {word(11)})", 0),
        (f"concat({text}, {secret_word}, {set_to})", hexed, 1),
        (f"concat({text}, {secret_word}, {set_to})", mixed, 1),
        (f"concat({text}, {secret_word}, {set_to})", mixed, 1),
        (f"concat({text}, {secret_word}, {set_to})", hexed, 1),
        (f"concat({text}, {set_to})", f"concat({pick(8, ('AKIA', 'ghp_', 'xoxb-', 'sk_live_'))}, left({b64}, 28))", 1),
        (f"concat({text}, {hash_word})", hexed, 0),
        (f"concat({text}, {plain})", hexed, 0),
        (f"concat({text}, {plain})", syllable, 0),
        (f"concat({text}, {plain})", syllable, 0),
        (f"concat({text}, {plain})", f"upper({syllable})", 0),
        (f"concat({text}, {plain})", camel, 0),
        (f"concat({text}, {secret_word}, {set_to})", snake, 0),
        (f"concat({text}, {secret_word}, {set_to})", f"{pick(9, ('your_api_key_goes_here', 'xxxxxxxxxxxxxxxxxxxxxxxx', 'EXAMPLEEXAMPLEEXAMPLE', '00000000000000000000'))}", 0),
        (f"concat({text}, '/')", path, 0),
        (f"concat({text}, 'https://host.example/')", path, 0),
    )
    which = n % (0, len(kinds))
    case = lambda i: "CASE " + " ".join(f"WHEN {which} = {k} THEN {kind[i]}" for k, kind in enumerate(kinds)) + " END"
    made = spark.range(rows).select(F.expr(case(0)).alias("b"), F.expr(case(1)).alias("c"), F.expr(pick(15, ("\"", " ", "", "\n", ".", "\" "))).alias("a"), F.expr(case(2)).alias("secret"))
    return made.where(F.length("c") >= 8)


def fit(labelled: DataFrame, table: list[float] | None = None, *, trees: int = 24, depth: int = 8, seed: int = 23) -> RandomForestClassificationModel:
    """A forest from labelled findings (b, c, a, secret)."""
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(described(labelled, table))
    forest = RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64)
    return forest.fit(rows.select("features", F.col("secret").cast("double").alias("secret")))


def scan(docs: DataFrame, model: RandomForestClassificationModel, table: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of each secret; places are code points, the end exclusive. `table` must be that of the model."""
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(described(candidates(docs), table))
    scored = model.transform(rows.select("doc_id", "start", "end", "features"))
    return scored.select("doc_id", "start", "end", vector_to_array("probability")[1].alias("score")).where(F.col("score") >= threshold)
