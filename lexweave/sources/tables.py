"""Sources and sinks: text, JSON lines, tagged JSON, gold CSV, models, run records, caches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import squeezed

TAGGED = "text STRING, words ARRAY<STRUCT<surface: STRING, upos: STRING, lemma: STRING, start: INT, end: INT>>"
_PRF = "STRUCT<precision: DOUBLE, recall: DOUBLE, f1: DOUBLE, weighted_precision: DOUBLE, weighted_recall: DOUBLE, weighted_f1: DOUBLE, n_words: INT, tokens_per_word: DOUBLE>"
HELDOUT = ("tokens_per_word", "chars_per_token", "share_leading_marker", "share_trailing_marker", "share_cross_word", "boundaries_absorbed", "mean_transition_p_all", "mean_transition_p_absorbed")
RUN = (
    "lang STRING, method STRING, seed INT, vocab_size INT, vocab_budget INT, n_train_paragraphs INT, n_train_words INT, train_seconds DOUBLE, "
    f"heldout STRUCT<{', '.join(f'{h}: DOUBLE' for h in HELDOUT)}>, morph MAP<STRING, MAP<STRING, {_PRF}>>, morph_filter STRING"
)
LM = "bits_per_char DOUBLE, nll_per_token DOUBLE, test_tokens INT, test_chars INT, test_unknown_tokens INT, train_tokens INT, steps INT, epochs DOUBLE, batch INT, ctx INT, params INT, seconds DOUBLE, lm_seed INT"
ANSWER = "word STRING, segmentation STRING, valid BOOLEAN, model STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or of our own where Spark runs in this process alone."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="lexweave-")
    return f"{top}/tables-{uuid.uuid4().hex}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, stripped. [S2]"""
    return spark.read.text(path).select(squeezed(F.col("value")).alias("line")).where("line <> ''")


def write_split(split: DataFrame, path: str) -> None:
    """Paragraphs by language and split. [S3]"""
    split.select("lang", "split", "text").write.mode("overwrite").partitionBy("lang", "split").parquet(path)


def write_tagged(tagged: DataFrame, path: str) -> None:
    """JSON lines of (text, words). [S4 F16]"""
    tagged.select("text", "words").write.mode("overwrite").json(path)


def tagged_paragraphs(tagged: DataFrame) -> DataFrame:
    """One row a paragraph from tagged words (doc_id, para_idx, k, surface, upos, lemma, start, end). [P19]"""
    rows = tagged.groupBy("doc_id", "para_idx").agg(F.array_sort(F.collect_list(F.struct("k", "surface", "upos", "lemma", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["surface"].alias("surface"), x["upos"].alias("upos"), x["lemma"].alias("lemma"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("doc_id", "para_idx", F.array_join(F.transform("w", lambda x: x["surface"]), " ").alias("text"), words.alias("words"))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """[S5]"""
    return spark.read.schema(TAGGED).json(path)


def read_legacy_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, words): an array of sentences of {word, pos}. [S6 DM4]"""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "ARRAY<ARRAY<STRUCT<word: STRING, pos: STRING>>>")).alias("sentence", "words"))


def write_transitions(transitions: DataFrame, path: str) -> None:
    """[S7]"""
    transitions.write.mode("overwrite").json(path)


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """(pos_l, pos_r, n, p); no rows if there is no such file. [S7]"""
    schema = "pos_l STRING, pos_r STRING, n LONG, p DOUBLE"
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold CSV; empty fields are empty strings. [S8]"""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path).na.fill("")


def write_legacy_tagged(rows: DataFrame, path: str) -> None:
    """Rows (part, sentence, words) as one file a part, each an array of sentences of {word, pos}. [S6 DM4]"""
    each = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("sentence", "words"))).alias("s"))
    text = each.select("part", F.to_json(F.transform("s", lambda x: x["words"])).alias("value"))
    text.write.mode("overwrite").partitionBy("part").text(path)


def write_model(merges: DataFrame, path: str) -> None:
    """Merges (model_id, rank, l, r) by model; left and right are kept apart. [S9 S10 S12]"""
    merges.write.mode("overwrite").partitionBy("model_id").parquet(path)


def read_model(spark: SparkSession, path: str, model_id: str) -> list[tuple[str, str]]:
    """[S10]"""
    return [(r["l"], r["r"]) for r in spark.read.parquet(path).where(F.col("model_id") == model_id).orderBy("rank").collect()]


def write_bpe(merges: DataFrame, vocab: DataFrame, config: dict, path: str) -> None:
    """A whole merge model: merges (rank, l, r), vocabulary (token), and its settings as JSON. [S10 S12]"""
    merges.select("rank", "l", "r").write.mode("overwrite").json(f"{path}/merges")
    vocab.select("token").write.mode("overwrite").json(f"{path}/vocab")
    values = [(config.get("beta", 0), config.get("factor", 1000), list(config.get("content", ())), config.get("unseen", 10_000))]
    merges.sparkSession.createDataFrame(values, BPE_CONFIG).write.mode("overwrite").json(f"{path}/config")


BPE_CONFIG = "beta INT, factor INT, content ARRAY<STRING>, unseen INT"


def read_bpe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges, sorted vocabulary and settings of a model. [S10 S12]"""
    merges = spark.read.schema("rank LONG, l STRING, r STRING").json(f"{path}/merges")
    return merges, spark.read.schema("token STRING").json(f"{path}/vocab"), spark.read.schema(BPE_CONFIG).json(f"{path}/config")


def write_legacy_model(merges: DataFrame, vocab: DataFrame, path: str) -> None:
    """The older form: of each merge only the joined token, twice. [S9 Q3]"""
    merges.select("rank", F.array(F.concat("l", "r"), F.concat("l", "r")).alias("merge")).write.mode("overwrite").json(f"{path}/merges")
    vocab.select("token").write.mode("overwrite").json(f"{path}/vocab")


def read_legacy_model(spark: SparkSession, path: str) -> DataFrame:
    """(rank, token) of the older form, whose split points are lost. [S9]"""
    return spark.read.schema("rank LONG, merge ARRAY<STRING>").json(f"{path}/merges").select("rank", F.col("merge")[1].alias("token"))


def write_lemma_words(lexicon: DataFrame, affixes: DataFrame, path: str, *, min_count: int, min_stem: int) -> None:
    """A stem-boundary model: (form, cuts), all affixes (kind, affix, n), and its two bounds. [S11]"""
    lexicon.select("form", "cuts").write.mode("overwrite").json(f"{path}/lexicon")
    affixes.select("kind", "affix", "n").write.mode("overwrite").json(f"{path}/affixes")
    lexicon.sparkSession.createDataFrame([(min_count, min_stem)], "min_count INT, min_stem INT").write.mode("overwrite").json(f"{path}/config")


def read_lemma_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """The lexicon, the affixes that are frequent enough by the model's own bound, and the least stem. [S11]"""
    config = spark.read.schema("min_count INT, min_stem INT").json(f"{path}/config").first()
    affixes = spark.read.schema("kind STRING, affix STRING, n LONG").json(f"{path}/affixes").where(F.col("n") >= config["min_count"])
    return spark.read.schema("form STRING, cuts ARRAY<INT>").json(f"{path}/lexicon"), affixes, config["min_stem"]


def write_unigram(pieces: DataFrame, path: str) -> None:
    """Pieces (token, logprob) of a unigram model. [S13]"""
    pieces.select("token", "logprob").write.mode("overwrite").parquet(path)


def read_unigram(spark: SparkSession, path: str) -> DataFrame:
    """[S13]"""
    return spark.read.schema("token STRING, logprob DOUBLE").parquet(path)


def upsert(frame: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that `frame` has rows for, keep the others. [S14 S15 S16 P20]"""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Run records of all files that match, with run_method, run_budget and run_seed from the folder's name; other folders are left out. [S14 P16]"""
    rows = spark.read.schema(RUN).option("multiLine", True).json(glob).withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    part = lambda k: F.regexp_extract("run", r"([^/=]+)_v(\d+)_s(\d+)$", k)
    return rows.where(F.col("run").rlike(r"_s\d+$")).select("*", part(1).alias("run_method"), part(2).cast("int").alias("run_budget"), part(3).cast("int").alias("run_seed"))


def write_records(records: DataFrame, path: str) -> None:
    """Run or probe records as JSON, one a folder, which is named `run=<method>_v<budget>_s<seed>` below its language. [S14 S16]"""
    name = F.format_string("%s_v%d_s%d", "method", "vocab_budget", "seed")
    records.withColumn("of", F.col("lang")).withColumn("run", name).repartition("of", "run").write.mode("overwrite").partitionBy("of", "run").json(path)


def read_probes(spark: SparkSession, glob: str) -> DataFrame:
    """Probe records with the lang, method, budget and seed that they belong to. [S16]"""
    return spark.read.schema(f"lang STRING, method STRING, vocab_budget INT, seed INT, {LM}").json(glob)


def long_runs(runs: DataFrame) -> DataFrame:
    """(lang, method, seed, budget, variant, subset, metric, value) of run records. [DM16]"""
    keys = ["lang", "method", "seed", F.col("vocab_budget").alias("budget")]
    held = runs.select(*keys, F.lit("heldout").alias("variant"), F.lit("all").alias("subset"), F.explode(F.map_from_arrays(F.array(*[F.lit(h) for h in HELDOUT]), F.array(*[F.col(f"heldout.{h}") for h in HELDOUT]))).alias("metric", "value"))
    names = ("precision", "recall", "f1", "weighted_precision", "weighted_recall", "weighted_f1", "tokens_per_word")
    morph = runs.select(*keys, F.explode("morph").alias("variant", "m")).select("lang", "method", "seed", "budget", "variant", F.explode("m").alias("subset", "s"))
    scores = morph.select("lang", "method", "seed", "budget", "variant", "subset", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"s.{n}") for n in names]))).alias("metric", "value"))
    return held.unionByName(scores)


def append_answers(answers: DataFrame, path: str) -> None:
    """[S18]"""
    answers.write.mode("append").json(path)


def write_report(reports: list[DataFrame], path: str) -> None:
    """The union of reports as CSV with a header. [S19 T3]"""
    whole = reports[0]
    for r in reports[1:]:
        whole = whole.unionByName(r)
    whole.write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One row on a training as JSON. [S20]"""
    summary.coalesce(1).write.mode("overwrite").json(path)
