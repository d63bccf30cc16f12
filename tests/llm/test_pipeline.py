"""The corpus pipeline against plain versions of its stages, and the independence of the rest."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from lexweave.llm import decontaminate, langid, mixing
from lexweave.llm.common import held_out
from test_near_dedup import brute
from test_tables import check_mix, words

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).parents[2]


def test_stages_do_what_plain_versions_do(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        columns = columns or docs.columns
        if name != corpus_pipeline.STAGES[0][0]:
            assert docs.columns == columns
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    inputs["end"] = docs.collect()

    source = spark.read.parquet(f"{SF}/documents.parquet")
    judge = langid.Judge(langid.learn(source.where(~held_out(source["doc_id"])).select("doc_id", "text", "lang")))
    kept = [r for r in inputs["language_id"] if (x := judge.of(r["text"]))[0] != "und" and x[2] >= judge.model.margin]
    assert sorted(kept) == sorted(inputs["near_dedup"]) and len(kept) > 0.97 * len(inputs["language_id"])
    truth = brute([(r["doc_id"], r["text"]) for r in kept], k=5)
    once = [r for r in kept if truth[r["doc_id"]][1] == r["doc_id"]]
    assert sorted(once) == sorted(inputs["decontamination"])
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in once if not any(i in decontaminate.normalised(r["text"]) for i in items)]
    assert sorted(clean) == sorted(inputs["mixing"])
    taken = mixing.mix(spark.createDataFrame(clean, source.schema)).collect()
    check_mix(taken, [(r["doc_id"], r["source"], r["text"]) for r in clean])
    got = Counter()
    for r in inputs["sharding"]:
        got[r["doc_id"]] += words(r["text"])
    assert +got == Counter({r["doc_id"]: r["taken"] for r in taken if r["taken"]})
    end = inputs["end"]
    assert sorted((r["doc_id"], r["text"]) for r in end) == sorted((r["doc_id"], r["text"]) for r in inputs["sharding"])
    loads = Counter(r["shard"] for r in end)
    assert max(loads.values()) - min(loads.values()) <= 1


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and out.count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in REPO.glob("lexweave/**/*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "lexweave.llm" not in path.read_text() and "from ..llm" not in path.read_text()


def test_entry_works_without_the_subpackage(tmp_path):
    for path in [REPO / "__spark_entry__.py", *REPO.glob("lexweave/**/*.py")]:
        part = path.relative_to(REPO)
        if "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
