"""The pipeline on planted cases, and on an empty table."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from panelforge.llm import decontamination, near_dedup  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, words(rng, 120)) for i in range(100)]
    docs += [(i, words(rng, 60) + " utter idiot " + words(rng, 60)) for i in range(100, 140)]
    docs += [(200 + i, docs[i][1]) for i in range(10)]
    docs += [(300 + i, docs[20 + i][1] + " end") for i in range(10)]
    docs += [(400, None), (401, ""), (401, "")]
    item = words(rng, 40)
    docs += [(500, words(rng, 50) + " " + item + " " + words(rng, 50))]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_and_run(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), DOCS)
        seen.append((name, {r["doc_id"] for r in docs.collect()}))
    assert [n for n, _ in seen] == ["toxicity", "exact_dedup", "near_dedup", "decontamination"]
    kept = dict(seen)
    assert not kept["toxicity"] & set(range(100, 140)) and set(range(100)) <= kept["toxicity"]
    assert set(range(200, 210)) <= kept["exact_dedup"] and not kept["exact_dedup"] & set(range(10))
    assert not kept["near_dedup"] & set(range(300, 310)) and set(range(20, 30)) <= kept["near_dedup"]
    assert 500 not in kept["decontamination"] and kept["near_dedup"] - kept["decontamination"] == {500}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == kept["decontamination"]


def test_empty_table(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_defaults():
    assert decontamination.SHINGLE == 5 and decontamination.OVERLAP == 0.8
    assert near_dedup.near_groups.__defaults__[:2] == (5, 80)
