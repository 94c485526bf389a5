"""The pipeline's stages, each against a plain version on its own input."""

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from skyledger.llm import decontaminate, mixing

from .common import clashing, documents
from .test_decontaminate import brute as contaminated
from .test_pipeline_stages import kept_by_hand

SF = "/root/testdata/sf0.001"


def kept_in(rows):
    """Ids that the near-duplicate stage keeps, by all pairs."""
    rows = sorted((r["doc_id"], r["text"]) for r in rows)
    return [rows[i][0] for i in kept_by_hand([text for _, text in rows])]


def test_stages_on_a_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if k == 0:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"])}
        elif k == 1:
            assert sorted(r["doc_id"] for r in after) == kept_in(before)
        elif k == 2:
            bad = contaminated([r["text"] for r in before], items)
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, b in zip(before, bad, strict=True) if not b[3])
        elif k == 3:
            plan = {r["doc_id"]: r["times"] for r in mixing.mix_plan(spark.createDataFrame(before, docs.schema)).collect()}
            assert len(after) == sum(plan.values())
        else:
            rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in after)
            assert len(rows) == len(before) and [r[1] for r in rows] == [sum(x[2] for x in rows[:i]) for i in range(len(rows))]


def test_run_is_registered(spark):
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("k", range(4))
def test_stages_take_empty_tables_and_clashing_columns(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = clashing(documents(spark, ["some words", None, ""], langs=["en", None, "en"]))
    assert stage(spark, docs, SF).columns == docs.columns
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_stages_with_all_rows_judged(spark):
    assert decontaminate.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 200
