"""Physical plans: what must be pushed down, what must not be there."""

import re

import pytest

from catalog import views as V
from catalog.queries import queries
from gradeloom.operators import curation as Q
from gradeloom.operators import scoring as S

# Chunk planning, and n-gram counting with all that reads its scores.
PYTHON = {
    "plan_request_chunks", "chunk_report", "sentence_bleu", "code_bleu", "score_pairs", "available_metrics",
    "metric_means", "metric_summary", "metric_delta", "metric_scatter",
}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHEAP = sorted(n for n in queries() if n not in {
    "correctness_threshold", "validity_correctness", "score_histogram", "score_density"})


@pytest.mark.parametrize("name", CHEAP)
def test_no_cartesian_product_and_no_python(spark, sf_dir, name):
    plan = physical(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|InPandas", plan)


def test_only_wanted_columns_are_read(spark, sf_dir):
    plan = physical(queries()["read_shards"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


def test_flags_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "flags")
    spark.createDataFrame([(1, True, False)], "row_idx long, uml_valid boolean, llm_failed boolean") \
        .write.parquet(path)
    plan = Q.keep_valid(spark.read.parquet(path))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: .*EqualTo\(uml_valid,true\)", plan)
    assert re.search(r"PushedFilters: .*Not\(EqualTo\(llm_failed,true\)\)", plan)


def test_row_local_scores_add_no_shuffle(spark, sf_dir):
    many = V.base_pairs(spark, sf_dir).selectExpr("row_idx", "uml_pred", "uml_code_gt")
    before = physical(many).count("Exchange hashpartitioning")
    assert physical(S.sentence_bleu(many)).count("Exchange hashpartitioning") == before


def test_top_errors_keeps_only_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in physical(queries()["top_errors"](spark, sf_dir))


def test_row_index_sorts_only_file_counts(spark, sf_dir):
    plan = physical(queries()["dense_row_index"](spark, sf_dir))
    assert plan.count("Window") == 1 and "SinglePartition" in plan
    # The ordered side is the aggregate per file; the rows meet it by broadcast.
    assert "BroadcastHashJoin [_file" in plan and plan.count("Exchange") <= 3
