"""Summaries, comparisons and distributions on literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import distributions as D
from gradeloom.operators import reports as R
from gradeloom.operators import results as O
from gradeloom.operators import selection
from gradeloom.operators.batches import batch_gate, batch_status_report

NAN = float("nan")
SCORES = ("model string, row_idx long, uml_valid boolean, llm_failed boolean, uml_error string, "
          "codebleu double, bleu double, token_f1 double, emb_sim double, "
          "exact_match double, token_prec double, token_recall double")


def scores(spark, rows):
    """rows of (model, valid, failed, codebleu, bleu)."""
    return spark.createDataFrame(
        [(m, i, v, f, "" if v else "bad", cb, b, None, NAN, 1.0, None, 0.5)
         for i, (m, v, f, cb, b) in enumerate(rows)], SCORES)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_summaries_of_an_empty_table(spark):
    empty = scores(spark, [])
    row = R.benchmark_summary(empty).first()
    assert (row.n, row.valid, row.valid_pct) == (0, 0, None)
    assert R.top_errors(empty).count() == 0
    got = by(R.outcome_comparison(empty), "outcome")
    assert (got["valid"].base_rows, got["valid"].base_pct, got["valid"].delta_pp) == (0, 0.0, 0.0)


def test_conversion_summary_with_null_split(spark):
    rows = [("a", True, False), ("a", False, True), (None, True, True)]
    df = spark.createDataFrame(rows, "split string, uml_valid boolean, llm_failed boolean")
    got = by(R.conversion_summary(df), "scope", "split")
    assert set(got) == {("all", None), ("split", "a")}
    total = got["all", None]
    # A row that is both valid and failed is counted twice, so the remainder is smaller.
    assert (total.total, total.uml_valid, total.llm_failures, total.uml_invalid) == (3, 2, 2, -1)
    assert got["split", "a"].valid_pct == 50.0


def test_two_meanings_of_invalid(spark):
    df = scores(spark, [("base", True, True, 1.0, 1.0), ("base", False, False, 1.0, 1.0)])
    row = df.agg(*[c.alias(n) for n, c in O.outcome_counts().items()]).first()
    assert (row.n, row.valid, row.llm_failures, row.invalid, row.invalid_strict) == (2, 1, 1, 0, 1)


def test_top_errors_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame(
        [(0, "b", False), (1, "a", False), (2, "a", False), (3, "b", False), (4, "c", False),
         (5, "c", True), (6, "c", True), (7, "", False)],
        "row_idx long, uml_error string, llm_failed boolean")
    assert [(r.uml_error, r.n_rows) for r in R.top_errors(df, 2).collect()] == [("b", 2), ("a", 2)]


def test_missing_model_counts_zero_of_one(spark):
    got = by(R.outcome_comparison(scores(spark, [("base", True, False, 1.0, 1.0)])), "outcome")
    assert (got["valid"].finetuned_rows, got["valid"].finetuned_pct) == (0, 0.0)
    assert got["valid"].delta_pp == -100.0


def test_shares_over_base_or_own_rows(spark):
    df = scores(spark, [("base", True, False, 1.0, 1.0)] * 4 + [("finetuned", True, False, 1.0, 1.0)])
    over_base = by(R.outcome_shares(df), "model", "outcome")
    assert over_base["finetuned", "valid"].share_pct == 25.0
    assert by(R.outcome_shares(df, "own"), "model", "outcome")["finetuned", "valid"].share_pct == 100.0


def test_nan_counts_as_missing(spark):
    df = scores(spark, [("base", True, False, NAN, 0.25), ("base", True, False, 0.5, None),
                        ("finetuned", True, False, NAN, 0.75)])
    assert {r.metric for r in R.available_metrics(df).collect()} == {
        "exact_match", "bleu", "codebleu", "token_recall"}
    means = by(R.metric_means(df), "model")
    assert (means["base"].codebleu, means["base"].bleu, means["finetuned"].codebleu) == (0.5, 0.25, None)
    summary = by(R.metric_summary(df), "measure")
    assert "emb_sim" not in summary and summary["n"].base == 2 and summary["valid_pct"].finetuned == 100
    delta = by(R.metric_delta(df), "metric")
    assert (delta["bleu"].delta, delta["bleu"].arrow) == (0.5, "↑")
    assert (delta["exact_match"].delta, delta["exact_match"].arrow) == (0.0, "↓")
    assert (delta["codebleu"].delta, delta["codebleu"].arrow) == (None, "↓")


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [1.0] * 50 + [2.0] * 50, [0.5] * 99 + [0.1],
    [(i * 7919) % 5000 / 5000 for i in range(5001)], [i % 3 / 10 for i in range(3000)],
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert D.exact_median(df, "v").first().median == pytest.approx(float(np.median(values)), abs=0)


def test_threshold_falls_back(spark):
    none = scores(spark, [("base", True, False, 0.9, 0.9), ("finetuned", False, False, 0.8, 0.8)])
    assert tuple(D.correctness_threshold(none).first()) == ("codebleu", 0.5)
    bleu = scores(spark, [("base", True, False, None, 0.9), ("finetuned", True, False, NAN, 0.2),
                          ("finetuned", True, False, NAN, 0.4), ("finetuned", True, False, NAN, None)])
    name, threshold = D.correctness_threshold(bleu).first()
    assert name == "bleu" and threshold == pytest.approx(0.3)
    got = by(D.validity_correctness(bleu), "model")
    assert got["finetuned"].correct_pct == pytest.approx(100 / 3)
    assert got["finetuned"].imprecise_pct == pytest.approx(200 / 3)


def test_histogram_matches_numpy(spark):
    values = [i % 17 / 16 for i in range(400)]
    df = scores(spark, [("base", True, False, 0.0, v) for v in values]
                + [("finetuned", True, False, 0.0, 0.25)] * 3)
    rows = D.score_histogram(df, "bleu").orderBy("model", "bin").collect()
    density, edges = np.histogram(values, bins=20, density=True)
    base = [r for r in rows if r.model == "base"]
    assert [r.density for r in base] == pytest.approx(density.tolist())
    assert [r.bin_low for r in base] == pytest.approx(edges[:-1].tolist())
    [flat] = [r for r in rows if r.model == "finetuned"]
    assert (flat.bin_low, flat.n_rows, flat.density, flat.mean) == (0.25, 3, None, 0.25)


def test_density_matches_the_formula(spark):
    values = [0.1, 0.1, 0.4, 0.45, 0.9]
    df = scores(spark, [("base", True, False, 0.0, v) for v in values]
                + [("finetuned", True, False, 0.0, 0.5)] * 2)
    rows = D.score_density(df, "bleu", points=50).orderBy("i").collect()
    assert {r.model for r in rows} == {"base"} and len(rows) == 50
    h = np.std(values, ddof=1) * len(values) ** -0.2
    grid = np.linspace(0.1 - 0.4, 0.9 + 0.4, 50)
    want = [sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values)
            / (len(values) * h * math.sqrt(2 * math.pi)) for x in grid]
    assert [r.x for r in rows] == pytest.approx(grid.tolist())
    assert [r.density for r in rows] == pytest.approx(want)


def test_density_far_from_all_values(spark):
    df = scores(spark, [("base", True, False, 0.0, v) for v in [0.0] * 5000 + [1.0]])
    rows = D.score_density(df, "bleu", points=101).collect()
    assert len(rows) == 101 and min(r.density for r in rows) == 0.0


MANIFEST = ("id string, status string, output_file_id string, "
            "request_counts struct<total:long,completed:long,failed:long>, created_at long, "
            "errors struct<data:array<struct<code:string,message:string>>>")


@pytest.mark.parametrize("rows, ready", [
    ([("completed", "f1"), ("completed", "f2")], True), ([("completed", "f1"), ("running", None)], False),
    ([("completed", None)], False), ([("completed", "")], False), ([], True), ([(None, "f")], False),
])
def test_batch_gate(spark, rows, ready):
    df = spark.createDataFrame(rows, "status string, output_file_id string")
    assert batch_gate(df).first().ready is ready


def test_batch_status_report(spark):
    df = spark.createDataFrame([
        ("b1", "completed", "f", (3, 3, 0), 0, None),
        ("b2", "failed", None, (3, 0, 3), 60, ([("c1", "m1"), ("c2", "m2")],)),
    ], MANIFEST)
    rows = batch_status_report(df).orderBy("id", "error_code").collect()
    assert [(r.id, r.status, r.failed, r.error_code) for r in rows] == [
        ("b1", "COMPLETED", 0, None), ("b2", "FAILED", 3, "c1"), ("b2", "FAILED", 3, "c2")]


def test_values_at_ranks_are_those_of_a_sort(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-2**63, 2**63 - 1, 300), rng.integers(-3, 3, 200), [5] * 100, [2**63 - 1, -2**63]])
    ordered = np.sort(values).tolist()
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(4)
    ranks = [0, 1, 150, 299, 300, 301, 400, 500, len(values) - 1]
    found = selection.values_at(df, "v", ranks)
    assert [(f.value, f.smaller) for f in found] == [(ordered[r], ordered.index(ordered[r])) for r in ranks]
    with pytest.raises(ValueError, match="beyond"):
        selection.values_at(df, "v", [len(values)])


def test_bits_keep_the_order_of_doubles(spark):
    values = [-float("inf"), -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 0.1, 1.0, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    bits = [r[0] for r in df.select(selection.ordered_bits(F.col("v"))).collect()]
    assert bits[-1] is None and bits[:-1] == sorted(bits[:-1]) and bits[4] == bits[5] and len(set(bits[:-1])) == 10
    assert [selection.from_ordered_bits(b) for b in bits[:-1]] == values


def test_density_tasks_send_one_grid_per_model(spark):
    """Rows that leave a task: models times points, however many values it saw."""
    rows = [(m, float(v)) for m in ("base", "finetuned") for v in np.random.default_rng(3).normal(size=400)]
    df = spark.createDataFrame(rows, "model string, v double").repartition(3)
    grids = df.selectExpr("model", "v", "1d AS h", "-5d AS x0", "0.1d AS dx").mapInArrow(
        D._masses(100), "model string, i int, mass double")
    assert grids.count() == 3 * 2 * 100
    got = {(r.model, r.i): r.density for r in D.score_density(df, "v", 50).collect()}
    for model in ("base", "finetuned"):
        v = np.array([x for m, x in rows if m == model])
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 0.5 * np.ptp(v), v.max() + 0.5 * np.ptp(v), 50)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose([got[model, i] for i in range(50)], want, rtol=1e-9)
