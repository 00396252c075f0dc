import random

import numpy as np
import pytest

from caseflow.operators import analysis as an
from caseflow.operators import metrics as me
from caseflow.operators import prep as pr
from tests.conftest import rows


def naive_auroc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(s, y) if i for b, j in zip(s, y) if not j]
    return sum(pairs) / len(pairs)


def naive_ap(y, s):
    total, before, out = sum(y), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, i in zip(s, y) if a >= t and i)
        recall, precision = tp / total, tp / sum(1 for a in s if a >= t)
        out += (recall - before) * precision
        before = recall
    return out


RUNS = {
    "ties": ([0, 1, 1, 0, 1, 0], [0.5, 0.5, 0.7, 0.2, 0.2, 0.9]),
    "equal": ([0, 1, 0, 1], [0.4] * 4),
    "perfect": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]),
}


@pytest.fixture
def scored(spark):
    rng = random.Random(3)
    RUNS["random"] = ([rng.randint(0, 1) for _ in range(80)], [round(rng.random(), 1) for _ in range(80)])
    return spark.createDataFrame([(k, y, float(s)) for k, (ys, ss) in RUNS.items() for y, s in zip(ys, ss)], "run STRING, label INT, score DOUBLE")


def check_ranks(scored):
    for r in me.rank_metrics(scored, ["run"], 9).collect():
        y, s = RUNS[r["run"]]
        assert r["AUROC"] == pytest.approx(naive_auroc(y, s)) and r["AUPRC"] == pytest.approx(naive_ap(y, s))


def test_rank_metrics(scored):
    check_ranks(scored)


def test_rank_metrics_of_hot_runs(scored, hot):
    check_ranks(scored)


def test_single_class_has_no_auroc(spark):
    df = spark.createDataFrame([("a", 0, 0.3), ("a", 0, 0.4)], "run STRING, label INT, score DOUBLE")
    assert me.rank_metrics(df, ["run"]).first()["AUROC"] is None


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label INT, score DOUBLE")
    r = me.threshold_metrics(df, []).first()
    assert (r["Accuracy"], r["Precision"], r["Recall"], r["F1"]) == (0.5, 0.0, 0.0, 0.0)


def test_threshold_sweep(scored):
    grid = np.linspace(0.05, 0.95, 91)
    sweep = {(r["run"], r["step"]): r for r in me.threshold_sweep(scored, ["run"]).collect()}
    assert len(sweep) == 91 * len(RUNS)
    for (run, step), r in sweep.items():
        y, s = RUNS[run]
        t = 0.05 + 0.01 * step
        assert abs(t - grid[step]) < 1e-12
        tp = sum(1 for a, i in zip(s, y) if a >= t and i)
        fp = sum(1 for a, i in zip(s, y) if a >= t and not i)
        assert (r["TP"], r["FP"]) == (tp, fp)
    best = {r["run"]: r for r in me.best_threshold(scored, ["run"]).collect()}
    for run in RUNS:
        f = [sweep[run, i]["F1"] for i in range(91)]
        assert best[run]["F1"] == pytest.approx(max(f)) and best[run]["threshold"] == pytest.approx(grid[int(np.argmax(f))])


def test_error_analysis(spark):
    data = [(1, 0.9, 4.0, "a"), (1, 0.1, 2.0, "a"), (1, 0.2, 0.0, "b"), (0, 0.9, 1.0, "b"), (0, 0.0, 8.0, None)]
    tagged = me.confusion_tags(spark.createDataFrame(data, "label INT, score DOUBLE, x DOUBLE, c STRING"), 0.5)
    assert rows(me.tag_counts(tagged, [])) == [(5, 1, 2, 1, 1)]
    assert rows(an.group_means(tagged, ["x"])) == [("x", 4.0, 1.0, 1.0, 8.0)]
    assert rows(an.fn_vs_tp(tagged, ["x"])) == [("x", 1.0, 4.0, -3.0, -75.0)]
    assert rows(an.miss_rates(tagged, ["c"])) == [("c", "a", 0.5, 2, False), ("c", "b", 1.0, 1, False)]


def test_average_ranks(spark):
    data = [("v", "c", "k", m, 1, a) for m, a in (("A", 0.9), ("B", 0.8), ("C", 0.8), ("D", 0.1))]
    df = spark.createDataFrame(data, "Variant STRING, Cohort STRING, Condition STRING, Model STRING, Seed INT, AUROC DOUBLE")
    assert rows(an.mean_rank(df, None), "Model", "mean_rank", "best", "worst") == [("A", 1.0, 1, 1), ("B", 2.5, 2, 2), ("C", 2.5, 2, 2), ("D", 4.0, 4, 4)]


def test_paired_interval(spark):
    gb = [("GB", "With Process", s, 0.9 + s / 1000) for s in range(5)]
    weak = [("CNN", "Sequence + Tabular", s, 0.8 + s / 500) for s in range(5)]
    df = spark.createDataFrame([("ICU", "lat", *r) for r in gb + weak], "Cohort STRING, Variant STRING, Model STRING, Condition STRING, Seed INT, AUROC DOUBLE")
    r = an.paired_interval(df).first()
    d = np.array([0.1 - s / 1000 for s in range(5)])
    half = 2.776 * d.std(ddof=1) / np.sqrt(5)
    assert r["delta"] == pytest.approx(d.mean(), abs=1e-4) and r["ci_lo"] == pytest.approx(d.mean() - half, abs=1e-4)
    assert (r["best_neural"], r["verdict"], r["n"]) == ("CNN", "GB beats", 5)


def test_scaling_and_one_hot(spark):
    df = spark.createDataFrame([("train", 1.0, 5.0, "a"), ("train", 3.0, 5.0, "b"), ("test", 9.0, 7.0, "c")], "part STRING, x DOUBLE, k DOUBLE, g STRING")
    scaler = pr.fit_scaler(df.filter("part = 'train'"), ["x", "k"])
    assert rows(scaler.apply(df), "x", "k") == [(-1.0, 0.0), (1.0, 0.0), (7.0, 2.0)]
    hot = pr.one_hot(df.select("x", "g"), pr.categories(df, ["g"]))
    assert hot.columns == ["x", "g_a", "g_b", "g_c"] and rows(hot, "g_a", "g_b", "g_c") == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    weights = pr.class_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "y INT"), "y").first()
    assert (weights["weight_pos"], weights["weight_neg"], weights["pos_weight"]) == (2.0, 0.666667, 3.0)
