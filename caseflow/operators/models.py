"""Learners on prepared vectors, at the settings the result tables are reported for, and the ablation plan."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators import features as ft
from caseflow.operators.design import BAG, View
from caseflow.operators.forest import Forest, Settings, fit_forest
from caseflow.operators.neighbours import NEIGHBOURS, nearest, vote
from caseflow.operators.perceptron import Perceptron, fit_perceptron
from caseflow.session import shared_folder

INCREMENTAL_ORDER = ("demographics", "clinical_core", "chronic_count", "charlson", "icd_chapters", "process")
AT_DISCHARGE = ("icd_chapters", "charlson", "chronic_count")
CLASSICAL = ("LR", "RF", "GB", "KNN")
#: The deepest tree; the trees of the result tables have no bound.
DEEPEST = 30


def logistic(n_train: int, seed: int, rounds: int = 1000):
    """Ridge penalty of strength 1 on the summed loss, as 1/n on the mean loss.  Inputs are scaled already."""
    return LogisticRegression(
        maxIter=rounds, tol=1e-9, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, weightCol="weight"
    )


def forest(seed: int, trees: int = 100, depth: int = DEEPEST, leaf: int = 1) -> Settings:
    return Settings(trees, depth, leaf, seed)


def tuned_forest(seed: int, trees: int = 200, depth: int = 20, leaf: int = 2) -> Settings:
    return forest(seed, trees, depth, leaf)


def boosting(n_train: int, seed: int, rounds: int = 100):
    return GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, weightCol="weight", seed=seed)


BUILD = {"LR": logistic, "GB": boosting}
FORESTS = {"RF": forest, "RF-tuned": tuned_forest}


def fit(name: str, view: View, seed: int = 42, **options):
    """A fitted model as read back from where it was saved: without the training summary, which holds on to
    the session and keeps a model from being sent to executors once the session observes a write."""
    if name in FORESTS:
        return fit_forest(view.train, view.size, FORESTS[name](seed, **options))
    model = BUILD[name](view.train.count(), seed, **options).fit(view.train)
    folder = f"{shared_folder(view.rows.sparkSession)}/fitted-{uuid.uuid4().hex}"
    model.write().save(folder)
    return type(model).load(folder)


def scored(model, rows: DataFrame, *keep: str) -> DataFrame:
    if isinstance(model, Forest):
        return model.scored(rows, *keep)
    return model.transform(rows).select("hadm_id", "label", *keep, vector_to_array("probability")[1].alias("score"))


def fit_predict(name: str, view: View, seed: int = 42, **options) -> DataFrame:
    """(hadm_id, label, score) on the test rows for LR, RF, GB, MLP or KNN."""
    if name == "KNN":
        as_vectors = lambda df: df.select(F.col("hadm_id").alias("id"), vector_to_array("features").alias("vec"))
        found = nearest(as_vectors(view.train), as_vectors(view.test), options.get("k", NEIGHBOURS))
        scores = vote(found, view.train.select(F.col("hadm_id").alias("id"), "label"))
        return view.test.select("hadm_id", "label").join(scores.withColumnRenamed("query_id", "hadm_id"), "hadm_id")
    if name == "MLP":
        return fit_perceptron(view, Perceptron(seed=seed, **options)).scored(view.test)
    return scored(fit(name, view, seed, **options), view.test)


def ridge_gradient(model, view: View) -> float:
    """Largest component of the penalised loss's gradient at a fitted logistic model, intercept included.

    Near 0 where the fit is at its optimum, whatever way it got there."""
    rows = model.transform(view.train).withColumn("g", F.col("weight") * (vector_to_array("probability")[1] - F.col("label")))
    at = rows.agg(F.sum("weight").alias("w"), F.sum("g").alias("g")).first()
    # Summarizer wants weights from 0 on; both signs are summed apart.
    sums = 0.0
    for sign in (1, -1):
        own = rows.filter(F.col("g") * sign > 0)
        part = own.agg(Summarizer.metrics("sum", "count").summary(F.col("features"), F.col("g") * sign).alias("m")).first()["m"]
        if part is not None and part["count"]:
            sums = sums + sign * part["sum"].toArray()
    slope = sums / at["w"] + model.getRegParam() * model.coefficients.toArray()
    return float(max(abs(slope).max(), abs(at["g"] / at["w"])))


# --- conditions and ablations as choices of columns ------------------------------------------------------------

EVERY = tuple(f for g in ft.GROUPS.values() for f in g)
CONDITIONS = {
    "No Process": tuple(f for f in EVERY if f not in ft.GROUPS["process"]),
    "With Process": EVERY,
    "With BoW": (*EVERY, BAG),
}


def _without(*groups: str) -> tuple[str, ...]:
    return tuple(f for g, own in ft.GROUPS.items() if g not in groups for f in own)


def ablation_plan(order: tuple[str, ...] = INCREMENTAL_ORDER, late: tuple[str, ...] = AT_DISCHARGE) -> list[tuple[str, int, str, tuple[str, ...]]]:
    """(table, step, name, columns) of every row of the four ablation tables.

    Rows of different tables that choose the same columns are one fit."""
    known_late = sum(len(ft.GROUPS[g]) for g in late)
    rows = [("leave_one_out", 0, "(none) FULL", EVERY)]
    rows += [("leave_one_out", i, g, _without(g)) for i, g in enumerate(ft.GROUPS, 1)]
    rows += [("single_group", i, g, tuple(own)) for i, (g, own) in enumerate(ft.GROUPS.items())]
    rows += [("incremental", i, g, tuple(f for h in order[: i + 1] for f in ft.GROUPS[h])) for i, g in enumerate(order)]
    rows += [("temporal_validity", 0, f"FULL ({len(EVERY)} features)", EVERY), ("temporal_validity", 1, f"minus {known_late} discharge-assigned features", _without(*late))]
    return rows


def choice_name(columns: tuple[str, ...]) -> str:
    """One name for one choice of feature groups, in whatever order they were put together."""
    return "+".join(g for g, own in ft.GROUPS.items() if set(own) <= set(columns))


def row_gain(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """How far a value rises from one row to the next within its key; NULL for the first."""
    return rows.withColumn(out, F.round(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), 4))


def ablation_tables(results: DataFrame, cohorts: list[str]) -> DataFrame:
    """(table, Cohort, step, name, AUROC, AUPRC, n_features, change) from the results of the planned choices.

    ``change`` is the drop against the full model, or the gain over the step before in the incremental table."""
    spark = results.sparkSession
    plan = [(table, step, name, choice_name(columns)) for table, step, name, columns in ablation_plan()]
    planned = spark.createDataFrame(plan, "table STRING, step INT, name STRING, Condition STRING")
    rows = planned.join(results.filter(F.col("Cohort").isin(cohorts)).select("Cohort", "Condition", "AUROC", "AUPRC", "n_features"), "Condition")
    full = results.filter(F.col("Condition") == choice_name(EVERY)).select("Cohort", F.col("AUROC").alias("full"))
    gained = row_gain(rows, ["table", "Cohort"], ["step"], "AUROC", "gain").join(full, "Cohort")
    change = F.when(F.col("table") == "incremental", F.col("gain")).when(F.col("table") != "single_group", F.round(F.col("full") - F.col("AUROC"), 4))
    return gained.select("table", "Cohort", "step", "name", "AUROC", "AUPRC", "n_features", change.alias("change"))
