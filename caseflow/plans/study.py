"""Everything the model runs share, prepared once per folder of tables: matrix, splits, vectors, result store."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import cached_property, partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import encode as en
from caseflow.operators import features as ft
from caseflow.operators import gate
from caseflow.operators import metrics as me
from caseflow.operators import models as mo
from caseflow.operators import split as sp
from caseflow.operators.design import Design, View, design
from caseflow.operators.runs import AT_ONCE, Cell, ModelStore, RunStore, run_cells
from caseflow.plans import pipeline as pl
from caseflow.session import durable, shared_folder
from caseflow.sources import mapping as m

COHORTS = tuple(m.COHORTS)
SEEDS = (42,)


class Study:
    """Both cohorts on one folder of tables.  What is written lies below ``folder`` and is read by all runs."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables
        self.t = pl.Tables(spark, tables, keep=True, share=True)
        self.folder = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
        self.store = RunStore(spark, f"{self.folder}/runs")
        self.models = ModelStore(spark, f"{self.folder}/models")
        self._designs: dict[str, Design] = {}

    @cached_property
    def matrix(self) -> DataFrame:
        """The matrix without NULLs, committed through its gate."""
        numeric = [f for f in ft.FEATURES if f not in ft.CATEGORICAL]
        filled = ft.fill_unknown(pl.matrix(self.t), list(ft.CATEGORICAL)).fillna(0, subset=numeric)
        where = f"{self.folder}/matrix"
        gate.write_checked(filled, where, pl.LABEL, ["cohort", ft.KEY], extra=("cohort",))
        return gate.read_checked(self.spark, where)

    @cached_property
    def split(self) -> DataFrame:
        return durable(pl.split(self.t))

    @cached_property
    def split_ids(self) -> dict[str, str]:
        return {r["cohort"]: r["split_id"] for r in sp.split_digest(self.split, ["cohort"]).collect()}

    @cached_property
    def grams(self) -> DataFrame:
        return durable(en.ngrams(pl.log(self.t), pl.points(self.t), by=["cohort"]))

    def _prepare(self, cohorts) -> None:
        """N-grams, split and matrix side by side on the same written tables, then the designs of the cohorts."""
        self.t.frames, self.t.log, self.t.points
        self._at_once([lambda: self.grams, lambda: self.split, lambda: self.matrix])
        self._at_once([partial(self.design, c) for c in cohorts])

    def _at_once(self, steps: list[Callable]) -> None:
        # A thread of its own sees the hot keys its caller declared only through a copy of the context.
        one = inheritable_thread_target(self.spark)(lambda context, step: context.run(step))
        with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
            for done in [pool.submit(one, copy_context(), step) for step in steps]:
                done.result()

    def of(self, df: DataFrame, cohort: str) -> DataFrame:
        return df.filter(F.col("cohort") == cohort).drop("cohort")

    def design(self, cohort: str) -> Design:
        """All features and n-grams of a cohort in one vector; conditions and ablations are slices of it."""
        if cohort not in self._designs:
            counts, split = self.of(self.grams, cohort), self.of(self.split, cohort)
            words = en.fit_vocabulary(counts, split.filter("part = 'train'"))
            self._designs[cohort] = design(self.of(self.matrix, cohort), split, pl.LABEL, list(mo.EVERY), list(ft.CATEGORICAL), (counts, words))
        return self._designs[cohort]

    def view(self, cohort: str, condition: str) -> View:
        """A named condition, or feature groups joined by ``+``."""
        columns = mo.CONDITIONS[condition] if condition in mo.CONDITIONS else [f for g in condition.split("+") for f in ft.GROUPS[g]]
        return self.design(cohort).view(columns)

    @cached_property
    def tagged(self) -> DataFrame:
        """Test rows of both cohorts by the stored, tuned forest: cohort, hadm_id, label, score, pred, tag and all features.

        The forest is fitted on the training rows, its threshold tuned on the validation rows."""
        parts = []
        for cohort in COHORTS:
            view, split_id, name = self.view(cohort, "With Process"), self.split_ids[cohort], f"forest-{cohort}"
            self.models.save(name, mo.fit("RF-tuned", view), split_id)
            rows = mo.scored(self.models.load(name, split_id), view.rows.filter("part <> 'train'"), "part")
            parts.append(rows.withColumn("cohort", F.lit(cohort)))
        self.forest_scores = durable(reduce(lambda a, b: a.unionByName(b), parts))
        tuned = me.best_threshold(self.forest_scores.filter("part = 'val'"), ["cohort"]).select("cohort", "threshold")
        test = self.forest_scores.filter("part = 'test'").drop("part").join(tuned, "cohort")
        tags = me.confusion_tags(test, F.col("threshold"))
        return durable(tags.join(self.matrix.select("cohort", "hadm_id", *ft.FEATURES), ["cohort", "hadm_id"]))

    def leak_view(self, cohort: str, setting: str) -> View:
        """All features with n-grams under one boundary of the audit."""
        key = f"{cohort}/{setting}"
        if key not in self._designs:
            counts, words = self.flagged
            own = self.of(counts, cohort).select("hadm_id", "ngram", F.col(en.BOUNDARIES[setting]).alias("n")).filter("n > 0")
            fitted = self.of(words, cohort).filter(F.col(setting)).select("ngram")
            self._designs[key] = design(self.of(self.matrix, cohort), self.of(self.split, cohort), pl.LABEL, list(mo.EVERY), list(ft.CATEGORICAL), (own, fitted))
        return self._designs[key].view(mo.CONDITIONS["With BoW"])

    @cached_property
    def flagged(self) -> tuple[DataFrame, DataFrame]:
        """N-gram counts on both sides of the point, and the vocabularies of the three boundaries, from one pass over the log."""
        counts = durable(en.flagged_ngrams(pl.log(self.t), pl.points(self.t), by=["cohort"]))
        return counts, durable(en.boundary_vocabularies(counts, self.split.filter("part = 'train'"), by=["cohort"]))

    def audit(self) -> int:
        """Fit the models of the leak audit; condition ``BoW A`` is boundary A."""
        cells: list[Cell] = [(c, f"BoW {b}", n, 42) for c in COHORTS for b in en.BOUNDARIES for n in ("LR", "RF")]
        for c in COHORTS:
            for b in en.BOUNDARIES:
                self.leak_view(c, b)
        return run_cells(self.store, cells, self.split_ids, lambda c, k: self.leak_view(c, k.removeprefix("BoW ")), mo.fit_predict)

    def run(self, conditions, models, seeds=SEEDS, cohorts=COHORTS) -> int:
        """Fit what the store lacks; how many cells that were."""
        cells: list[Cell] = [(c, k, n, s) for c in cohorts for k in conditions for n in models for s in seeds]
        self._prepare(cohorts)  # before the threads, so that each is made once
        return run_cells(self.store, cells, self.split_ids, self.view, mo.fit_predict)

    def ablations(self) -> None:
        """Fit what the store lacks of the ablation plan: a cohort's logistic models side by side on one matrix."""
        chosen = {mo.choice_name(columns): columns for *_, columns in mo.ablation_plan()}
        todo = self.store.missing([(c, name, "LR", s) for c in COHORTS for name in chosen for s in SEEDS], self.split_ids)
        for cohort in COHORTS:
            cells = [c for c in todo if c[0] == cohort]
            if cells:
                whole = self.design(cohort).indices(mo.EVERY)
                place = {j: i for i, j in enumerate(whole)}
                slices = [[place[j] for j in self.design(cohort).indices(chosen[name])] for _, name, *_ in cells]
                self.store.save_ridges(cells, self.split_ids[cohort], self.design(cohort).view(mo.EVERY), slices)


_STUDIES: dict[tuple[str, str], Study] = {}
_LOCK = threading.Lock()


def study(t: pl.Tables) -> Study:
    """The study of a folder in this session; the given tables do not change while it lives."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    with _LOCK:
        if key not in _STUDIES:
            _STUDIES[key] = Study(t.spark, t.folder)
        return _STUDIES[key]
