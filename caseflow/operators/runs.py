"""Model runs that can be stopped and resumed: a store of finished cells, fitted side by side.

A cell is (Cohort, Condition, Model, Seed) on one split.  Its test scores are written first, its run row
after them; a cell counts as finished once its run row is there.  What is wanted and not finished is
found by an anti-join, so a second call fits nothing and a stopped one goes on where it was.  Metrics of all cells
come from one pass over the stored scores.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import metrics
from caseflow.operators.design import View
from caseflow.operators.forest import Forest
from caseflow.operators.ridge import fit_ridges, ridge_scores
from caseflow.session import durable

CELL = ["Cohort", "Condition", "Model", "Seed"]
RUN = "Cohort STRING, Condition STRING, Model STRING, Seed INT, split_id STRING, n_features INT, Train_Time_s DOUBLE, Test_Time_s DOUBLE, pos_rate DOUBLE, n_train BIGINT, cell STRING"
SCORE = "cell STRING, hadm_id BIGINT, label INT, score DOUBLE"
#: Fits that run at the same time; each is many small jobs, and their gaps overlap.
AT_ONCE = 4

Cell = tuple[str, str, str, int]


@dataclass(frozen=True)
class RunStore:
    """Run rows and scores below one folder."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("append").parquet(f"{self.folder}/{name}/begin")
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def runs(self) -> DataFrame:
        return self._read("runs", RUN)

    def scores(self) -> DataFrame:
        """(CELL, split_id, hadm_id, label, score) of finished cells."""
        keys = self.runs().select(*CELL, "split_id", "cell")
        return self._read("scores", SCORE).join(keys, "cell").drop("cell")

    def save(self, cell: Cell, split_id: str, scored: DataFrame, facts: Callable[[], dict]) -> None:
        """Scores first; ``facts`` is asked for after they are written."""
        name = uuid.uuid4().hex
        scored.select(F.lit(name).alias("cell"), "hadm_id", F.col("label").cast("int"), F.col("score").cast("double")).write.parquet(f"{self.folder}/scores/{name}")
        row = dict(zip(CELL, cell)) | {"split_id": split_id, "cell": name} | facts()
        columns = [c.split()[0] for c in RUN.split(", ")]
        self.spark.createDataFrame([tuple(row[c] for c in columns)], RUN).coalesce(1).write.parquet(f"{self.folder}/runs/{name}")

    def save_ridges(self, cells: list[Cell], split_id: str, view: View, slices: list[list[int]]) -> None:
        """Logistic models of the cells, each on a slice of the view, fitted side by side; their seconds are shared out."""
        started, places = time.perf_counter(), [np.array(s, dtype=np.int64) for s in slices]
        betas = fit_ridges(view.train, places)
        fitted = time.perf_counter()
        names = [uuid.uuid4().hex for _ in cells]
        ridge_scores(view.test, places, betas, names).write.parquet(f"{self.folder}/scores/{names[0]}")
        tested = time.perf_counter()
        n, rate = view.train.agg(F.count("label"), F.round(F.avg("label"), 4)).first()
        share = lambda a, b: round((b - a) / len(cells), 3)
        rows = [(*c, split_id, len(s), share(started, fitted), share(fitted, tested), rate, n, name) for c, s, name in zip(cells, slices, names)]
        self.spark.createDataFrame(rows, RUN).coalesce(1).write.parquet(f"{self.folder}/runs/{names[0]}")

    def missing(self, wanted: Iterable[Cell], split_ids: dict[str, str]) -> list[Cell]:
        """Wanted cells without a run row on their cohort's split."""
        rows = [(*cell, split_ids[cell[0]]) for cell in wanted]
        asked = self.spark.createDataFrame(rows, "Cohort STRING, Condition STRING, Model STRING, Seed INT, split_id STRING")
        left = asked.join(self.runs(), [*CELL, "split_id"], "left_anti")
        return sorted(tuple(r[c] for c in CELL) for r in left.collect())  # no more than were asked for

    def results(self) -> DataFrame:
        """One row per finished cell: metrics at 0.5, rank metrics, times, sizes and split."""
        # A score goes on with its cell's number (a row per cell) instead of the cell's names.
        runs = durable(self.runs().withColumn("at", F.row_number().over(Window.orderBy("cell"))))
        scored = self._read("scores", SCORE).join(F.broadcast(runs.select("cell", "at")), "cell").select("at", "label", "score")
        at_half = metrics.threshold_metrics(scored, ["at"]).select("at", "Accuracy", "Precision", "Recall", "F1")
        ranked = metrics.rank_metrics(scored, ["at"]).select("at", "AUROC", "AUPRC")
        return runs.drop("cell").join(at_half, "at", "left").join(ranked, "at", "left").drop("at")


class WrongSplit(ValueError):
    """A stored model was fitted on another split than the one its reader works on."""


@dataclass(frozen=True)
class ModelStore:
    """Fitted models below one folder, each with the id of the split it was fitted on."""

    _FACTS = "split_id STRING, is_forest BOOLEAN"
    spark: SparkSession
    folder: str

    def save(self, name: str, model, split_id: str) -> None:
        """The model first, its split after it: a model without a split does not count."""
        where, own = f"{self.folder}/{name}/model", isinstance(model, Forest)
        model.save(where) if own else PipelineModel(stages=[model]).write().save(where)
        facts = self.spark.createDataFrame([(split_id, own)], self._FACTS)
        facts.coalesce(1).write.mode("errorifexists").json(f"{self.folder}/{name}/facts")

    def load(self, name: str, split_id: str) -> PipelineModel | Forest:
        said = self.spark.read.schema(self._FACTS).json(f"{self.folder}/{name}/facts").first()
        if said is None or said["split_id"] != split_id:
            raise WrongSplit(f"{name} was fitted on split {said and said['split_id']}, asked for {split_id}")
        where = f"{self.folder}/{name}/model"
        return Forest.load(self.spark, where) if said["is_forest"] else PipelineModel.load(where)


def run_cells(store: RunStore, cells: list[Cell], split_ids: dict[str, str], view: Callable[[str, str], View], fit: Callable[[str, View, int], DataFrame], at_once: int = AT_ONCE) -> int:
    """Fit the cells that are not in the store yet, several at a time in pools of their own; how many were fitted.

    ``view`` gives the prepared rows of (cohort, condition), ``fit`` the scored test rows of (model, view, seed).
    """
    spark = store.spark
    todo = store.missing(cells, split_ids)

    @inheritable_thread_target(spark)
    def one(cell: Cell) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "-".join(map(str, cell)))
        cohort, condition, model, seed = cell
        rows = view(cohort, condition)
        started = time.perf_counter()
        scored = fit(model, rows, seed)
        fitted = time.perf_counter()

        def facts() -> dict:
            tested = time.perf_counter()
            n, rate = rows.train.agg(F.count("label"), F.round(F.avg("label"), 4)).first()
            return {"n_features": rows.size, "Train_Time_s": round(fitted - started, 3), "Test_Time_s": round(tested - fitted, 3), "pos_rate": rate, "n_train": n}

        store.save(cell, split_ids[cohort], scored, facts)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for done in [pool.submit(one, cell) for cell in todo]:
            done.result()
    return len(todo)
