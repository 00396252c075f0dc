import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseflow.operators import design as de
from caseflow.operators import models as mo
from caseflow.operators import ridge as ri
from caseflow.operators import runs as rn


@pytest.fixture(scope="module")
def view(spark):
    x = F.expr("transform(sequence(1, 5), j -> CAST(xxhash64(id, j) % 1000 AS DOUBLE) / 400)")
    label = F.expr("CAST(x[0] + x[1] + CAST(xxhash64(id, 9) % 1000 AS DOUBLE) / 300 > 1 AS INT)")
    rows = spark.range(400).select("id", x.alias("x")).select(
        F.col("id").alias("hadm_id"), label.alias("label"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("part"),
        (1 + label).cast("double").alias("weight"), array_to_vector("x").alias("features"),
    )
    return de.View(rows.localCheckpoint(), 5)


def test_side_by_side_as_one_by_one(view):
    """Every slice ends where the single fit on that slice does, as the gradient and its coefficients tell."""
    slices = [np.array(s) for s in ([0, 1, 2, 3, 4], [1, 3], [2])]
    for place, beta in zip(slices, ri.fit_ridges(view.train, slices)):
        blocks = {str(j): (j, j + 1) for j in range(5)}
        own = de.Design(view.rows, blocks).view([str(j) for j in place])
        model = mo.fit("LR", own)
        assert [*model.coefficients, model.intercept] == pytest.approx(beta, abs=1e-5)


def test_separable_and_constant_inputs(spark):
    rows = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS label", "1.0D AS weight", "array(CAST(id % 2 AS DOUBLE) * 9, 0.0D) AS x").select("label", "weight", array_to_vector("x").alias("features"))
    beta = ri.fit_ridges(rows, [np.array([0, 1]), np.array([1])])
    assert np.isfinite(beta[0]).all() and beta[0][0] > 0 and beta[1] == pytest.approx([0, 0], abs=1e-6)


def test_cells_of_a_plan_take_few_jobs(spark, view, tmp_path):
    """16 cells: each was a fit of its own, with a job per step."""
    store = rn.RunStore(spark, str(tmp_path / "runs"))
    cells = [("SW", f"c{i}", "LR", 42) for i in range(16)]
    spark.sparkContext.setJobGroup("ridges", "fit")
    store.save_ridges(cells, "a" * 16, view, [[i % 5, (i + 1) % 5] for i in range(16)])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ridges"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 80 and store.missing(cells, {"SW": "a" * 16}) == []
    found = {r["Condition"]: r for r in store.results().collect()}
    assert len(found) == 16 and found["c0"]["AUROC"] > 0.8 > found["c2"]["AUROC"] and found["c0"]["n_features"] == 2
    assert store.scores().count() == 16 * 100
