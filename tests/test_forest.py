import numpy as np
import pytest

from caseflow.operators import forest as fo


@pytest.fixture(scope="module")
def train(spark):
    """4 000 rows: input 0 above 1 decides, one in ten labels is turned round, and the rest is noise."""
    x = [f"CAST(xxhash64(id, {j}) % 1000 AS DOUBLE) / 500" for j in range(6)]
    label = "CAST((x[0] > 1) <> (id % 10 = 0) AS INT)"
    rows = spark.range(4000).selectExpr("id AS hadm_id", f"array({', '.join(x)}) AS x").selectExpr("hadm_id", f"{label.replace('id %', 'hadm_id %')} AS label", "x")
    from pyspark.ml.functions import array_to_vector

    return rows.select("hadm_id", "label", fo.F.lit(1.0).alias("weight"), array_to_vector("x").alias("features"))


def scores(model, rows):
    return {r["hadm_id"]: r["score"] for r in model.scored(rows).collect()}


@pytest.mark.parametrize("node_rows", [100_000, 500])
def test_whole_and_cut_trees_find_the_rule(train, node_rows):
    """With few rows a node, the trees begin over the partitions."""
    model = fo.fit_forest(train, 6, fo.Settings(12, 30, 5, 42, node_rows))
    assert (len(model.top.feature[0]) > 1) == (node_rows == 500)
    found = scores(model, train)
    assert len(found) == 4000
    x = {r["hadm_id"]: r["features"][0] for r in train.collect()}
    assert np.mean([(found[i] > 0.5) == (x[i] > 1) for i in x]) > 0.97


def test_rows_in_any_order_give_one_forest(train):
    settings = fo.Settings(5, 30, 1, 7, 800)
    one, other = (fo.fit_forest(rows, 6, settings) for rows in (train, train.repartition(7, "label")))
    assert scores(one, train) == scores(other, train)


def test_a_tree_ends_where_it_must():
    """Against a plain search: leaves are pure, or their rows cannot be told apart; ``leaf`` and ``depth`` hold."""
    rng = np.random.default_rng(3)
    x, y, n = rng.integers(0, 4, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300), rng.integers(1, 3, 300).astype(float)
    for depth, leaf in ((30, 1), (30, 9), (2, 1)):
        f, b, c, p = fo.grow(x, y, n, (1.0, 3.0), depth, leaf, np.random.default_rng(1))
        at = fo.walk(x, f, b, c)
        for node in np.unique(at):
            own = at == node
            pos, neg = n[own & (y == 1)].sum() * 3, n[own & (y == 0)].sum()
            assert f[node] == -1 and p[node] == pytest.approx(pos / (pos + neg)) and n[own].sum() >= leaf
        assert len(np.unique(at)) <= 2**depth


def test_bootstrap_counts():
    n = fo.drawn(np.arange(200_000), 3, 42)
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02)
    assert (n != fo.drawn(np.arange(200_000), 4, 42)).mean() > 0.5


def test_deep_trees_on_noise_take_no_job_per_level(spark):
    """100 trees of depth 30 on 3 000 rows of noise: every level was a round of jobs over all of its nodes."""
    from pyspark.ml.functions import array_to_vector

    x = fo.F.expr("transform(sequence(1, 20), j -> CAST(xxhash64(id, j) % 1000 AS DOUBLE) / 500)")
    rows = spark.range(3000).select(fo.F.col("id").alias("hadm_id"), fo.F.expr("CAST(xxhash64(id) % 5 = 0 AS INT)").alias("label"), fo.F.lit(1.0).alias("weight"), array_to_vector(x).alias("features"))
    rows = rows.localCheckpoint()
    spark.sparkContext.setJobGroup("forest", "fit")
    model = fo.fit_forest(rows, 20, fo.Settings(100, 30, 1, 42))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 15 and model.grown.count() == 100
