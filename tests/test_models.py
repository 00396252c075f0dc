import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import design as de
from caseflow.operators import features as ft
from caseflow.operators import gate
from caseflow.operators import metrics as me
from caseflow.operators import models as mo
from caseflow.operators import perceptron as pc
from caseflow.operators import runs as rn
from caseflow.operators import split as sp
from tests.conftest import at


@pytest.fixture(scope="module")
def cells(spark):
    """A matrix whose process group decides the label and whose other features are noise."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.3)
        row = {"hadm_id": i, "subject_id": i // 2, "left_shift": y}
        for f in ft.FEATURES:
            if f in ft.CATEGORICAL:
                row[f] = rng.choice(["a", "b"])
            else:
                row[f] = rng.gauss(2.0 * y if f in ft.GROUPS["process"] else 0.0, 1.0)
        rows.append(tuple(row.values()))
    schema = "hadm_id BIGINT, subject_id BIGINT, left_shift INT, " + ", ".join(
        f"{f} {'STRING' if f in ft.CATEGORICAL else 'DOUBLE'}" for f in ft.FEATURES
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def split(cells):
    return sp.grouped_split(cells, "left_shift")


@pytest.fixture(scope="module")
def grams(spark, cells):
    """N-grams for some of the cases, one of them in no training case."""
    rows = [(i, f"g{j}", 1 + (i + j) % 3) for i in range(0, 240, 3) for j in range(i % 5)]
    return spark.createDataFrame(rows, "hadm_id BIGINT, ngram STRING, n BIGINT")


@pytest.fixture(scope="module")
def data(cells, split, grams):
    return de.design(cells, split, "left_shift", list(mo.EVERY), list(ft.CATEGORICAL), (grams, grams.select("ngram").filter("ngram <> 'g2'")))


@pytest.fixture(scope="module")
def view(data):
    return data.view(mo.EVERY)


def test_vectors_hold_what_the_matrix_says(cells, split, grams, data):
    """One-hot columns, counts and population deviations of the training rows, by hand."""
    table, part = cells.toPandas(), split.toPandas().set_index("hadm_id")["part"]
    columns = {}
    for f in [f for f in mo.EVERY if f not in ft.CATEGORICAL]:
        columns[f] = table[f].to_numpy()
    for f in [f for f in mo.EVERY if f in ft.CATEGORICAL]:
        for value in sorted(table[f].unique()):
            columns[f, value] = (table[f] == value).to_numpy(float)
    counted = grams.toPandas().pivot(index="hadm_id", columns="ngram", values="n").reindex(table["hadm_id"]).fillna(0)
    for g in ("g0", "g1", "g3"):
        columns["bow", g] = counted[g].to_numpy()
    want = np.stack(list(columns.values()), 1)
    train = (table["hadm_id"].map(part) == "train").to_numpy()
    want = want / want[train].std(0)
    got = {r["hadm_id"]: r["features"].toArray() for r in data.rows.collect()}
    assert sorted(got) == sorted(part.index)
    for i, hadm_id in enumerate(table["hadm_id"]):
        assert got[hadm_id] == pytest.approx(want[i])
    assert data.blocks["bow"] == (47, 50) and data.blocks["age_band"] == (31, 33)
    weights = {r["label"]: r["weight"] for r in data.view(mo.EVERY).train.select("label", "weight").distinct().collect()}
    y = table["left_shift"].to_numpy()[train]
    assert weights == pytest.approx({c: len(y) / 2 / (y == c).sum() for c in (0, 1)})


def test_views_are_slices(data):
    whole = {r["hadm_id"]: r["features"].toArray() for r in data.rows.collect()}
    part = data.view(("bow", "charlson_score", "gender"))
    keep = [i for c in ("charlson_score", "gender", "bow") for i in range(*data.blocks[c])]
    assert part.size == len(keep) == 6
    for r in part.rows.collect():
        assert r["features"].toArray() == pytest.approx(whole[r["hadm_id"]][keep])


def auroc(scored):
    return me.rank_metrics(scored.withColumn("run", F.lit(1)), ["run"]).first()["AUROC"]


OPTIONS = {"LR": {}, "RF": {"trees": 20, "depth": 5}, "RF-tuned": {"trees": 15}, "GB": {"rounds": 10}, "MLP": {"epochs": 40, "batch": 16, "patience": 5}, "KNN": {}}


@pytest.mark.parametrize("name", OPTIONS)
def test_models_find_the_signal(view, name):
    found = mo.fit_predict(name, view, **OPTIONS[name])
    assert found.count() == view.test.count() and auroc(found) > 0.75


def test_logistic_is_the_ridge_optimum(view):
    """Gradient 0, and the coefficients that Newton steps by hand lead to."""
    model = mo.fit("LR", view)
    assert mo.ridge_gradient(model, view) < 1e-6
    assert mo.ridge_gradient(mo.fit("LR", view, rounds=2), view) > 1e-3
    rows = view.train.collect()
    x, y, w = np.array([[*r["features"].toArray(), 1.0] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])
    penalty, beta = np.diag([1.0] * view.size + [0.0]), np.zeros(view.size + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(beta)), x.T @ (w * (p - y)) + penalty @ beta)
    assert [*model.coefficients, model.intercept] == pytest.approx(beta, abs=1e-4)


def test_perceptron_gradient():
    rng = np.random.default_rng(1)
    sizes = [4, 3, 5, 1]
    flat, x, y = pc._flat(pc._begin(sizes, 7)), rng.normal(size=(9, 4)), (rng.random(9) < 0.4).astype(float)
    masks = [(rng.random((9, n)) < 0.7) / 0.7 for n in (3, 5)]
    loss = lambda f: pc.gradient(pc._shaped(f, sizes), x, y, 2.5, masks)[0]
    want = np.array([(loss(flat + 1e-6 * e) - loss(flat - 1e-6 * e)) / 2e-6 for e in np.eye(len(flat))])
    assert pc._flat(pc.gradient(pc._shaped(flat, sizes), x, y, 2.5, masks)[1]) == pytest.approx(want, abs=1e-6)


def test_perceptron_stops_early_and_keeps_the_best(spark, view):
    settings = pc.Perceptron(epochs=60, patience=3, batch=16, part_rows=60, hidden=(8,))
    fitted = pc.fit_perceptron(view, settings)
    values = [a for _, a in fitted.curve]
    assert len(values) < 60 and fitted.best_round == len(values) - 3
    assert values[fitted.best_round - 1] == max(values) > 0.75
    assert fitted.curve_table(spark).count() == len(values)
    again = pc.fit_perceptron(view, settings)
    assert [a for _, a in again.curve] == values and again.weights == pytest.approx(fitted.weights)


def test_grid_goes_on_where_it_was(spark, view, tmp_path):
    asked = []

    def fit(model, rows, seed):
        asked.append((model, seed))
        if model == "broken":
            raise RuntimeError("lost")
        return rows.test.select("hadm_id", "label", (F.col("label") * 0.5 + 0.25).alias("score"))

    store, ids = rn.RunStore(spark, str(tmp_path / "runs")), {"SW": "a" * 16}
    cells = [("SW", "With Process", m, s) for m in ("LR", "RF") for s in (1, 2)]
    run = lambda cells, ids=ids: rn.run_cells(store, cells, ids, lambda *_: view, fit)
    assert run(cells[:1]) == 1 and run(cells) == 3 and run(cells) == 0
    assert sorted(asked) == [("LR", 1), ("LR", 2), ("RF", 1), ("RF", 2)]
    with pytest.raises(RuntimeError):
        run([("SW", "With Process", "broken", 1)])
    assert store.missing([("SW", "With Process", "broken", 1)], ids) == [("SW", "With Process", "broken", 1)]
    assert len(store.missing(cells, {"SW": "b" * 16})) == 4  # another split, another run
    found = store.results().collect()
    assert len(found) == 4 and {(r["AUROC"], r["n_features"], r["split_id"]) for r in found} == {(1.0, view.size, "a" * 16)}


def test_ablation_blames_the_process_group(spark, view, data, tmp_path):
    store = rn.RunStore(spark, str(tmp_path / "runs"))
    choices = {mo.choice_name(c): c for *_, c in mo.ablation_plan()}
    assert len(choices) == 17
    cells = [("SW", name, "LR", 42) for name in choices]
    assert rn.run_cells(store, cells, {"SW": "x"}, lambda _, name: data.view(choices[name]), mo.fit_predict) == 17
    rows = mo.ablation_tables(store.results(), ["SW"]).collect()
    of = lambda table: {r["name"]: r for r in rows if r["table"] == table}
    drops = {n: r["change"] for n, r in of("leave_one_out").items()}
    assert len(drops) == 7 and max(drops, key=drops.get) == "process" and drops["(none) FULL"] == 0
    steps = sorted(of("incremental").values(), key=lambda r: r["step"])
    assert steps[0]["change"] is None and steps[-1]["name"] == "process" and steps[-1]["change"] > 0.2
    assert [r["n_features"] for r in steps] == [10, 19, 20, 21, 39, 47]
    assert len(of("single_group")) == 6 and of("temporal_validity")["minus 20 discharge-assigned features"]["n_features"] == 27


def test_stored_forest_belongs_to_its_split(spark, view, tmp_path):
    store = rn.ModelStore(spark, str(tmp_path / "models"))
    model = mo.fit("RF-tuned", view, trees=5)
    store.save("forest", model, "a" * 16)
    again = store.load("forest", "a" * 16)
    scores = lambda x: sorted(map(tuple, mo.scored(x, view.test).collect()))
    assert scores(again) == scores(model)
    with pytest.raises(rn.WrongSplit, match="b" * 16):
        store.load("forest", "b" * 16)


def test_gate(spark, cells, tmp_path):
    write = lambda df, name: gate.write_checked(df, str(tmp_path / name), "left_shift")
    assert write(cells, "good") == [] and gate.read_checked(spark, str(tmp_path / "good")).count() == 240
    faulty = cells.withColumn("charlson_score", F.when(F.col("hadm_id") > 3, F.col("charlson_score"))).unionByName(cells.limit(2)).withColumn("odd", F.lit(1)).drop("gender")
    assert write(faulty, "bad") == ["missing: gender", "unexpected: odd", "NULL in charlson_score: 4", "repeated ids: 2"]
    with pytest.raises(gate.Refused, match="repeated ids: 2"):
        gate.read_checked(spark, str(tmp_path / "bad"))
    assert write(cells.limit(0), "none") == ["no rows"]


def test_conditions(cells):
    wide = cells.selectExpr("*", "1 AS bow_x")
    count = lambda c: len(ft.condition_columns(wide, c, "left_shift"))
    assert (count("No Process"), count("With Process"), count("With BoW")) == (32, 39, 40)
    assert {c: len(f) for c, f in mo.CONDITIONS.items()} == {"No Process": 32, "With Process": 39, "With BoW": 40}
    assert ft.check_matrix(cells, "left_shift") == []


def test_perceptron_rows_lie_packed_by_part(spark):
    """An epoch reads the parts where they are; every row was exchanged anew in each epoch."""
    rows = spark.range(50).selectExpr("id AS hadm_id", "CAST(id % 2 AS INT) AS label", "array(CAST(id AS DOUBLE), 1.0D) AS x", "CAST(id % 3 AS INT) AS p")
    packed = pc._packed(rows, 3)
    found = packed.withColumn("at", F.spark_partition_id()).collect()
    assert len({(r["p"], r["at"]) for r in found}) == 3 and sum(r["n"] for r in found) == 50
    for r in found:
        assert [int(v) for v in np.frombuffer(r["x"]).reshape(-1, 2)[:, 0]] == list(range(r["p"], 50, 3))
    assert pc._means(packed, 2) == pytest.approx([24.5, 1.0])


def test_study_makes_shared_tables_once(spark, tmp_path, monkeypatch):
    """N-grams, split and matrix read one written copy of the return frames, and facts are thinned where they are read."""
    from caseflow.operators import labels as lb
    from caseflow.plans.study import Study

    key, write = F.col("id"), lambda df, name: df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("view", "purchase", "click", "signup")]), (F.xxhash64("id") % 4 + 5).cast("int") % 4 + 1)
    when = F.lit(at(0)) + F.make_dt_interval((key % 25).cast("int"), F.lit(0), (key % 60).cast("int"))
    write(spark.range(900).select(key.alias("event_id"), when.alias("ts"), (key % 31).alias("user_id"), kinds.alias("event_type"), (key % 37).cast("double").alias("value")), "events")
    write(spark.range(3000).select(key.alias("o_orderkey"), (key % 70).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), when.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")), "orders")
    line = {"l_orderkey": key % 3000, "l_partkey": key % 50, "l_suppkey": key % 9, "l_linenumber": (key % 7).cast("int"), "l_returnflag": F.lit("R"), "l_linestatus": F.lit("O")}
    write(spark.range(9000).select(*[c.alias(n) for n, c in line.items()]), "lineitem")
    write(spark.range(50).select(key.alias("p_partkey"), key.cast("string").alias("p_name")), "part")
    write(spark.range(70).select(key.alias("c_custkey"), (key % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")), "customer")
    write(spark.range(25).select(key.cast("int").alias("n_nationkey"), F.concat(F.lit("nation_"), key).alias("n_name")), "nation")
    made, counted = [], []
    returns, labs = lb.cohort_returns, ft.lab_counts
    monkeypatch.setattr(lb, "cohort_returns", lambda *a, **k: made.append(1) or returns(*a, **k))
    monkeypatch.setattr(ft, "lab_counts", lambda rows: counted.append(rows.count()) or labs(rows))
    s = Study(spark, str(tmp_path))
    assert s.run(("With Process",), ("LR",)) == 2 and len(made) == 1
    cases = s.matrix.select("hadm_id").distinct()
    assert cases.count() <= 31 * 6 and counted[0] < 1200
    got = {r["hadm_id"]: r for r in s.matrix.collect()}
    assert all(r["pct_abnormal_labs"] == 100 and 1 <= r["num_medications"] <= 3 and r["admission_type"] != "UNKNOWN" for r in got.values())
