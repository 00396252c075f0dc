"""Queries on fitted models, and the SQL for what SQL can tell about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import analysis as an
from caseflow.operators import design as de
from caseflow.operators import encode as en
from caseflow.operators import features as ft
from caseflow.operators import metrics as me
from caseflow.operators import models as mo
from caseflow.operators import neighbours as nb
from caseflow.operators import perceptron as pc
from caseflow.operators.runs import CELL
from caseflow.plans import oracle
from caseflow.plans import pipeline as pl
from caseflow.plans.queries import BY, QUERIES, keeping_query, query
from caseflow.plans.study import COHORTS, study
from caseflow.session import durable
from caseflow.sources import mapping as m

__all__ = ["QUERIES", "ORACLE"]
ORACLE = oracle.ORACLE

# --- sizes of the vectors, as SQL -------------------------------------------------------------------------------

_CATEGORIES = {c: g for g, own in ft.GROUPS.items() for c in own if c in ft.CATEGORICAL}
_FIXED = {g: sum(c not in ft.CATEGORICAL for c in own) for g, own in ft.GROUPS.items()}
oracle.add_cte("blocks", " UNION ALL ".join(
    [f"SELECT cohort, '{g}' AS grp, count(DISTINCT coalesce({c}, 'UNKNOWN')) AS n FROM matrix GROUP BY cohort" for c, g in _CATEGORIES.items()]
    + [f"SELECT cohort, '{g}', {n} FROM tiers" for g, n in _FIXED.items()]
    + ["SELECT cohort, 'bow', count(*) FROM vocab GROUP BY cohort"]
))
oracle.add_cte("group_sizes", "SELECT cohort, grp, sum(n) AS n FROM blocks GROUP BY ALL")
oracle.add_cte("split_sizes", """SELECT s.cohort, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test,
    count(*) FILTER (part = 'test' AND s.left_lat = 1) AS n_pos, round(avg(s.left_lat) FILTER (part = 'train'), 4) AS pos_rate FROM split s GROUP BY s.cohort""")
oracle.add_cte("conditions", """SELECT * FROM (VALUES ('No Process', false, false), ('With Process', true, false), ('With BoW', true, true)) t(Condition, process, bow)""")
oracle.add_cte("condition_sizes", """SELECT cohort, Condition, sum(n) FILTER ((grp <> 'process' OR process) AND (grp <> 'bow' OR bow))::INTEGER AS n_features
    FROM group_sizes, conditions GROUP BY ALL""")
_RUNS = "FROM condition_sizes c JOIN split_sizes s USING (cohort)"


# --- n-grams as sparse vectors ----------------------------------------------------------------------------------


@keeping_query
def bow_matrix(t):
    """The bag of every case in the matrix: vector size, and ``index:count`` read back from the vector."""
    counts = en.ngrams(pl.log(t), pl.points(t), by=BY)
    words = en.fit_vocabulary(counts, pl.split(t).filter("part = 'train'"), by=BY)
    bags = de.bag_vectors(pl.labels(t), counts, words, BY).withColumn("e", de.entries_of("bag"))
    entry = lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("long").cast("string"))
    return bags.select("cohort", "hadm_id", F.col("e.size").alias("size"), F.array_join(F.zip_with("e.indices", "e.values", entry), " ").alias("bag"))


ORACLE["bow_matrix"] = oracle.sql("""SELECT l.cohort, l.hadm_id, coalesce(any_value(size), 0)::INTEGER AS size, coalesce(string_agg(place || ':' || n, ' ' ORDER BY place), '') AS bag
    FROM labelled l LEFT JOIN (SELECT cohort, count(*) AS size FROM vocab GROUP BY cohort) z ON l.cohort = z.cohort
    LEFT JOIN (SELECT c.*, place FROM counts c JOIN (SELECT cohort, ngram, row_number() OVER (PARTITION BY cohort ORDER BY ngram) - 1 AS place FROM vocab) w USING (cohort, ngram)) c
    ON l.cohort = c.cohort AND l.hadm_id = c.hadm_id GROUP BY l.cohort, l.hadm_id""")


# --- runs ---------------------------------------------------------------------------------------------------------


def _sizes(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Per cell: sizes from the run rows, and from the scores how many rows there are, how many positive, and whether all are probabilities."""
    keys = [*CELL, "split_id"]
    seen = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.sum("label").alias("n_pos"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))
    return results.select(*keys, "n_features", "n_train", "pos_rate").join(seen, keys)


_SIZES = "n_features, n_train, pos_rate, n_test, n_pos, true AS in_range"


@keeping_query
def model_grid(t):
    """Both cohorts, three conditions, four models; ``refitted`` tells what a second call had to fit."""
    s = study(t)
    s.run(mo.CONDITIONS, mo.CLASSICAL)
    again = s.run(mo.CONDITIONS, mo.CLASSICAL)
    cells = _sizes(s.store.runs(), s.store.scores()).filter(F.col("Model").isin(*mo.CLASSICAL) & F.col("Condition").isin(*mo.CONDITIONS))
    return cells.drop("split_id").withColumn("refitted", F.lit(again))


ORACLE["model_grid"] = oracle.sql(f"""SELECT cohort AS Cohort, Condition, Model, 42 AS Seed, {_SIZES}, 0 AS refitted {_RUNS}, (VALUES ('LR'), ('RF'), ('GB'), ('KNN')) x(Model)""")


@keeping_query
def model_scores(t):
    """The result table: metrics, times, sizes and split of every cell of the grid and the perceptron."""
    s = study(t)
    s.run(mo.CONDITIONS, mo.CLASSICAL)
    s.run(("No Process", "With Process"), ("MLP",))
    return s.store.results().filter(F.col("Condition").isin(*mo.CONDITIONS))


def _model(name: str, model: str) -> None:
    def build(t):
        s = study(t)
        s.run(("With Process",), (model,))
        cells = _sizes(s.store.runs(), s.store.scores())
        return cells.filter(F.col("Model") == model).filter("Condition = 'With Process'").drop("split_id", "Model")

    build.__name__ = name
    keeping_query(build)
    ORACLE[name] = oracle.sql(f"SELECT cohort AS Cohort, Condition, 42 AS Seed, {_SIZES} {_RUNS} WHERE Condition = 'With Process'")


for _name, _short in {"logreg": "LR", "random_forest": "RF", "gbt": "GB", "knn_matrix": "KNN", "mlp": "MLP"}.items():
    _model(_name, _short)


def fit_seconds(spark, folder: str) -> dict[str, float]:
    """Seconds of the stored fits with process features on the ward cohort, by model."""
    rows = study(pl.Tables(spark, folder)).store.runs().filter("Condition = 'With Process' AND Cohort = 'SW'").collect()
    return {r["Model"]: r["Train_Time_s"] for r in rows}


@keeping_query
def ridge_optimum(t):
    """Is the fitted logistic model where the gradient of its penalised loss vanishes?"""
    s, rows = study(t), []
    for cohort in COHORTS:
        view = s.view(cohort, "With Process")
        rows.append((cohort, view.size, bool(mo.ridge_gradient(mo.fit("LR", view), view) < 1e-4)))
    return t.spark.createDataFrame(rows, "cohort STRING, n_features INT, at_optimum BOOLEAN")


ORACLE["ridge_optimum"] = oracle.sql("SELECT cohort, n_features, true AS at_optimum FROM condition_sizes WHERE Condition = 'With Process'")


def _curves(t) -> DataFrame:
    """(cohort, n_features, epoch, AUROC, best_round): the validation curve of the perceptron of each cohort."""
    s, parts = study(t), []
    for cohort in COHORTS:
        view = s.view(cohort, "With Process")
        fitted = pc.fit_perceptron(view)
        facts = {"cohort": F.lit(cohort), "n_features": F.lit(view.size), "best_round": F.lit(fitted.best_round)}
        parts.append(fitted.curve_table(t.spark).withColumns(facts))
    return reduce(lambda a, b: a.unionByName(b), parts)


@keeping_query
def mlp_curve(t):
    """Validation AUROC after each epoch, and which epoch's weights are kept."""
    return _curves(t).select("cohort", "epoch", "AUROC", (F.col("epoch") == F.col("best_round")).alias("kept"))


@keeping_query
def mlp_training(t):
    """Are the best epoch's weights kept, and did training stop where its patience ended?"""
    settings = pc.Perceptron()
    curve = _curves(t).groupBy("cohort", "n_features", "best_round").agg(F.max("epoch").alias("last"), F.max("AUROC").alias("top"), F.max(F.when(F.col("epoch") == F.col("best_round"), F.col("AUROC"))).alias("kept"))
    stopped = (F.col("last") == settings.epochs) | (F.col("last") - F.col("best_round") == settings.patience)
    # An epoch must be better by more than 1e-6 to count as better.
    return curve.select("cohort", "n_features", (F.col("top") - F.col("kept") <= 1e-5).alias("best_kept"), stopped.alias("stopped_in_time"))


ORACLE["mlp_training"] = oracle.sql("SELECT cohort, n_features, true AS best_kept, true AS stopped_in_time FROM condition_sizes WHERE Condition = 'With Process'")


# --- neighbours through an index ------------------------------------------------------------------------------------


@query
def knn_index(t):
    """What the index found on the test vectors, measured against the exact neighbours of all of them."""
    rows = durable(m.vectors(*t.at))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    index = nb.fit_index(train)
    found, exact = durable(nb.nearest(train, test, index=index)), nb.nearest(train, test)
    counts = rows.agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))
    return counts.select(
        "n_train", "n_test", F.lit(found.count()).alias("n_found"), F.lit(nb.recall_of(found, exact) >= 0.9).alias("recall_reached"),
        (F.lit(index.pairs(test)) < F.col("n_train") * F.col("n_test")).alias("fewer_pairs"),
    )


ORACLE["knn_index"] = oracle.sql("""SELECT *, 5 * n_test AS n_found, true AS recall_reached, true AS fewer_pairs FROM (
    SELECT count(*) FILTER (d <> 0) AS n_train, count(*) FILTER (d = 0) AS n_test FROM (SELECT CAST('0x' || substring(md5(vec_id::VARCHAR), 1, 4) AS INT) % 5 AS d FROM embeddings))""")


@query
def knn_index_report(t):
    """Vectors, cells, probes, share of pairs compared and recall of the index on the test vectors."""
    rows = durable(m.vectors(*t.at))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    index = nb.fit_index(train)
    recall = nb.recall_of(nb.nearest(train, test, index=index), nb.nearest(train, test))
    n, asked = train.count(), test.count()
    row = (n, asked, len(index.centres), index.probes, round(index.pairs(test) / max(1, n * asked), 4), round(recall, 4))
    return t.spark.createDataFrame([row], "n_train BIGINT, n_test BIGINT, cells INT, probes INT, share DOUBLE, recall DOUBLE")


# --- error analysis of a stored forest --------------------------------------------------------------------------------

_NUMBERS = [f for f in ft.FEATURES if f not in ft.CATEGORICAL]
_PROFILED = ["age_band", "gender", "insurance", "admission_type", "bmi_category", "ethnicity"]


@keeping_query
def forest_error_meta(t):
    s = study(t)
    s.tagged
    return me.tuned_report(s.forest_scores, BY)


@keeping_query
def forest_tags(t):
    return study(t).tagged.select("cohort", "hadm_id", "label", "score", "pred", "tag")


@keeping_query
def forest_group_means(t):
    return an.group_means(study(t).tagged, _NUMBERS, BY)


@keeping_query
def forest_fn_vs_tp(t):
    return an.largest_first(an.fn_vs_tp(study(t).tagged, _NUMBERS, BY))


@keeping_query
def forest_miss_rate(t):
    return an.miss_rates(study(t).tagged, _PROFILED, BY)


@keeping_query
def forest_reconciled(t):
    """The error analysis put together again: its classes must add up to the test rows of the tables.

    Confusion counts give test rows, positives and negatives; class means times class sizes give the
    total of each of the 31 numeric features; miss rates give the positives of each category value."""
    tagged = study(t).tagged
    sizes = durable(me.tag_counts(tagged, BY))
    counts = {"n_test": F.col("n"), "n_pos": F.col("TP") + F.col("FN"), "n_neg": F.col("FP") + F.col("TN")}
    whole = sizes.select("cohort", *[c.cast("double").alias(n) for n, c in counts.items()]).unpivot(BY, list(counts), "fact", "value")
    total = sum((F.col(f"n_{g}") * F.coalesce(g, F.lit(0.0)) for g in me.TAGS), F.lit(0.0))
    means = an.group_means(tagged, _NUMBERS, BY).join(sizes.select("cohort", *[F.col(g).alias(f"n_{g}") for g in me.TAGS]), "cohort")
    features = means.select("cohort", F.concat(F.lit("total "), "feature").alias("fact"), F.round(total, 1).alias("value"))
    rates = an.miss_rates(tagged, _PROFILED, BY).filter(F.col("miss_rate").between(0, 1))
    values = rates.select("cohort", F.concat_ws(" ", F.lit("positives"), "feature", "value").alias("fact"), F.col("n_positives").cast("double").alias("value"))
    return whole.unionByName(features).unionByName(values)


oracle.add_cte("test_rows", "SELECT m.* FROM matrix m JOIN split s ON m.cohort = s.cohort AND m.hadm_id = s.hadm_id WHERE part = 'test'")
ORACLE["forest_reconciled"] = oracle.sql(" UNION ALL ".join(
    [f"SELECT cohort, '{fact}' AS fact, {n}::DOUBLE AS value FROM split_sizes" for fact, n in {"n_test": "n_test", "n_pos": "n_pos", "n_neg": "n_test - n_pos"}.items()]
    + [f"SELECT cohort, 'total {f}', round(coalesce(sum({f}), 0)::DOUBLE, 1) FROM test_rows GROUP BY cohort" for f in _NUMBERS]
    + [f"SELECT cohort, 'positives {c} ' || coalesce({c}, 'UNKNOWN'), count(*)::DOUBLE FROM test_rows WHERE left_shift = 1 GROUP BY ALL" for c in _PROFILED]
))


# --- leak audit with scores ---------------------------------------------------------------------------------------------


@keeping_query
def leak_scores(t):
    """LR and RF under the three boundaries: what a leaking vocabulary or prefix is worth."""
    s = study(t)
    s.audit()
    rows = s.store.results().filter("Condition LIKE 'BoW %'")
    return rows.select(F.substring("Condition", 5, 1).alias("Setting"), "Model", "Cohort", "n_features", "AUROC", "AUPRC", "F1", "Precision", "Recall", "Train_Time_s")


@keeping_query
def leak_runs(t):
    """Vocabulary, inputs and scored rows of every run of the audit."""
    s = study(t)
    s.audit()
    words = s.flagged[1].groupBy("cohort").agg(*[F.count_if(F.col(b)).alias(b) for b in en.BOUNDARIES])
    vocab = words.unpivot(["cohort"], list(en.BOUNDARIES), "Setting", "Vocab").withColumnRenamed("cohort", "Cohort")
    cells = _sizes(s.store.runs(), s.store.scores()).filter("Condition LIKE 'BoW %'").withColumn("Setting", F.substring("Condition", 5, 1))
    return cells.join(vocab, ["Cohort", "Setting"]).select("Setting", "Model", "Cohort", "Vocab", "n_features", "n_test", "n_pos", "in_range")


oracle.add_cte("upto", "SELECT p.cohort, l.* FROM log l JOIN points p ON l.case_id = p.hadm_id WHERE l.event_time <= p.prediction_point")
oracle.add_cte("grams_upto", """SELECT cohort, hadm_id, unnest([w0, w0 || ' ' || w1, w0 || ' ' || w1 || ' ' || w2]) AS ngram FROM (SELECT cohort, case_id AS hadm_id,
    w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT *, lower(replace(activity,' ','_')) AS w FROM upto)
    WINDOW o AS (PARTITION BY cohort, case_id ORDER BY event_time, tie))""")
oracle.add_cte("vocab_sizes", """SELECT 'A' AS Setting, cohort, count(*) AS Vocab FROM (SELECT cohort, ngram FROM grams_upto WHERE ngram IS NOT NULL GROUP BY ALL
    HAVING count(DISTINCT hadm_id) >= 2) GROUP BY cohort UNION ALL SELECT 'B', cohort, count(*) FROM (SELECT cohort, ngram FROM counts GROUP BY ALL
    HAVING count(*) >= 2) GROUP BY cohort UNION ALL SELECT 'C', cohort, count(*) FROM vocab GROUP BY cohort""")
ORACLE["leak_runs"] = oracle.sql("""SELECT Setting, Model, v.cohort AS Cohort, Vocab, (Vocab + n_features)::INTEGER AS n_features, n_test, n_pos, true AS in_range
    FROM vocab_sizes v JOIN condition_sizes c ON v.cohort = c.cohort AND c.Condition = 'With Process' JOIN split_sizes s ON v.cohort = s.cohort, (VALUES ('LR'), ('RF')) x(Model)""")


# --- ablations ------------------------------------------------------------------------------------------------------


def _ablated(t) -> tuple:
    s = study(t)
    s.ablations()
    return s, s.store


@keeping_query
def ablation_sizes(t):
    """Rows of the four ablation tables: which groups, how many inputs, on how many rows."""
    s, store = _ablated(t)
    plan = t.spark.createDataFrame([(a, b, c, mo.choice_name(d)) for a, b, c, d in mo.ablation_plan()], "table STRING, step INT, name STRING, Condition STRING")
    return plan.join(_sizes(store.runs(), store.scores()).filter("Model = 'LR'"), "Condition").select("table", "Cohort", "step", "name", "n_features", "n_train", "n_test", "n_pos")


_SETS = {
    (table, step, name): ", ".join(f"'{g}'" for g in mo.choice_name(columns).split("+")) for table, step, name, columns in mo.ablation_plan()
}
ORACLE["ablation_sizes"] = oracle.sql(" UNION ALL ".join(
    f"""SELECT '{table}' AS "table", g.cohort AS Cohort, {step} AS step, '{name}' AS name, (SELECT sum(n) FROM group_sizes h WHERE h.cohort = g.cohort AND grp IN ({groups}))::INTEGER AS n_features,
    n_train, n_test, n_pos FROM tiers g JOIN split_sizes s ON s.cohort = g.cohort""" for (table, step, name), groups in _SETS.items()
))


def _ablation(name: str, table: str, group: str, change: str | None, prefix: str = "") -> None:
    def build(t):
        s, store = _ablated(t)
        rows = mo.ablation_tables(store.results().filter("Model = 'LR'"), list(COHORTS)).filter(F.col("table") == table)
        kept = [F.col("Cohort").alias("cohort"), F.col("name").alias(group), *[F.col(c).alias(prefix + c) for c in ("AUROC", "AUPRC")], "n_features"]
        return rows.select(*kept, *([F.col("change").alias(change)] if change else []))

    build.__name__ = name
    keeping_query(build)


_ablation("ablation_loo", "leave_one_out", "removed_group", "AUROC_drop")
_ablation("ablation_incremental", "incremental", "added_group", "AUROC_gain", "cumulative_")
_ablation("ablation_single", "single_group", "group_alone", None)
_ablation("ablation_temporal", "temporal_validity", "model", "AUROC_cost")


@query
def row_gain(t):
    """How far AUROC rises from one seed to the next within a cell of the result table."""
    keys = ["Model", "Cohort", "Condition", "Variant"]
    return mo.row_gain(m.result_rows(*t.at), keys, ["Seed"], "AUROC", "gain").select(*keys, "Seed", "gain")


ORACLE["row_gain"] = oracle.sql("""SELECT Model, Cohort, Condition, Variant, Seed, round(AUROC - lag(AUROC) OVER (PARTITION BY Model, Cohort, Condition, Variant ORDER BY Seed), 4) AS gain FROM results""")
