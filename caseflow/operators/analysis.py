"""Error analysis of tagged rows, and result tables over model runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.metrics import TAGS
from caseflow.operators.split import require_one_split

CELL = ["Variant", "Cohort", "Condition"]
DEEP = ("RNN", "LSTM", "GRU", "BiLSTM", "BiGRU", "CNN", "CNN-k23", "CNN-LSTM")
CLASSICAL = ("LR", "RF", "GB", "KNN")
TABULAR, BAG, PLAIN = "With Process", "With BoW", "No Process"
SEQUENCE, COMBINED = "Sequence Only", "Sequence + Tabular"
# Fixed value: the two-sided 95 % t quantile at 4 degrees of freedom (five paired seeds).
T_95 = 2.776
RELIABLE_FROM = 20


# --- error analysis ---------------------------------------------------------------------------------


def group_means(tagged: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """(feature, TP, FN, FP, TN): mean of every numeric feature per error class, from one pass."""
    means = tagged.groupBy(*keys, "tag").agg(*[F.avg(f).alias(f) for f in features])
    tall = means.unpivot([*keys, "tag"], features, "feature", "mean")
    return tall.groupBy(*keys, "feature").agg(
        *[F.round(F.max(F.when(F.col("tag") == t, F.col("mean"))), 6).alias(t) for t in TAGS]
    )


def fn_vs_tp(tagged: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """Missed against found positives: means, difference and relative difference per feature."""
    means = group_means(tagged, features, keys)
    fn, tp = F.col("FN"), F.col("TP")
    base = F.when(F.abs(tp) > 1e-9, F.abs(tp)).otherwise(1.0)
    return means.select(
        *keys,
        "feature",
        F.round(fn, 3).alias("FN_mean"),
        F.round(tp, 3).alias("TP_mean"),
        F.round(fn - tp, 3).alias("abs_diff"),
        F.round(100 * (fn - tp) / base, 1).alias("rel_diff_pct"),
    )


def largest_first(contrast: DataFrame, k: int | None = None) -> DataFrame:
    ordered = contrast.orderBy(F.abs("abs_diff").desc(), "feature")
    return ordered if k is None else ordered.limit(k)


def miss_rates(tagged: DataFrame, categories: list[str], keys: list[str] = []) -> DataFrame:
    """Share of missed rows among the positives of every category value."""
    positives = tagged.filter(F.col("label") == 1).select(*keys, "tag", *[F.col(c).cast("string") for c in categories])
    return (
        positives.unpivot([*keys, "tag"], categories, "feature", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(
            F.round(F.avg((F.col("tag") == "FN").cast("double")), 6).alias("miss_rate"),
            F.count(F.lit(1)).alias("n_positives"),
        )
        .withColumn("reliable", F.col("n_positives") >= RELIABLE_FROM)
    )


# --- result tables ----------------------------------------------------------------------------------


def union_results(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def result_summary(
    results: DataFrame, metrics: tuple[str, ...] = ("AUROC", "AUPRC", "F1"), keys: tuple[str, ...] = ("Model", "Cohort", "Condition", "Variant")
) -> DataFrame:
    """Mean, sample deviation and count of each metric per cell, 4 decimals."""
    present = [k for k in keys if k in results.columns]
    columns = []
    for m in metrics:
        columns += [
            F.round(F.avg(m), 4).alias(f"{m}_mean"),
            F.round(F.stddev_samp(m), 4).alias(f"{m}_std"),
            F.count(m).alias(f"{m}_count"),
        ]
    return results.groupBy(*present).agg(*columns)


def collect_results(frames: list[DataFrame], metrics: tuple[str, ...] = ("AUROC", "AUPRC", "F1")) -> DataFrame:
    """Runs of any layout put together by column name and summarised, once all cells are of one partition each."""
    return result_summary(require_one_split(union_results(frames)), metrics)


def run_inventory(results: DataFrame, deep: tuple[str, ...] = DEEP) -> DataFrame:
    family = F.when(F.col("Model").isin(*deep), "deep").otherwise("classical")
    return results.groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_distinct("Seed").alias("n_seeds"),
        F.round(F.sum("Train_Time_s") / 3600, 4).alias("train_hours"),
    )


def prevalence(labels: DataFrame, variants: dict[str, str], keys: list[str] = ["cohort"]) -> DataFrame:
    """(keys, variant, n, positives, rate) for label columns side by side: {variant name: column}."""
    one = labels.select(*keys, *[F.col(c).cast("double").alias(v) for v, c in variants.items()])
    tall = one.unpivot(keys, list(variants), "variant", "label")
    return (
        tall.filter(F.col("label").isNotNull())
        .groupBy(*keys, "variant")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("label").cast("bigint").alias("positives"),
            F.round(F.avg("label"), 4).alias("rate"),
        )
    )


def _mean(condition: Column, value: str = "AUROC") -> Column:
    return F.avg(F.when(condition, F.col(value)))


def replication_delta(results: DataFrame, published: DataFrame, condition: str = PLAIN, variants: tuple[str, ...] = ("lat", "old")) -> DataFrame:
    """Published value (Model, Cohort, AUROC) against own means per variant, with differences."""
    means = results.filter(F.col("Condition") == condition).groupBy("Model", "Cohort").agg(
        *[_mean(F.col("Variant") == v).alias(v) for v in variants]
    )
    joined = published.select("Model", "Cohort", F.col("AUROC").alias("published")).join(means, ["Model", "Cohort"])
    own = []
    for v in variants:
        own += [F.round(v, 4).alias(v), F.round(F.col(v) - F.col("published"), 4).alias(f"delta_{v}")]
    return joined.select("Model", "Cohort", "published", *own)


def model_by_condition(results: DataFrame, conditions: dict[str, str], variant: str = "lat") -> DataFrame:
    """Mean and deviation per model and cohort, one column pair per condition: {column name: condition}."""
    columns = []
    for name, condition in conditions.items():
        own = F.when(F.col("Condition") == condition, F.col("AUROC"))
        columns += [F.round(F.avg(own), 4).alias(f"{name}_mean"), F.round(F.stddev_samp(own), 4).alias(f"{name}_std")]
    return results.filter(F.col("Variant") == variant).groupBy("Cohort", "Model").agg(*columns)


def classical_vs_deep(results: DataFrame, deep: tuple[str, ...] = DEEP, models: tuple[str, ...] = ("GB", "RF", "MLP")) -> DataFrame:
    """Classical means against the best and the range of the deep models per variant and cohort."""
    tabular = results.filter(F.col("Condition") == TABULAR).groupBy("Variant", "Cohort").agg(
        *[_mean(F.col("Model") == m).alias(m) for m in models]
    )
    means = (
        results.filter(F.col("Model").isin(*deep) & (F.col("Condition") == COMBINED))
        .groupBy("Variant", "Cohort", "Model")
        .agg(F.avg("AUROC").alias("mean"))
    )
    # Of equal means the alphabetically first model is named.
    best = means.groupBy("Variant", "Cohort").agg(
        F.min_by("Model", F.struct(-F.col("mean"), "Model")).alias("best_deep"),
        F.max("mean").alias("deep_max"),
        F.min("mean").alias("deep_min"),
    )
    numbers = [F.round(c, 4).alias(c) for c in (*models, "deep_min", "deep_max")]
    gap = F.round(F.col(models[0]) - F.col("deep_max"), 4).alias("gap")
    return tabular.join(best, ["Variant", "Cohort"]).select("Variant", "Cohort", "best_deep", *numbers, gap)


def seed_spread(results: DataFrame, models: tuple[str, ...] = DEEP) -> DataFrame:
    """Spread between architectures against seed noise: below twice the mean deviation they cannot be told apart."""
    cells = results.filter(F.col("Model").isin(*models)).groupBy(*CELL, "Model").agg(
        F.avg("AUROC").alias("mean"), F.stddev_samp("AUROC").alias("sd")
    )
    table = cells.groupBy(*CELL).agg((F.max("mean") - F.min("mean")).alias("spread"), F.avg("sd").alias("noise"))
    verdict = F.when(F.col("spread") < 2 * F.col("noise"), "indistinguishable").otherwise("detectable")
    return table.select(
        *CELL, F.round("spread", 4).alias("spread"), F.round("noise", 4).alias("mean_seed_sd"), verdict.alias("verdict")
    )


def feature_gain(results: DataFrame, more: str = TABULAR, less: str = PLAIN, models: tuple[str, ...] = CLASSICAL, keys: tuple[str, ...] = ("Variant", "Cohort")) -> DataFrame:
    """Gain in mean AUROC from one condition to another, per model in columns, and the largest."""
    gains = {
        m: _mean((F.col("Model") == m) & (F.col("Condition") == more))
        - _mean((F.col("Model") == m) & (F.col("Condition") == less))
        for m in models
    }
    columns = [F.round(g, 4).alias(f"gain_{m}") for m, g in gains.items()]
    largest = F.greatest(*gains.values()) if len(models) > 1 else next(iter(gains.values()))
    return results.groupBy(*keys).agg(*columns, F.round(largest, 4).alias("gain_max"))


def tabular_contribution(results: DataFrame, models: tuple[str, ...] = DEEP) -> DataFrame:
    """What tabular features add to the sequence models: mean and range over models."""
    per_model = results.filter(F.col("Model").isin(*models)).groupBy("Variant", "Cohort", "Model").agg(
        (_mean(F.col("Condition") == COMBINED) - _mean(F.col("Condition") == SEQUENCE)).alias("gain")
    )
    return per_model.groupBy("Variant", "Cohort").agg(
        F.round(F.avg("gain"), 4).alias("mean_gain"),
        F.round(F.min("gain"), 4).alias("min_gain"),
        F.round(F.max("gain"), 4).alias("max_gain"),
    )


def mean_rank(results: DataFrame, models: tuple[str, ...] | None = DEEP) -> DataFrame:
    """Mean, best and worst rank of each model over all cells; equal means share their average rank."""
    own = results if models is None else results.filter(F.col("Model").isin(*models))
    means = own.groupBy(*CELL, "Model").agg(F.avg("AUROC").alias("mean"))
    falling = Window.partitionBy(*CELL).orderBy(F.col("mean").desc())
    equal = Window.partitionBy(*CELL, "mean")
    ranked = means.withColumn("rank", F.rank().over(falling) + (F.count(F.lit(1)).over(equal) - 1) / 2)
    return ranked.groupBy("Model").agg(
        F.round(F.avg("rank"), 2).alias("mean_rank"),
        F.floor(F.min("rank")).cast("int").alias("best"),
        F.floor(F.max("rank")).cast("int").alias("worst"),
        F.count(F.lit(1)).alias("cells"),
    )


def paired_interval(results: DataFrame, model: str = "GB", deep: tuple[str, ...] = DEEP, t: float = T_95) -> DataFrame:
    """``model`` against the neural model with the best mean, paired by seed, with a 95 % t interval.

    The means are over all seeds of a model, the interval over the seeds both have.
    """
    own = results.filter((F.col("Model") == model) & (F.col("Condition") == TABULAR)).select(
        "Cohort", "Variant", "Seed", F.col("AUROC").alias("own"), F.avg("AUROC").over(Window.partitionBy("Cohort", "Variant")).alias("own_mean")
    )
    neural = results.filter(
        (F.col("Model").isin(*deep) & (F.col("Condition") == COMBINED))
        | ((F.col("Model") == "MLP") & (F.col("Condition") == TABULAR))
    ).select("Cohort", "Variant", "Seed", "Model", "AUROC")
    means = neural.groupBy("Cohort", "Variant", "Model").agg(F.avg("AUROC").alias("mean"))
    best = means.groupBy("Cohort", "Variant").agg(
        F.min_by("Model", F.struct(-F.col("mean"), "Model")).alias("best_neural"), F.max("mean").alias("neural")
    )
    chosen = neural.join(best, ["Cohort", "Variant"]).filter(F.col("Model") == F.col("best_neural"))
    difference = F.col("own") - F.col("AUROC")
    stats = (
        own.join(chosen, ["Cohort", "Variant", "Seed"])
        .groupBy("Cohort", "Variant", "best_neural", "neural")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("own_mean").alias("own"),
            F.avg(difference).alias("delta"),
            F.stddev_samp(difference).alias("sd"),
        )
    )
    half = F.lit(t) * F.col("sd") / F.sqrt("n")
    verdict = (
        F.when(F.col("delta") - half > 0, f"{model} beats").when(F.col("delta") + half < 0, "neural beats").otherwise("tie")
    )
    return stats.select(
        "Cohort",
        "Variant",
        "best_neural",
        "n",
        F.round("own", 4).alias("own_mean"),
        F.round("neural", 4).alias("neural_mean"),
        F.round("delta", 4).alias("delta"),
        F.round(F.col("delta") - half, 4).alias("ci_lo"),
        F.round(F.col("delta") + half, 4).alias("ci_hi"),
        verdict.alias("verdict"),
    )


# --- location ladder --------------------------------------------------------------------------------


def location_ladder(profile: DataFrame, rungs, level_names: dict[int, str]) -> DataFrame:
    """Place every profiled unit on the ladder: level, alternative level, dense rung, flags.

    Procedural units keep their level but have no rung.  Units outside every group are off the ladder.
    """
    unit = F.col("careunit")

    def pick(value) -> Column:
        chain = None
        for r in rungs:
            hit, v = unit.isin(*r.units), F.lit(value(r))
            chain = F.when(hit, v) if chain is None else chain.when(hit, v)
        return chain

    level, procedural = pick(lambda r: r.level), F.coalesce(pick(lambda r: r.procedural), F.lit(False))
    names = F.create_map(*[F.lit(x) for kv in level_names.items() for x in kv])
    placed = profile.withColumns(
        {
            "level": level,
            "level_name": F.element_at(names, level),
            "alt_level": pick(lambda r: r.alt_level).cast("int"),
            "is_procedural": procedural,
            "contestable": F.coalesce(pick(lambda r: r.contestable), F.lit(False)),
            "in_ladder": level.isNotNull() & ~procedural,
        }
    )
    used = placed.filter(F.col("level").isNotNull()).select("level").distinct()
    ranked = used.withColumn("rung", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("level")) - 1)
    return (
        placed.join(F.broadcast(ranked), "level", "left")  # one row per level in use
        .withColumn("ladder_rung", F.when(F.col("in_ladder"), F.col("rung")))
        .drop("rung")
        .select(*profile.columns, "level", "level_name", "alt_level", "ladder_rung", "in_ladder", "is_procedural", "contestable")
    )


def level_rollup(ladder: DataFrame) -> DataFrame:
    """Units, rows and admissions per level; units off the ladder form the NULL level."""
    return ladder.groupBy("level", "level_name").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_rows").alias("rows"), F.sum("n_admissions").alias("admissions")
    )
