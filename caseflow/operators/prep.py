"""Model inputs: one-hot columns, standardisation, class weights, feature vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CATEGORIES = 1000


def categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per categorical column, from one pass over the whole cohort."""
    if not columns:
        return {}
    tall = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], columns, "column", "value")
    rows = tall.filter(F.col("value").isNotNull()).distinct().limit(MAX_CATEGORIES * len(columns) + 1).collect()
    found = {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}
    if len(rows) > MAX_CATEGORIES * len(columns):
        raise ValueError("too many category values for one-hot columns")
    return found


def one_hot(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """Replace each categorical column by one 0/1 column per value (none dropped)."""
    hot = [
        F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, vs in values.items()
        for v in vs
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *hot)


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations; a constant column is divided by 1."""

    mean: dict[str, float]
    sd: dict[str, float]

    def scaled(self, column: str) -> Column:
        return (F.col(f"`{column}`") - F.lit(self.mean[column])) / F.lit(self.sd[column])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.mean})


def fit_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    """Fit on training rows only: one aggregate row reaches the driver."""
    stats = train.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    mean = {c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    sd = {c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(columns)}
    return Scaler(mean, sd)


def standardize(df: DataFrame, is_train: Column, columns: list[str], by: list[str]) -> DataFrame:
    """Scale per group (such as a cohort) with the statistics of the group's training rows."""
    stats = df.filter(is_train).groupBy(*by).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns],
    )
    sd = lambda c: F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
    joined = df.join(stats, by).withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / sd(c) for c in columns})
    return joined.select(*df.columns)


def class_weights(df: DataFrame, label: str, keys: list[str] = []) -> DataFrame:
    """Counts, balanced weights n / (2 n_c), and neg / max(pos, 1)."""
    pos, neg, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0), F.count(label)
    return df.groupBy(*keys).agg(
        n.alias("n"),
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        F.round(n / F.nullif(2 * pos, F.lit(0)), 6).alias("weight_pos"),
        F.round(n / F.nullif(2 * neg, F.lit(0)), 6).alias("weight_neg"),
        F.round(neg / F.greatest(pos, F.lit(1)), 6).alias("pos_weight"),
    )


def tensors(sequences: DataFrame, matrix: DataFrame, split: DataFrame, label: str, columns: list[str], categorical: list[str]) -> DataFrame:
    """Inputs for trainers outside Spark: id, part, label, padded sequence and scaled tabular array."""
    chosen = matrix.select("hadm_id", F.col(label).cast("int").alias("label"), *columns)
    hot = one_hot(chosen, categories(chosen, [c for c in columns if c in categorical]))
    names = [c for c in hot.columns if c not in ("hadm_id", "label")]
    joined = hot.join(split.select("hadm_id", "part"), "hadm_id").join(sequences, "hadm_id")
    scaler = fit_scaler(joined.filter("part = 'train'"), names)
    tabular = F.array(*[F.round(F.coalesce(scaler.scaled(c), F.lit(0.0)), 6) for c in names]).alias("tabular")
    return joined.select("hadm_id", "part", "label", "seq", tabular)
