"""Classifier metrics as aggregates over scored rows: (keys..., label 0/1, score).

Rank metrics first reduce the rows to counts per distinct score; only those counts are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.operators.ordered import running

# The grid of decision thresholds, 0.05 to 0.95 in steps of 0.01.
GRID_START, GRID_STEP, GRID_SIZE = 0.05, 0.01, 91
TAGS = ("TP", "FN", "FP", "TN")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "Accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "Precision": _ratio(tp, tp + fp),
        "Recall": _ratio(tp, tp + fn),
        "F1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(scored: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    counts = {"TP": hit & positive, "FP": hit & ~positive, "FN": ~hit & positive, "TN": ~hit & ~positive}
    table = scored.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    shares = _from_counts(*[F.col(n) for n in counts])
    return table.withColumns({n: F.round(c, 4) for n, c in shares.items()})


def score_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score: positives, negatives and both counted from the highest score down."""
    counts = scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    falling = counts.withColumn("__falling", -F.col("score"))
    return running(
        falling, keys, ["__falling"], {"cum_pos": ("sum", F.col("pos")), "cum_neg": ("sum", F.col("neg"))}
    ).drop("__falling")


def rank_metrics(scored: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """AUROC (ties count half) and AUPRC (step form of average precision)."""
    pos, neg, cum_pos, cum_neg = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    n_pos, n_neg = F.sum(pos), F.sum(neg)
    return score_curve(scored, keys).groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.round(F.sum(neg * (cum_pos - pos / 2)) / F.nullif(n_pos * n_neg, F.lit(0.0)), digits).alias("AUROC"),
        F.round(F.sum(pos * cum_pos / (cum_pos + cum_neg)) / F.nullif(n_pos, F.lit(0.0)), digits).alias("AUPRC"),
    )


def threshold_sweep(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 at every grid threshold (a row is positive from score >= threshold)."""
    grid = F.array(*[F.lit(GRID_START + GRID_STEP * i) for i in range(GRID_SIZE)])
    passed = F.size(F.filter(grid, lambda t: t <= F.col("score")))
    by_score = scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    # At most GRID_SIZE + 1 buckets per key; each is handed to the thresholds it passes.
    buckets = by_score.groupBy(*keys, passed.alias("passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))).alias("step")
    above = F.col("step") < F.col("passed")
    counts = (
        buckets.select("*", steps)
        .groupBy(*keys, "step")
        .agg(
            *[
                F.sum(F.when(condition, F.col(side)).otherwise(0)).alias(name)
                for name, condition, side in (
                    ("TP", above, "pos"), ("FP", above, "neg"), ("FN", ~above, "pos"), ("TN", ~above, "neg"),
                )
            ]
        )
    )
    shares = _from_counts(*[F.col(n) for n in ("TP", "FP", "FN", "TN")])
    return counts.withColumn("threshold", F.lit(GRID_START) + F.lit(GRID_STEP) * F.col("step")).withColumns(
        {n: F.round(shares[n], 4) for n in ("Precision", "Recall")} | {"F1": shares["F1"]}
    )


def best_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the highest F1; the lowest of equals."""
    return (
        threshold_sweep(scored, keys)
        .groupBy(*keys)
        .agg(
            F.max_by("threshold", F.struct("F1", -F.col("step"))).alias("threshold"),
            F.max("F1").alias("F1"),
        )
    )


def confusion_tags(scored: DataFrame, threshold: float | Column) -> DataFrame:
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    tag = F.when(positive, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))
    return scored.withColumns({"pred": hit.cast("int"), "tag": tag})


def tag_counts(tagged: DataFrame, keys: list[str]) -> DataFrame:
    return tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("tag") == t).alias(t) for t in TAGS]
    )


def tuned_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Tune the threshold on the rows of part 'val', then report the rows of part 'test'.

    AUROC, threshold, number of rows and confusion counts, one row per key.
    """
    tuned = best_threshold(scored.filter("part = 'val'"), keys).select(*keys, "threshold")
    test = scored.filter("part = 'test'")
    tagged = confusion_tags(test.join(tuned, keys), F.col("threshold"))
    counts = tag_counts(tagged, [*keys, "threshold"])
    return rank_metrics(test, keys).select(*keys, "AUROC").join(counts, keys)
