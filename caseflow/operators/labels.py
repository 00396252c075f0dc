"""Outcome labels: does a case come back to a tier after its first stay there ended?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.locations import Tiers, in_units
from caseflow.functions.timing import hours_between
from caseflow.operators.ordered import group_values, islands, split_hot

ORDER = ["intime", "event_id"]


def collapse(transfers: DataFrame, keys: list[str] = ["hadm_id"]) -> DataFrame:
    """Merge consecutive rows of a case in the same unit: earliest start, latest end, first event id."""
    runs = islands(transfers.select(*keys, "event_id", "careunit", "intime", "outtime"), keys, ORDER, "careunit")
    return (
        runs.groupBy(*keys, "island")
        .agg(
            F.min("careunit").alias("careunit"),
            F.min_by("event_id", F.struct(*ORDER)).alias("event_id"),
            F.min("intime").alias("intime"),
            F.max("outtime").alias("outtime"),
        )
        .drop("island")
    )


def dwell(transfers: DataFrame, hours: float) -> DataFrame:
    """Rows that last at least ``hours``; open rows are dropped unless no minimum is asked for."""
    return transfers if hours <= 0 else transfers.filter(hours_between("intime", "outtime") >= hours)


def _gap_flags(transfers: DataFrame, cohorts: dict[str, tuple[str, ...]], tiers: Tiers, keys: list[str], hot: bool) -> DataFrame:
    """t0, first start, return time and what the gap contains, per cohort and case, in one pass for all cohorts."""
    start, unit = F.col("intime"), F.col("careunit")
    inside = {c: in_units(unit, tier) for c, tier in cohorts.items()}
    t0, back = (lambda c: F.col(f"__t0_{c}")), (lambda c: F.col(f"__back_{c}"))
    rows = transfers.select(*keys, "careunit", "intime", "outtime")
    rows = group_values(rows, keys, {f"__t0_{c}": F.min(F.when(i, F.col("outtime"))) for c, i in inside.items()}, hot)
    rows = group_values(
        rows, keys, {f"__back_{c}": F.min(F.when(i & (start > t0(c)), start)) for c, i in inside.items()}, hot
    )

    def seen(cohort: str, condition) -> Column:
        return F.bool_or(F.when((start >= t0(cohort)) & (start < back(cohort)), condition))

    frames = [
        F.struct(
            F.lit(c).alias("cohort"),
            F.min(t0(c)).alias("t0"),
            F.min(F.when(i, start)).alias("first_in"),
            F.min(back(c)).alias("t_return"),
            seen(c, ~i).alias("outside"),
            seen(c, in_units(unit, tiers.critical)).alias("via_critical"),
            seen(c, in_units(unit, tiers.intermediate)).alias("via_intermediate"),
            seen(c, in_units(unit, tiers.pacu)).alias("via_pacu"),
            F.bool_or(i).alias("in_cohort"),
        )
        for c, i in inside.items()
    ]
    per_case = rows.groupBy(*keys).agg(F.array(*frames).alias("frames"))
    return per_case.select(*keys, F.inline("frames")).filter("in_cohort").drop("in_cohort")


def cohort_returns(
    transfers: DataFrame, cohorts: dict[str, tuple[str, ...]], tiers: Tiers = Tiers(), keys: list[str] = ["hadm_id"]
) -> DataFrame:
    """One row per cohort and case with the return, what happened in between, and every label variant.

    t0        earliest end of a row in the cohort's tier
    t_return  earliest start of a tier row strictly after t0
    gap rows  all rows of the case with t0 <= start < t_return

    left_old       there is a return
    left_lat       ... and some gap row lies outside the tier (a purely lateral move is no return)
    left_corr      ... and the gap shows neither critical, intermediate nor PACU units
    left_corrpacu  as left_corr, but a return by PACU also counts
    """
    cold, hot, _ = split_hot(transfers, keys)
    frame = _gap_flags(cold, cohorts, tiers, keys, False)
    if hot is not None:
        frame = frame.unionByName(_gap_flags(hot, cohorts, tiers, keys, True))
    returned = F.col("t_return").isNotNull()
    seen = lambda name: F.coalesce(F.col(name), F.lit(False))
    route = (
        F.when(~returned, "no_return")
        .when(seen("via_critical"), "via_critical")
        .when(seen("via_intermediate"), "via_intermediate")
        .when(seen("via_pacu"), "via_pacu")
        .otherwise("via_ward")
    )
    return frame.withColumn("route", route).withColumns(
        {
            "returned": returned.cast("int"),
            "left_old": returned.cast("int"),
            "left_lat": (returned & seen("outside")).cast("int"),
            "left_corr": (F.col("route") == "via_ward").cast("int"),
            "left_corrpacu": F.col("route").isin("via_ward", "via_pacu").cast("int"),
        }
    )


def returns(transfers: DataFrame, tier: tuple[str, ...], tiers: Tiers = Tiers(), keys: list[str] = ["hadm_id"]) -> DataFrame:
    """``cohort_returns`` for a single tier, without the cohort column."""
    return cohort_returns(transfers, {"": tier}, tiers, keys).drop("cohort")


def dwell_sweep(
    transfers: DataFrame,
    cohorts: dict[str, tuple[str, ...]],
    tiers: Tiers = Tiers(),
    hours: tuple[float, ...] = (0, 1, 4, 12, 24),
) -> DataFrame:
    """Route counts and label rate per cohort for several minimum stays, all in one job.

    Short rows are dropped after a first collapse, then what became adjacent is collapsed again.
    """
    once = collapse(transfers)
    grid = once.withColumn("min_dwell_h", F.explode(F.array(*[F.lit(float(h)) for h in hours])))
    long_enough = grid.filter(
        (F.col("min_dwell_h") <= 0) | (hours_between("intime", "outtime") >= F.col("min_dwell_h"))
    )
    keys = ["hadm_id", "min_dwell_h"]
    frame = cohort_returns(collapse(long_enough, keys), cohorts, tiers, keys)
    return route_table(frame, ["cohort", "min_dwell_h"])


def route_table(frame: DataFrame, keys: list[str]) -> DataFrame:
    via = lambda name: F.count_if(F.col("route") == name).alias(name)
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum("returned").alias("returned"),
        *[via(r) for r in ("via_critical", "via_intermediate", "via_pacu", "via_ward")],
        F.round(100 * F.avg("left_corr"), 3).alias("rate_pct"),
    )


def cohort_onward(transfers: DataFrame, tiers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(cohort, hadm_id, t0, onward) of every case of each tier: did it go on outside the tier after its first block there?

    Cases that did not can never come back; they are the structural negatives.  All tiers are looked
    at in one scan, one exchange on the case and one sort.
    """
    keys = ["hadm_id", "cohort"]
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("cohort"), in_units("careunit", tier).alias("in_tier")) for name, tier in tiers.items()]))
    rows = transfers.withColumn("__c", named).select(*transfers.columns, "__c.cohort", "__c.in_tier")
    blocks = (
        islands(rows, keys, ORDER, "in_tier")
        .groupBy(*keys, "island")
        .agg(
            F.bool_or("in_tier").alias("in_tier"),
            F.min("intime").alias("intime"),
            F.max("outtime").alias("outtime"),
        )
    )

    def flag(rows: DataFrame, hot: bool) -> DataFrame:
        first_end = {"t0": F.min(F.when(F.col("in_tier"), F.col("outtime")))}
        went_on = ~F.col("in_tier") & (F.col("intime") >= F.col("t0"))
        return (
            group_values(rows, keys, first_end, hot)
            .groupBy(*keys)
            .agg(
                F.min("t0").alias("t0"),
                F.coalesce(F.bool_or(went_on), F.lit(False)).cast("int").alias("onward"),
                F.bool_or("in_tier").alias("in_cohort"),
            )
            .filter("in_cohort")
            .select("cohort", "hadm_id", "t0", "onward")
        )

    cold, hot, _ = split_hot(blocks, keys)
    cases = flag(cold, False)
    return cases if hot is None else cases.unionByName(flag(hot, True))


def onward_cases(transfers: DataFrame, tier: tuple[str, ...]) -> DataFrame:
    """``cohort_onward`` of one tier, without the cohort."""
    return cohort_onward(transfers, {"": tier}).drop("cohort")


def cohort_restricted(transfers: DataFrame, tiers: dict[str, tuple[str, ...]]) -> DataFrame:
    return cohort_onward(transfers, tiers).filter("onward = 1").select("cohort", "hadm_id", "t0")


def cohort_negatives(transfers: DataFrame, tiers: dict[str, tuple[str, ...]]) -> DataFrame:
    return cohort_onward(transfers, tiers).filter("onward = 0").select("cohort", "hadm_id")


def restricted(transfers: DataFrame, tier: tuple[str, ...]) -> DataFrame:
    return onward_cases(transfers, tier).filter("onward = 1").select("hadm_id", "t0")


def structural_negatives(transfers: DataFrame, tier: tuple[str, ...]) -> DataFrame:
    return onward_cases(transfers, tier).filter("onward = 0").select("hadm_id")


def label_gate(stored: DataFrame, recomputed: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Cases both tables know, and how many of them disagree.  The gate is passed at zero."""
    right = recomputed.select(*by, "hadm_id", F.col(label).alias("__new"))
    return stored.join(right, [*by, "hadm_id"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_common"),
        F.count_if(~F.col(label).eqNullSafe(F.col("__new"))).alias("n_mismatch"),
    )


def label_transition(frame: DataFrame, old: str, new: str, keys: list[str] = []) -> DataFrame:
    """How many cases each pair of old and new label value has."""
    return frame.groupBy(*keys, F.col(old).alias("old_label"), F.col(new).alias("new_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def exclusion_report(frame: DataFrame, excluded: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    """Cases and positive rate before and after taking the excluded cases out."""
    out = excluded.select(*by, "hadm_id").distinct().withColumn("__out", F.lit(1))
    kept = F.col("__out").isNull()
    return frame.join(out, [*by, "hadm_id"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.round(F.avg(label), 4).alias("rate_before"),
        F.count_if(~kept).alias("n_excluded"),
        F.count_if(kept).alias("n_after"),
        F.round(F.avg(F.when(kept, F.col(label))), 4).alias("rate_after"),
    )


def swap_label(matrix: DataFrame, labels: DataFrame, label: str, new: str, by: list[str] = []) -> DataFrame:
    """Replace the label of a matrix by another variant; cases the variant lacks become 0."""
    fresh = labels.select(*by, "hadm_id", F.col(new).alias("__new"))
    joined = matrix.drop(label).join(fresh, [*by, "hadm_id"], "left").withColumn(label, F.coalesce("__new", F.lit(0)))
    return joined.select(*matrix.columns)
