"""Event logs: build, clean, trace, summarise, and cut at a prediction point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.locations import ANCHOR, HOSPITAL_AREAS, activity_name
from caseflow.functions.timing import hours_between
from caseflow.operators.ordered import attach, positions, quantile, shifted

ORDER = ["event_time", "tie"]
# Activity texts that mean "not recorded".
UNRECORDED = ("UNKNOWN", "Unknown", "")
# Column names of the exported log.
EXPORT_NAMES = {"case_id": "Case ID", "activity": "Activity", "event_time": "Timestamp"}
EXPORT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def usable(transfers: DataFrame) -> DataFrame:
    """Rows of a known case that are not discharge markers.  A NULL event type is kept."""
    return transfers.filter(F.col("hadm_id").isNotNull() & ~F.coalesce(F.col("eventtype") == "discharge", F.lit(False)))


def event_log(admissions: DataFrame, transfers: DataFrame, areas: dict[str, tuple[str, ...]] = HOSPITAL_AREAS) -> DataFrame:
    """(case_id, event_time, activity, tie): one anchor per admission, one named event per transfer.

    Pairs of unit and event type outside the mapping give a NULL activity; ``clean_log`` drops them.
    ``tie`` orders equal times: the anchor first, then by event id.
    """
    anchors = admissions.select(
        F.col("hadm_id").alias("case_id"),
        F.col("admittime").alias("event_time"),
        F.lit(ANCHOR).alias("activity"),
        F.lit(-1).cast("bigint").alias("tie"),
    )
    moves = transfers.filter(F.col("hadm_id").isNotNull() & (F.col("eventtype") != "discharge")).select(
        F.col("hadm_id").alias("case_id"),
        F.col("intime").alias("event_time"),
        activity_name("careunit", "eventtype", areas).alias("activity"),
        F.col("event_id").alias("tie"),
    )
    return anchors.unionByName(moves)


def raw_event_log(admissions: DataFrame, icustays: DataFrame) -> DataFrame:
    """Admission, discharge, ICU in and ICU out as events; each table is scanned once."""

    def two_events(table: DataFrame, start: str, end: str, start_name: str, end_name: str) -> DataFrame:
        pair = F.array(
            F.struct(F.col(start).alias("event_time"), F.lit(start_name).alias("activity")),
            F.struct(F.col(end).alias("event_time"), F.lit(end_name).alias("activity")),
        )
        return table.select(F.col("hadm_id").alias("case_id"), F.inline(pair))

    return two_events(admissions, "admittime", "dischtime", ANCHOR, "Hospital Discharge").unionByName(
        two_events(icustays, "intime", "outtime", "ICU Admission", "ICU Discharge")
    )


def clean_log(log: DataFrame, unrecorded: tuple[str, ...] = UNRECORDED) -> DataFrame:
    """Named events with a valid time, still typed.  Text times are parsed, unparseable ones dropped."""
    at = F.col("event_time")
    if dict(log.dtypes)["event_time"] == "string":
        at = F.try_to_timestamp(at).cast("timestamp_ntz")
    return (
        log.filter(F.col("activity").isNotNull() & ~F.col("activity").isin(*unrecorded))
        .withColumn("event_time", at)
        .filter(F.col("event_time").isNotNull())
    )


def cleaning_report(log: DataFrame, unrecorded: tuple[str, ...] = UNRECORDED) -> DataFrame:
    """How many events each cleaning rule drops."""
    at = F.col("event_time")
    valid = F.try_to_timestamp(at) if dict(log.dtypes)["event_time"] == "string" else at
    named = F.coalesce(~F.col("activity").isin(*unrecorded), F.lit(False))
    return log.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~named).alias("unnamed"),
        F.count_if(named & valid.isNull()).alias("bad_time"),
        F.count_if(named & valid.isNotNull()).alias("kept"),
    )


def export_log(log: DataFrame, sort: bool = True) -> DataFrame:
    """The log under its exchange names, times as text, sorted by case and time (a range sort)."""
    shown = log.select(
        *[
            (F.date_format(c, EXPORT_FORMAT) if c == "event_time" else F.col(c)).alias(name)
            for c, name in EXPORT_NAMES.items()
        ],
        "tie",
    )
    return (shown.orderBy("Case ID", "Timestamp", "tie") if sort else shown).drop("tie")


def case_trace(log: DataFrame, case: Column | None = None) -> DataFrame:
    """Events in order with their position in the case; ``case`` narrows it to some cases."""
    chosen = log if case is None else log.filter(case)
    return positions(chosen, ["case_id"], ORDER)


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("case_id").alias("n_cases"),
        F.count_distinct("activity").alias("n_activities"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, NULL included; order the result by count to show it."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_activity(log: DataFrame) -> DataFrame:
    """Which activity opens a case, and how often.  No sort: the earliest row is an aggregate."""
    first = log.groupBy("case_id").agg(F.min_by("activity", F.struct(*ORDER)).alias("activity"))
    return frequency(first, "activity")


def directly_follows(log: DataFrame) -> DataFrame:
    """Edges a -> b of the process map with counts, cases and the mean and median gap in hours."""
    linked = shifted(
        log, ["case_id"], ORDER, {"next_activity": (F.col("activity"), 1), "next_time": (F.col("event_time"), 1)}
    )
    edges = linked.filter(F.col("next_time").isNotNull()).select(
        "case_id",
        F.col("activity").alias("source"),
        F.col("next_activity").alias("target"),
        hours_between("event_time", "next_time").alias("gap_hours"),
    )
    counts = edges.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("case_id").alias("n_cases"),
        F.avg("gap_hours").alias("mean_gap_hours"),
    )
    medians = quantile(edges, ["source", "target"], "gap_hours", 0.5, "median_gap_hours")
    return attach(counts, medians, ["source", "target"])


def end_points(log: DataFrame) -> DataFrame:
    """Start and end activities of the process map with the number of cases."""
    ends = log.groupBy("case_id").agg(
        F.min_by("activity", F.struct(*ORDER)).alias("start"), F.max_by("activity", F.struct(*ORDER)).alias("end")
    )
    return (
        ends.select(F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("role", "activity"))
        .groupBy("role", "activity")
        .agg(F.count(F.lit(1)).alias("n_cases"))
    )


def prediction_points(transfers: DataFrame, tier: tuple[str, ...]) -> DataFrame:
    """End of the first stay in the tier, per case.  An open first stay gives a NULL point."""
    return (
        transfers.filter(F.col("careunit").isin(*tier))
        .groupBy("hadm_id")
        .agg(F.min_by("outtime", F.struct("intime", "event_id")).alias("prediction_point"))
    )


def cohort_points(transfers: DataFrame, cohorts: dict[str, tuple[str, ...]]) -> DataFrame:
    """(cohort, hadm_id, prediction_point) for several tiers from one pass."""
    first = F.struct("intime", "event_id")

    def point(cohort: str, tier: tuple[str, ...]) -> Column:
        inside = F.col("careunit").isin(*tier)
        # min_by skips rows whose ordering value is NULL, that is, rows outside the tier.
        return F.struct(
            F.lit(cohort).alias("cohort"),
            F.min_by("outtime", F.when(inside, first)).alias("prediction_point"),
            F.bool_or(inside).alias("in_cohort"),
        )

    per_case = transfers.groupBy("hadm_id").agg(F.array(*[point(c, t) for c, t in cohorts.items()]).alias("points"))
    return per_case.select("hadm_id", F.inline("points")).filter("in_cohort").drop("in_cohort")


def prefix(log: DataFrame, points: DataFrame, inclusive: bool = False) -> DataFrame:
    """Events strictly before the prediction point of their case (once per cohort if points name cohorts).

    ``inclusive`` keeps the event at the point as well; that leaks the outcome and exists only for the
    leak audit.
    """
    at, point = F.col("event_time"), F.col("prediction_point")
    joined = log.join(points.withColumnRenamed("hadm_id", "case_id"), "case_id")
    return joined.filter(at <= point if inclusive else at < point)


def location_profile(transfers: DataFrame) -> DataFrame:
    """Rows, admissions, exact median hours and share under four hours of every unit."""
    timed = transfers.select("hadm_id", "careunit", hours_between("intime", "outtime").alias("hours"))
    counts = timed.groupBy("careunit").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("hadm_id").alias("n_admissions"),
        F.round(100.0 * F.count_if(F.col("hours") < 4) / F.nullif(F.count("hours"), F.lit(0)), 2).alias("pct_under_4h"),
    )
    medians = quantile(timed, ["careunit"], "hours", 0.5, "median_hours")
    return attach(counts, medians.withColumn("median_hours", F.round("median_hours", 2)), ["careunit"])
