"""The operators put together on the mapped tables: log, points, labels, matrix, split, scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import events as ev
from caseflow.operators import features as ft
from caseflow.operators import labels as lb
from caseflow.operators import split as sp
from caseflow.operators.metrics import confusion_tags
from caseflow.session import durable
from caseflow.sources import mapping as m

LABEL = "left_shift"


@dataclass
class Tables:
    """A folder of mapped tables.

    ``keep`` writes the transfers down once.  Use it where a query reads them on several ways that
    prune them differently, since then every way would scan, exchange and sort the events again.
    ``share`` does the same with log, points and return frames; it is for the runs that need each of them several times.
    """

    spark: SparkSession
    folder: str
    keep: bool = False
    share: bool = False

    @property
    def at(self) -> tuple[SparkSession, str]:
        return self.spark, self.folder

    @cached_property
    def moves(self) -> DataFrame:
        rows = m.transfers(*self.at)
        return durable(rows) if self.keep else rows

    @cached_property
    def log(self) -> DataFrame:
        rows = ev.clean_log(ev.event_log(m.stays_of(*self.at), self.moves, m.AREAS))
        return durable(rows) if self.share else rows

    @cached_property
    def points(self) -> DataFrame:
        rows = ev.cohort_points(self.moves, m.COHORTS)
        return durable(rows) if self.share else rows

    @cached_property
    def frames(self) -> DataFrame:
        rows = lb.cohort_returns(ev.usable(self.moves), m.COHORTS, m.TIERS)
        return durable(rows) if self.share else rows


def moves(t: Tables) -> DataFrame:
    return t.moves


def subject_rows(t: Tables) -> DataFrame:
    """Every row that is ordered by subject somewhere: admissions and measurements."""
    return m.admissions(*t.at).select("subject_id").unionByName(m.measurements(*t.at).select("subject_id"))


def usable_moves(t: Tables) -> DataFrame:
    return ev.usable(moves(t))


def log(t: Tables) -> DataFrame:
    return t.log


def points(t: Tables) -> DataFrame:
    """(cohort, hadm_id, prediction_point)."""
    return t.points


def frames(t: Tables) -> DataFrame:
    """The return frame of every cohort."""
    return t.frames


def flat_frames(t: Tables) -> DataFrame:
    """The return frame on collapsed stays; its ``left_corr`` is the collapse label."""
    return lb.cohort_returns(lb.collapse(usable_moves(t)), m.COHORTS, m.TIERS)


def labels(t: Tables) -> DataFrame:
    """The return frame with the subject of each case (the mapping keeps it in the case id)."""
    return frames(t).withColumn("subject_id", F.floor(F.col("hadm_id") / 10))


def matrix(t: Tables) -> DataFrame:
    """The feature matrix of both cohorts: cohort, two ids, the primary label and 39 features.

    The label table is written down first, because the feature tables are cut to its cases.  Facts are thinned to them
    before they are exchanged; whatever looks along a subject keeps all rows of the subjects who have such a case.
    """
    base = durable(labels(t).select("cohort", "hadm_id", "subject_id", F.col("left_lat").alias(LABEL)))
    mine = ft.key_bits(base)
    stays = ft.thinned(m.order_admissions(*t.at), mine)
    theirs = ft.key_bits(stays, "subject_id")
    cases = ft.of_cohort(stays.select("hadm_id"), base)
    facts = [ft.lab_counts(ft.thinned(m.labevents(*t.at), mine)), ft.drug_counts(ft.thinned(m.prescriptions(*t.at), mine))]
    clinical = reduce(ft.with_counts, facts, cases)
    clinical = clinical.select("hadm_id", "pct_abnormal_labs", "num_medications", "polypharmacy")
    process = ft.process_features(moves(t), points(t), m.TIER_A, m.TIER_B, ["cohort"])
    parts = [
        ft.demographics(ft.thinned(m.admissions(*t.at), mine), m.patients(*t.at), base, m.INSURANCE_KEPT, m.ETHNICITY_PATTERNS),
        ft.uhr_features(ft.thinned(m.order_admissions(*t.at), theirs, "subject_id"), emergency_types=m.EMERGENCY_TYPES),
        ft.bmi_features(stays, ft.thinned(m.measurements(*t.at), theirs, "subject_id")).select("hadm_id", "bmi_category"),
        clinical,
        ft.admission_location(stays),
        process,
    ]
    counted = [
        ft.ed_flags(log(t), ("Admission to Medical Ward",)),
        ft.diagnosis_features(durable(ft.thinned(m.diagnoses(*t.at), mine)), m.charlson_map(t.spark), m.chronic_codes(t.spark)),
    ]
    wide = reduce(ft.with_counts, counted, ft.feature_matrix(base, parts, by=["cohort"]))
    return wide.select("cohort", "hadm_id", "subject_id", LABEL, *ft.FEATURES)


def split(t: Tables) -> DataFrame:
    """Grouped split of the cases that have at least one event before their prediction point.

    They are written down: subjects are counted, dealt and joined back to them."""
    keys = ["cohort", "hadm_id"]
    encoded = ev.prefix(log(t), points(t)).withColumnRenamed("case_id", "hadm_id").select(*keys)
    cases = durable(labels(t).select(*keys, "subject_id", "left_lat").join(encoded, keys, "left_semi"))
    return sp.grouped_split(cases, "left_lat", by=["cohort"])


def cohort_split(t: Tables, cohort: str) -> DataFrame:
    return durable(split(t).filter(F.col("cohort") == cohort).drop("cohort"))


def scored(t: Tables) -> DataFrame:
    """Scored rows of both cohorts with descriptors: cohort, hadm_id, label, score, ..."""
    cases = frames(t).select("cohort", "hadm_id", F.col("left_lat").alias("label"))
    return cases.join(m.case_values(*t.at), "hadm_id")


def tagged(t: Tables) -> DataFrame:
    return confusion_tags(scored(t), 0.55)
