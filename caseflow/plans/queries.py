"""One query per operator on the mapped tables: name -> function of (spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import locations as loc
from caseflow.operators import analysis as an
from caseflow.operators import encode as en
from caseflow.operators import events as ev
from caseflow.operators import features as ft
from caseflow.operators import labels as lb
from caseflow.operators import metrics as me
from caseflow.operators import ordered
from caseflow.operators import neighbours as nb
from caseflow.operators import prep as pr
from caseflow.operators import split as sp
from caseflow.plans import pipeline as pl
from caseflow.plans.oracle import HOT_VARIANTS
from caseflow.session import durable, shared_folder, tune
from caseflow.sources import mapping as m
from caseflow.sources.tables import read_result_files, schema_of, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BY = ["cohort"]
_HOURS = [f for f in ft.FEATURES if f.endswith("_hrs")]


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Optional values as text, empty where there is none, as the exported tables show them."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def query(build: Callable[[pl.Tables], DataFrame], keep: bool = False):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = pl.Tables(tune(spark), folder, keep)
        with ordered.known_hot(hadm_id=lambda: m.case_rows(*t.at), subject_id=lambda: pl.subject_rows(t)):
            return build(t)

    QUERIES[build.__name__] = run
    return build


def keeping_query(build: Callable[[pl.Tables], DataFrame]):
    """A query that reads the transfers on several ways; they are written down once."""
    return query(build, keep=True)


# --- logs -------------------------------------------------------------------------------------------


@query
def event_log(t):
    return ev.event_log(m.stays_of(*t.at), pl.moves(t), m.AREAS)


@query
def raw_event_log(t):
    return ev.raw_event_log(m.stays_of(*t.at), m.icustays(pl.moves(t)))


@query
def clean_log(t):
    return ev.export_log(pl.log(t))


@query
def cleaning_report(t):
    return ev.cleaning_report(ev.event_log(m.stays_of(*t.at), pl.moves(t), m.AREAS))


@query
def case_trace(t):
    return ev.case_trace(pl.log(t)).select("case_id", "pos", "activity", "event_time")


@query
def log_summary(t):
    return ev.log_summary(pl.log(t))


@query
def activity_freq(t):
    return ev.frequency(pl.log(t), "activity").orderBy(F.col("n").desc(), "activity")


@query
def transfer_freq(t):
    return ev.frequency(m.table(*t.at, "events"), "event_type").orderBy(F.col("n").desc(), "event_type")


@query
def first_activity(t):
    return ev.first_activity(pl.log(t))


@query
def directly_follows(t):
    edges = ev.directly_follows(pl.log(t))
    return edges.withColumns({c: F.round(c, 6) for c in ("mean_gap_hours", "median_gap_hours")})


@query
def process_ends(t):
    return ev.end_points(pl.log(t))


@query
def prediction_points(t):
    return pl.points(t)


@query
def prefix_events(t):
    return ev.prefix(pl.log(t), pl.points(t)).select("cohort", "case_id", "event_time", "activity")


# --- encodings --------------------------------------------------------------------------------------


@query
def sequences(t):
    encoded = en.encode_sequences(pl.log(t), pl.points(t), by=BY)
    seq = F.col("seq")
    return encoded.select(
        "cohort",
        "hadm_id",
        _text(seq).alias("seq"),
        _text(en.right_pad(seq, en.MAX_LEN)).alias("seq_right"),
        en.token_count(seq).alias("n_tokens"),
    )


def _text(tokens):
    return F.concat_ws(",", F.transform(tokens, lambda t: t.cast("string")))


@query
def sequence_profile(t):
    rows = en.sequence_profile(pl.log(t), pl.points(t), by=BY)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_len", "p95_len")})


@query
def vocabulary_gaps(t):
    known = {a: i for a, i in loc.ACTIVITY_IDS.items() if not a.endswith("Stepdown")}
    return en.unknown_activities(pl.log(t), known)


def _train(split):
    return split.filter("part = 'train'")


@keeping_query
def bow_vocab(t):
    counts = en.ngrams(pl.log(t), pl.points(t), by=BY)
    return en.fit_vocabulary(counts, _train(pl.split(t)), by=BY)


@keeping_query
def bow_features(t):
    counts = en.ngrams(pl.log(t), pl.points(t), by=BY)
    return en.bag_of_ngrams(counts, en.fit_vocabulary(counts, _train(pl.split(t)), by=BY), by=BY)


@keeping_query
def leak_audit(t):
    return en.leak_audit(pl.log(t), pl.points(t), _train(pl.split(t)), by=BY)


# --- labels -----------------------------------------------------------------------------------------


@query
def collapse(t):
    return lb.collapse(pl.usable_moves(t))


def _label(column: str):
    def build(t):
        return pl.frames(t).select("cohort", "hadm_id", F.col(column).alias("label"))

    build.__name__ = column.replace("left_", "label_")
    return query(build)


for _column in ("left_old", "left_lat", "left_corr", "left_corrpacu"):
    _label(_column)


@query
def label_route(t):
    frame = pl.frames(t).select(
        "cohort", "hadm_id", "t0", "first_in", "t_return", "via_critical", "via_intermediate", "via_pacu", "returned",
        "route", F.col("left_corr").alias("left_shift"),
    )
    return _shown(frame, "via_critical", "via_intermediate", "via_pacu")


@query
def label_collapse(t):
    return pl.flat_frames(t).select("cohort", "hadm_id", "route", F.col("left_corr").alias("label"))


@keeping_query
def label_swap(t):
    own = pl.frames(t).select("cohort", "hadm_id", F.col("left_old").alias("label"))
    return lb.swap_label(own, pl.flat_frames(t), "label", "left_corr", BY)


@query
def dwell_sweep(t):
    return lb.dwell_sweep(pl.usable_moves(t), m.COHORTS, m.TIERS)


@query
def restricted_cohort(t):
    return lb.cohort_restricted(pl.usable_moves(t), m.COHORTS)


@query
def structural_negatives(t):
    return lb.cohort_negatives(pl.usable_moves(t), m.COHORTS)


@keeping_query
def label_gate(t):
    """The stored label is the collapsed one here, so the gate has disagreements to count."""
    stored = pl.flat_frames(t).select("cohort", "hadm_id", "left_old")
    return lb.label_gate(stored, pl.frames(t), "left_old", BY)


@query
def label_transition(t):
    return lb.label_transition(pl.frames(t), "left_old", "left_lat", BY)


# --- features ---------------------------------------------------------------------------------------


@query
def demographics(t):
    return ft.demographics(
        m.admissions(*t.at), m.patients(*t.at), m.order_tier(*t.at), m.INSURANCE_KEPT, m.ETHNICITY_PATTERNS
    )


@query
def clinical_features(t):
    return ft.clinical_features(
        m.order_admissions(*t.at), m.labevents(*t.at), m.diagnoses(*t.at), m.prescriptions(*t.at),
        m.order_tier(*t.at),
    )


@query
def readmission_flag(t):
    return ft.readmission_flags(m.order_admissions(*t.at), emergency_types=m.EMERGENCY_TYPES)


@query
def uhr_count(t):
    return ft.uhr_features(m.order_admissions(*t.at), emergency_types=m.EMERGENCY_TYPES)


@query
def bmi_nearest(t):
    return ft.bmi_features(m.stays_of(*t.at), m.measurements(*t.at))


@query
def icd_chapters(t):
    return ft.with_counts(m.order_admissions(*t.at).select("hadm_id", "subject_id"), ft.chapter_counts(m.diagnoses(*t.at)))


@query
def charlson(t):
    return ft.with_counts(
        m.order_admissions(*t.at).select("hadm_id", "subject_id"),
        ft.charlson_scores(m.diagnoses(*t.at), m.charlson_map(t.spark)),
    )


@query
def chronic_count(t):
    return ft.with_counts(
        m.order_admissions(*t.at).select("hadm_id", "subject_id"),
        ft.chronic_counts(m.diagnoses(*t.at), m.chronic_codes(t.spark)),
    )


@query
def ed_flag(t):
    return ft.with_counts(
        m.stays_of(*t.at).select("hadm_id"), ft.ed_flags(pl.log(t), ("Admission to Medical Ward",))
    )


@query
def process_features(t):
    rows = ft.process_features(pl.moves(t), pl.points(t), m.TIER_A, m.TIER_B, BY)
    return rows.withColumns({h: F.round(h, 6) for h in _HOURS})


@query
def location_profile(t):
    return ev.location_profile(pl.moves(t))


@query
def location_ladder(t):
    ladder = an.location_ladder(ev.location_profile(pl.moves(t)), m.LADDER, loc.LEVEL_NAMES)
    return _shown(ladder, "level", "level_name", "alt_level", "ladder_rung")


@query
def level_rollup(t):
    ladder = an.location_ladder(ev.location_profile(pl.moves(t)), m.LADDER, loc.LEVEL_NAMES)
    return _shown(an.level_rollup(ladder), "level", "level_name")


@keeping_query
def feature_matrix(t):
    return pl.matrix(t).withColumns({h: F.round(h, 6) for h in _HOURS})


@query
def feature_matrix_inner(t):
    """The first layout: labels, demographics and clinical counts, inner joins."""
    base = durable(pl.labels(t).select("cohort", "hadm_id", "subject_id", F.col("left_old").alias("left_shift")))
    people = ft.demographics(m.admissions(*t.at), m.patients(*t.at), base, m.INSURANCE_KEPT, m.ETHNICITY_PATTERNS)
    clinical = ft.clinical_features(
        m.order_admissions(*t.at), m.labevents(*t.at), m.diagnoses(*t.at), m.prescriptions(*t.at), base
    )
    return ft.feature_matrix(base, [people, clinical], "inner")


@keeping_query
def matrix_null_audit(t):
    """NULLs appear where an admission is missing in a feature table; here, the admission location."""
    wide = pl.matrix(t).withColumn("admission_location", F.nullif("admission_location", F.lit(ft.NO_LOCATION)))
    return ft.null_audit(wide, BY)


@keeping_query
def cohort_exclusion(t):
    """Cases of the cohort that went on somewhere: the structural negatives are excluded."""
    negatives = lb.cohort_negatives(pl.usable_moves(t), m.COHORTS)
    return ft.exclude(pl.frames(t).select("cohort", "hadm_id", F.col("left_old").alias("label")), negatives, BY)


@keeping_query
def exclusion_report(t):
    negatives = lb.cohort_negatives(pl.usable_moves(t), m.COHORTS)
    return lb.exclusion_report(pl.frames(t), negatives, "left_lat", BY)


# --- splits and integrity ---------------------------------------------------------------------------


@keeping_query
def split_canonical(t):
    return pl.split(t)


@keeping_query
def split_restricted(t):
    onward = lb.cohort_restricted(pl.usable_moves(t), m.COHORTS).select("cohort", "hadm_id")
    cases = pl.labels(t).select("cohort", "hadm_id", "subject_id", "left_lat")
    return sp.grouped_split(cases.join(onward, ["cohort", "hadm_id"], "left_semi"), "left_lat", by=BY)


@query
def split_ungrouped(t):
    return sp.stratified_split(pl.labels(t), "left_lat", by=BY)


@keeping_query
def split_checks(t):
    """The ungrouped split against the cases of the canonical one: subjects overlap, a few cases are extra."""
    return sp.split_checks(sp.stratified_split(pl.labels(t), "left_lat", by=BY), pl.split(t), BY)


@keeping_query
def split_overlap(t):
    test = lambda s: s.filter("part = 'test'")
    return sp.set_overlap(
        test(pl.split(t)), test(sp.stratified_split(pl.labels(t), "left_lat", by=BY)), BY
    )


@keeping_query
def split_profile(t):
    return sp.split_profile(pl.split(t), "left_lat", BY)


@keeping_query
def split_digest(t):
    return sp.split_digest(pl.split(t), BY)


def _with_split_ids(t):
    """Result rows with a split id each: mixed in one cell, missing for some rows."""
    even = F.col("Seed") % 2 == 0
    mixed = (F.col("Cohort") == "SW") & (F.col("Variant") == "old") & even
    split_id = F.when(mixed, "b0").when(F.col("Seed") == 3, F.lit("")).otherwise("a0")
    return m.result_rows(*t.at).withColumn("split_id", split_id)


@query
def provenance_gate(t):
    return sp.provenance(_with_split_ids(t))


# --- model inputs -----------------------------------------------------------------------------------


@keeping_query
def class_weights(t):
    return pr.class_weights(_train(pl.split(t)), "left_lat", BY)


_SCALED = ["n_events", "mean_value", "max_value"]


@keeping_query
def standardize(t):
    """Case descriptors scaled with the statistics of the training part."""
    rows = pl.split(t).select("cohort", "hadm_id", "part").join(m.case_values(*t.at), "hadm_id")
    scaled = pr.standardize(rows.select("cohort", "hadm_id", "part", *_SCALED), F.col("part") == "train", _SCALED, BY)
    return scaled.withColumns({c: F.round(c, 6) for c in _SCALED})


@query
def one_hot(t):
    rows = m.patients(*t.at).select("subject_id", "gender").join(
        m.table(*t.at, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("insurance")),
        "subject_id",
    )
    rows = rows.withColumn("insurance", F.lower(F.substring("insurance", 1, 4)))
    return pr.one_hot(rows, pr.categories(rows, ["gender", "insurance"]))


@keeping_query
def trainer_inputs(t):
    # Each part is made for both cohorts at once and written down, so that no task holds the sorts of all of them.
    cases = durable(m.case_values(*t.at).join(pl.labels(t).select("cohort", "hadm_id", "left_lat"), "hadm_id"))
    encoded = durable(en.encode_sequences(pl.log(t), pl.points(t), by=BY))
    split = durable(pl.split(t))

    def inputs(cohort: str) -> DataFrame:
        own = lambda df: df.filter(F.col("cohort") == cohort).drop("cohort")
        rows = pr.tensors(own(encoded), own(cases), own(split), "left_lat", [*_SCALED, "last_unit"], ["last_unit"])
        return rows.select(
            F.lit(cohort).alias("cohort"), "hadm_id", "part", "label", _text(F.col("seq")).alias("seq"), F.col("tabular")[0].alias("x0"),
            F.size("tabular").alias("n_tabular"),
        )

    return reduce(lambda a, b: a.unionByName(b), [inputs(c) for c in m.COHORTS])


@query
def knn(t):
    rows = m.vectors(*t.at)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    found = nb.nearest(train, test)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neighbour_id")))
    ids = found.groupBy("query_id").agg(
        F.concat_ws(",", F.transform(ordered, lambda r: r["neighbour_id"].cast("string"))).alias("neighbours")
    )
    votes = nb.vote(found, train.select("id", "label")).withColumn("score", F.round("score", 6))
    return ids.join(votes, "query_id")


# --- metrics and error analysis ---------------------------------------------------------------------


@query
def metrics_threshold(t):
    return me.threshold_metrics(pl.scored(t), ["cohort"])


@query
def auroc(t):
    return me.rank_metrics(pl.scored(t), ["cohort"], 6).select("cohort", "n", "AUROC")


@query
def auprc(t):
    return me.rank_metrics(pl.scored(t), ["cohort"], 6).select("cohort", "n", "AUPRC")


@query
def threshold_sweep(t):
    rows = me.threshold_sweep(pl.scored(t), ["cohort"])
    return rows.withColumns({"F1": F.round("F1", 4), "threshold": F.round("threshold", 2)})


@query
def best_threshold(t):
    rows = me.best_threshold(pl.scored(t), ["cohort"])
    return rows.withColumns({"F1": F.round("F1", 6), "threshold": F.round("threshold", 2)})


@query
def confusion_tags(t):
    return pl.tagged(t).select("cohort", "hadm_id", "label", "score", "pred", "tag")


@query
def confusion_counts(t):
    return me.tag_counts(pl.tagged(t), ["cohort"])


@keeping_query
def error_meta(t):
    parts = pl.split(t).select("cohort", "hadm_id", "part")
    rows = me.tuned_report(pl.scored(t).join(parts, ["cohort", "hadm_id"]), BY)
    return rows.withColumn("threshold", F.round("threshold", 2))


@query
def group_means(t):
    return an.group_means(pl.tagged(t), _SCALED, ["cohort"])


@query
def fn_vs_tp(t):
    return an.largest_first(an.fn_vs_tp(pl.tagged(t), _SCALED, ["cohort"]))


@query
def miss_rate(t):
    return an.miss_rates(pl.tagged(t), ["first_unit", "last_unit"], ["cohort"])


# --- result tables ----------------------------------------------------------------------------------


@query
def result_summary(t):
    return an.result_summary(m.result_rows(*t.at))


RESULT_SCHEMA = schema_of(
    "Model STRING, Cohort STRING, Condition STRING, Seed INT, AUROC DOUBLE, AUPRC DOUBLE, F1 DOUBLE, Epochs INT, Train_Time_s DOUBLE, split_id STRING"
)


@query
def collect_results(t):
    """Results written in two layouts, read back by their headers, put together, gated and summarised."""
    rows = m.result_rows(*t.at).withColumns({"Epochs": F.lit(7), "split_id": F.concat_ws("-", "Cohort", "Variant")})
    layouts = {
        "ml": ("NOT deep", ["Model", "Cohort", "Condition", "Seed", "AUROC", "AUPRC", "F1", "Train_Time_s", "split_id"]),
        "rnn": ("deep", ["Model", "Condition", "Cohort", "Seed", "F1", "AUPRC", "AUROC", "Epochs", "Train_Time_s", "split_id"]),
    }
    folder = f"{shared_folder(t.spark)}/results-{uuid.uuid4().hex}"
    rows = durable(rows.withColumn("deep", F.col("Model").isin(*an.DEEP)))
    for name, (own, columns) in layouts.items():
        for variant in ("lat", "old"):
            part = rows.filter(own).filter(F.col("Variant") == variant).select(*columns)
            write_csv(part, f"{folder}/{name}_results_{variant}.csv")
    return an.collect_results([read_result_files(t.spark, f"{folder}/*.csv", RESULT_SCHEMA, ("lat", "old"))])


@query
def run_inventory(t):
    return an.run_inventory(m.result_rows(*t.at))


@keeping_query
def prevalence_table(t):
    keys = ["cohort", "hadm_id"]
    flat = pl.flat_frames(t).select(*keys, F.col("left_corr").alias("left_collapse"))
    onward = lb.cohort_restricted(pl.usable_moves(t), m.COHORTS).select(*keys, F.lit(1).alias("onward"))
    joined = pl.frames(t).join(flat, keys, "left").join(onward, keys, "left")
    variants = {v: f"left_{v}" for v in ("lat", "old", "corr", "corrpacu", "collapse", "restricted")}
    return an.prevalence(joined.withColumn("left_restricted", F.when(F.col("onward") == 1, F.col("left_lat"))), variants)


@query
def replication_delta(t):
    """The published numbers are stood in for by rounded overall means per model and cohort."""
    results = m.result_rows(*t.at)
    published = results.groupBy("Model", "Cohort").agg(F.round(F.avg("AUROC"), 2).alias("AUROC"))
    return an.replication_delta(results, published)


@query
def model_by_condition(t):
    named = {"plain": an.PLAIN, "process": an.TABULAR, "sequence": an.SEQUENCE, "combined": an.COMBINED}
    return an.model_by_condition(m.result_rows(*t.at), named)


@query
def classical_vs_deep(t):
    return an.classical_vs_deep(m.result_rows(*t.at))


@query
def seed_spread(t):
    return an.seed_spread(m.result_rows(*t.at))


@query
def feature_gain(t):
    return an.feature_gain(m.result_rows(*t.at), models=("GB", "RF", "MLP"))


@query
def tabular_contribution(t):
    return an.tabular_contribution(m.result_rows(*t.at))


@query
def mean_rank(t):
    return an.mean_rank(m.result_rows(*t.at), None)


@query
def paired_interval(t):
    return an.paired_interval(m.result_rows(*t.at))


# --- the plans of hot cases and subjects, on the whole tables ---------------------------------------

#: A limit under which a large part of the cases and subjects of any test table are hot.
FEW_ROWS = 4


def _hot_variant(name: str) -> None:
    plain = QUERIES[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        with ordered.hot_rows(FEW_ROWS):
            return plain(spark, folder)

    QUERIES[f"{name}_hot"] = run


for _name in HOT_VARIANTS:
    _hot_variant(_name)
