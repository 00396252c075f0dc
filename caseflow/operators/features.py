"""Per-case features: demographics, clinical counts, code counts, history, process, and the matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import recode
from caseflow.functions.locations import in_units
from caseflow.functions.timing import MICROS_PER_DAY, epoch_micros, hours_between, micros_between
from caseflow.operators.ordered import attach, running, shifted, split_hot
from caseflow.session import durable

KEY = "hadm_id"
# The BMI measurement name and its accepted range.
BMI_NAME, BMI_RANGE = "BMI (kg/m2)", (10, 100)
POLYPHARMACY_DRUGS = 5
NO_LOCATION = "INFORMATION NOT AVAILABLE"
#: log2 of the bits that thin rows before they are exchanged: 4 MiB, half a million rows of 64 bits.
FILTER_BITS = 25

# The features by group, in reporting order.
GROUPS = {
    "demographics": ("age_band", "gender", "insurance", "ethnicity", "marital_status"),
    "clinical_core": (
        "uhr_count", "ed_admission", "admission_type", "bmi_category", "pct_abnormal_labs", "num_medications",
        "polypharmacy",
    ),
    "icd_chapters": recode.CHAPTER_COLUMNS,
    "charlson": ("charlson_score",),
    "chronic_count": ("chronic_disease_count",),
    "process": (
        "admission_location", "accumulated_duration_hrs", "icu_duration_hrs", "sw_duration_hrs", "num_icu_stays",
        "num_sw_stays", "total_events",
    ),
}
CATEGORICAL = (
    "age_band", "gender", "insurance", "ethnicity", "marital_status", "admission_type", "bmi_category",
    "admission_location",
)
FEATURES = tuple(f for group in GROUPS.values() for f in group)
CONDITIONS = ("No Process", "With Process", "With BoW")


def tier_cases(transfers: DataFrame, tier: tuple[str, ...]) -> DataFrame:
    return transfers.filter(F.col("careunit").isin(*tier)).select(KEY)


def of_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of cases in the cohort.

    The cohort may list a case many times; the repeats are combined before they are exchanged.
    """
    return df.join(cohort.select(KEY).distinct(), KEY, "left_semi")


def key_bits(ids: DataFrame, key: str = KEY) -> DataFrame:
    """A bit table of the ids, written down: at most ``2**FILTER_BITS`` bits in rows of 64, however many ids there are."""
    words = ids.select(_word(key).alias("__word"), _bit(key).alias("__bit")).groupBy("__word")
    return durable(words.agg(F.bit_or("__bit").alias("__bits")))


def thinned(df: DataFrame, bits: DataFrame, key: str = KEY) -> DataFrame:
    """All rows whose key is in the bit table (NULL is a key like others), and some whose key is not.

    Rows are dropped where they are read, before any exchange; what follows must still join exactly."""
    marked = F.col("__bits").bitwiseAND(_bit(key)) != 0
    return df.join(F.broadcast(bits), (_word(key) == F.col("__word")) & marked, "left_semi")


def _word(key: str) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64(cast(`{key}` AS BIGINT)), {64 - FILTER_BITS + 6})")


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(xxhash64(cast(`{key}` AS BIGINT)) & 63 AS INT))")


def with_counts(cases: DataFrame, counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Left join counts onto cases; a case without any gets zeros."""
    keys = [KEY, *by]
    names = [c for c in counts.columns if c not in keys]
    joined = cases.join(counts, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})


def demographics(
    admissions: DataFrame,
    patients: DataFrame,
    cohort: DataFrame,
    insurance_kept: tuple[str, ...] = recode.INSURANCE_KEPT,
    ethnicity_patterns: dict[str, tuple[str, ...]] = recode.ETHNICITY_PATTERNS,
) -> DataFrame:
    rows = of_cohort(admissions, cohort).join(patients, "subject_id")
    return rows.select(
        KEY,
        "subject_id",
        recode.age_band(F.col("anchor_age")).alias("age_band"),
        "gender",
        recode.insurance_group(F.col("insurance"), insurance_kept).alias("insurance"),
        recode.ethnicity(F.col("race"), ethnicity_patterns).alias("ethnicity"),
        F.coalesce("marital_status", F.lit("UNKNOWN")).alias("marital_status"),
    )


def lab_counts(labevents: DataFrame) -> DataFrame:
    abnormal = F.count_if(F.col("flag") == "abnormal")
    n = F.count(F.lit(1))
    return (
        labevents.filter(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(
            n.alias("total_labs"),
            abnormal.alias("abnormal_count"),
            F.round(100.0 * abnormal / F.nullif(n, F.lit(0)), 2).alias("pct_abnormal_labs"),
        )
    )


def diagnosis_counts(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("num_diagnoses"))


def drug_counts(prescriptions: DataFrame, many: int = POLYPHARMACY_DRUGS) -> DataFrame:
    counts = prescriptions.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count_distinct("drug").alias("num_medications"))
    return counts.withColumn("polypharmacy", F.when(F.col("num_medications") >= many, 1).otherwise(0))


def clinical_features(
    admissions: DataFrame, labevents: DataFrame, diagnoses: DataFrame, prescriptions: DataFrame, cohort: DataFrame
) -> DataFrame:
    """Laboratory, diagnosis and drug counts of the cohort.

    Each fact table is reduced to one row per case, map side first, before it meets the cohort: raw
    fact rows are never exchanged for a join, however many of them one case has.
    """
    cases = of_cohort(admissions.select(KEY, "subject_id"), cohort)
    facts = [lab_counts(labevents), diagnosis_counts(diagnoses), drug_counts(prescriptions)]
    return reduce(with_counts, facts, cases)


def admission_types(admissions: DataFrame, emergency_types: tuple[str, ...] = recode.EMERGENCY_TYPES) -> DataFrame:
    kind = F.col("admission_type")
    return admissions.withColumns(
        {
            "is_emergency": recode.emergency_flag(kind, emergency_types),
            "admission_type": recode.emergency_or_elective(kind, emergency_types),
        }
    )


def readmission_flags(
    admissions: DataFrame, days: int = 30, emergency_types: tuple[str, ...] = recode.EMERGENCY_TYPES
) -> DataFrame:
    """Was the admission followed by an emergency admission of the subject within ``days``?

    Only the very next admission counts.  It may also start before this one ends.
    """
    typed = admission_types(admissions, emergency_types).select(
        KEY, "subject_id", "admittime", "dischtime", "admission_type", "is_emergency"
    )
    linked = shifted(
        typed,
        ["subject_id"],
        ["admittime", KEY],
        {"next_admittime": (F.col("admittime"), 1), "next_is_emergency": (F.col("is_emergency"), 1)},
    )
    soon = micros_between("dischtime", "next_admittime") <= days * MICROS_PER_DAY
    followed = F.when((F.col("next_is_emergency") == 1) & soon, 1).otherwise(0)
    return linked.select(KEY, "subject_id", "admittime", "admission_type", followed.alias("was_followed_by_uhr"))


def prior_counts(flagged: DataFrame, flag: str = "was_followed_by_uhr", out: str = "uhr_count") -> DataFrame:
    """How many strictly earlier rows of the subject carry the flag; equal times do not count each other.

    One RANGE window instead of a self-join.  Hot subjects go by distinct times.
    """
    value = F.coalesce(F.col(flag), F.lit(0)).cast("bigint")
    rows = flagged.withColumn("__at", epoch_micros("admittime"))
    cold, hot, _ = split_hot(rows, ["subject_id"])
    earlier = Window.partitionBy("subject_id").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    counted = cold.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if hot is not None:
        per_time = hot.groupBy("subject_id", "__at").agg(F.sum(value).alias("__here"))
        upto = running(per_time, ["subject_id"], ["__at"], {"__upto": ("sum", F.col("__here"))})
        before = upto.select("subject_id", "__at", (F.col("__upto") - F.col("__here")).alias(out))
        counted = counted.unionByName(attach(hot, before, ["subject_id", "__at"]))
    return counted.drop("__at")


def uhr_features(
    admissions: DataFrame, days: int = 30, emergency_types: tuple[str, ...] = recode.EMERGENCY_TYPES
) -> DataFrame:
    counted = prior_counts(readmission_flags(admissions, days, emergency_types))
    return counted.select(KEY, "subject_id", "admission_type", "uhr_count")


def nearest_measurement(admissions: DataFrame, measured: DataFrame, value: str) -> DataFrame:
    """The measurement of the subject closest in time to the admission, before or after it.

    ``measured``: subject_id, event_id, at (timestamp), <value>.  At equal distance the smallest
    event_id wins.  Instead of pairing every admission with every measurement of its subject, both are
    lined up on one time axis and the last measurement is carried forward, once in each direction.
    """
    point = F.struct(F.col("__at"), F.col("event_id"), F.col(value))
    # One measurement per subject and time is enough: the one with the smallest id.
    marks = (
        measured.withColumn("__at", epoch_micros("at"))
        .groupBy("subject_id", "__at")
        .agg(F.min("event_id").alias("event_id"), F.min_by(value, "event_id").alias(value))
    )
    axis = marks.select(
        "subject_id", "__at", F.lit(None).cast("bigint").alias(KEY), point.alias("__mark"), F.lit(0).alias("__kind")
    ).unionByName(
        admissions.select(
            "subject_id",
            epoch_micros("admittime").alias("__at"),
            KEY,
            F.lit(None).cast(marks.select(point.alias("p")).schema["p"].dataType).alias("__mark"),
            F.lit(1).alias("__kind"),
        )
    )
    axis = axis.withColumns({"__back": -F.col("__at"), "__id": F.coalesce(KEY, F.lit(0))})
    mark = F.col("__mark")
    reversed_mark = F.when(mark.isNotNull(), F.struct((-mark["__at"]).alias("col1"), mark["event_id"].alias("event_id"), mark[value].alias(value)))
    lined = running(axis, ["subject_id"], ["__at", "__kind", "__id"], {"__last": ("max", mark)})
    lined = running(lined, ["subject_id"], ["__back", "__kind", "__id"], {"__next": ("max", reversed_mark)})
    back, ahead = F.col("__last"), F.col("__next")
    options = [
        F.when(back.isNotNull(), F.struct((F.col("__at") - back["__at"]).alias("d"), back["event_id"].alias("i"), back[value].alias("v"))),
        F.when(ahead.isNotNull(), F.struct((-ahead["col1"] - F.col("__at")).alias("d"), ahead["event_id"].alias("i"), ahead[value].alias("v"))),
    ]
    return lined.filter("__kind = 1").select(KEY, "subject_id", F.least(*options)["v"].alias(value))


def bmi_features(admissions: DataFrame, omr: DataFrame) -> DataFrame:
    """BMI class of every admission by the nearest valid measurement; none gives Unknown."""
    valid = (
        omr.filter(F.col("result_name") == BMI_NAME)
        .withColumn("bmi_value", recode.measured_number(F.col("result_value"), *BMI_RANGE))
        .filter(F.col("bmi_value").isNotNull())
        .select("subject_id", "event_id", F.col("chartdate").cast("timestamp_ntz").alias("at"), "bmi_value")
    )
    nearest = nearest_measurement(admissions.select(KEY, "subject_id", "admittime"), valid, "bmi_value")
    return nearest.withColumn("bmi_category", recode.bmi_category(F.col("bmi_value")))


def chapter_counts(diagnoses: DataFrame) -> DataFrame:
    """Diagnoses per chapter and case: 18 conditional counts in one pass, no pivot."""
    coded = diagnoses.filter(F.col(KEY).isNotNull()).select(
        KEY, recode.icd_chapter(F.col("icd_version"), F.col("icd_code")).alias("chapter")
    )
    counts = [F.count_if(F.col("chapter") == i).alias(c) for i, c in enumerate(recode.CHAPTER_COLUMNS, start=1)]
    return coded.groupBy(KEY).agg(*counts)


def charlson_scores(diagnoses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum of the weights of the distinct conditions whose code prefixes occur in a case.

    Prefixes are matched once per distinct code, by hash join on every leading text of the code; the
    diagnosis rows then meet the resulting (code -> condition) table by equality.
    """
    codes = diagnoses.select("icd_version", "icd_code").filter(F.length("icd_code") > 0).distinct()
    leading = F.transform(F.sequence(F.lit(1), F.length("icd_code")), lambda n: F.left(F.col("icd_code"), n))
    meaning = (
        codes.withColumn("prefix", F.explode(leading))
        .join(mapping.withColumnRenamed("icd_code", "prefix"), ["icd_version", "prefix"])
        .select("icd_version", "icd_code", "condition", "weight")
        .distinct()
    )
    met = diagnoses.join(meaning, ["icd_version", "icd_code"]).select(KEY, "condition", "weight").distinct()
    return met.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.sum("weight").alias("charlson_score"))


def chronic_counts(diagnoses: DataFrame, codes: DataFrame) -> DataFrame:
    """Diagnosis rows whose (version, code) is in the list."""
    return (
        diagnoses.join(codes.select("icd_version", "icd_code"), ["icd_version", "icd_code"], "left_semi")
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("chronic_disease_count"))
    )


def diagnosis_features(diagnoses: DataFrame, mapping: DataFrame, chronic: DataFrame) -> DataFrame:
    """(hadm_id, icd_ch*, charlson_score, chronic_disease_count): all code features from one aggregation on the case.

    What a code means is looked up once per distinct code: its chapter, the conditions its leading texts
    name, whether it is in the chronic list.  Diagnosis rows then meet that table by equality and are reduced map side
    first.  A case's conditions are bits, one for each condition and weight of the mapping, so that the aggregation keeps
    numbers only and no sets.
    """
    key = ["icd_version", "icd_code"]
    rows = diagnoses.filter(F.col(KEY).isNotNull()).select(KEY, *key)
    codes = rows.select(*key).distinct()
    leading = F.transform(F.sequence(F.lit(1), F.length("icd_code")), lambda n: F.left(F.col("icd_code"), n))
    kinds = mapping.select("condition", "weight").distinct().collect()  # a row per condition of the lookup
    place = {tuple(kind): (f"__met_{i // 63}", 1 << i % 63) for i, kind in enumerate(kinds)}
    bits: dict[str, list[Column]] = {}
    for (condition, weight), (word, bit) in place.items():
        is_kind = F.col("condition").eqNullSafe(F.lit(condition)) & F.col("weight").eqNullSafe(F.lit(weight))
        bits.setdefault(word, []).append(F.when(is_kind, F.lit(bit).cast("bigint")))
    named = (
        codes.filter(F.length("icd_code") > 0)
        .withColumn("prefix", F.explode(leading))
        .join(mapping.withColumnRenamed("icd_code", "prefix"), ["icd_version", "prefix"])
        .groupBy(*key)
        .agg(*[F.bit_or(reduce(F.greatest, own, F.lit(0).cast("bigint"))).alias(w) for w, own in bits.items()])
    )
    listed = chronic.select(*key).distinct().withColumn("chronic", F.lit(1))
    meaning = codes.withColumn("chapter", recode.icd_chapter(F.col("icd_version"), F.col("icd_code"))).join(named, key, "left").join(listed, key, "left")
    counts = [F.count_if(F.col("chapter") == i).alias(c) for i, c in enumerate(recode.CHAPTER_COLUMNS, start=1)]
    met = attach(rows, meaning, key).groupBy(KEY).agg(*counts, *[F.bit_or(w).alias(w) for w in bits], F.count("chronic").alias("chronic_disease_count"))
    # A word is NULL where no row of the case has a condition.
    weighed = [F.when(F.col(word).bitwiseAND(F.lit(bit).cast("bigint")) != 0, F.lit(weight).cast("bigint")).otherwise(0) for (_, weight), (word, bit) in place.items()]
    score = reduce(lambda total, w: total + w, weighed, F.lit(0).cast("bigint"))
    return met.select(KEY, *recode.CHAPTER_COLUMNS, score.alias("charlson_score"), "chronic_disease_count")


def ed_flags(log: DataFrame, activities: tuple[str, ...]) -> DataFrame:
    """Cases with at least one of the activities, flag 1."""
    hits = log.filter(F.col("activity").isin(*activities)).select(F.col("case_id").alias(KEY)).distinct()
    return hits.withColumn("ed_admission", F.lit(1))


def process_features(
    transfers: DataFrame, points: DataFrame, tier_a: tuple[str, ...], tier_b: tuple[str, ...], by: list[str] = []
) -> DataFrame:
    """Hours and stays before the prediction point, in total and per tier, one row per case with a point row.

    Rows start before the point and have an end; the end is capped at the point.
    """
    hours = F.greatest(F.lit(0.0), hours_between("intime", F.least("outtime", "prediction_point")))
    in_a, in_b = in_units("careunit", tier_a), in_units("careunit", tier_b)
    sums = (
        transfers.select(KEY, "careunit", "intime", "outtime")
        .join(points.filter(F.col("prediction_point").isNotNull()), KEY)
        .filter((F.col("intime") < F.col("prediction_point")) & F.col("outtime").isNotNull())
        .groupBy(KEY, *by)
        .agg(
            F.sum(hours).alias("accumulated_duration_hrs"),
            F.sum(F.when(in_a, hours).otherwise(0.0)).alias("icu_duration_hrs"),
            F.sum(F.when(in_b, hours).otherwise(0.0)).alias("sw_duration_hrs"),
            F.count_if(in_a).alias("num_icu_stays"),
            F.count_if(in_b).alias("num_sw_stays"),
            F.count(F.lit(1)).alias("total_events"),
        )
    )
    return with_counts(points.select(KEY, *by), sums, by=by)


def admission_location(admissions: DataFrame) -> DataFrame:
    return admissions.select(KEY, F.coalesce("admission_location", F.lit(NO_LOCATION)).alias("admission_location"))


def feature_matrix(labels: DataFrame, parts: list[DataFrame], how: str = "left", by: list[str] = []) -> DataFrame:
    """Labels joined with any number of per-case feature tables on the case id.

    A part that has the ``by`` columns (such as the cohort) is joined on them as well.  All joins share
    the case id, so each input is exchanged at most once.
    """

    def join(left: DataFrame, part: DataFrame) -> DataFrame:
        return left.join(part.drop("subject_id"), [KEY, *[b for b in by if b in part.columns]], how)

    return reduce(join, parts, labels)


def null_audit(matrix: DataFrame, by: list[str] = []) -> DataFrame:
    """(column, n_null) for the columns that have NULLs, from one pass over the matrix."""
    columns = [c for c in matrix.columns if c not in by]
    counts = matrix.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(list(by), columns, "column", "n_null").filter("n_null > 0")


def fill_unknown(matrix: DataFrame, columns: list[str]) -> DataFrame:
    return matrix.fillna("UNKNOWN", subset=columns)


def exclude(matrix: DataFrame, excluded: DataFrame, by: list[str] = []) -> DataFrame:
    return matrix.join(excluded.select(KEY, *by), [KEY, *by], "left_anti")


def check_matrix(matrix: DataFrame, label: str, groups: dict[str, tuple[str, ...]] = GROUPS) -> list[str]:
    """Problems of the column layout (a plan-time check, no job): missing, extra or doubly grouped columns."""
    flat = [f for group in groups.values() for f in group]
    expected = {KEY, "subject_id", label, *flat}
    problems = [f"in two groups: {f}" for f in sorted({f for f in flat if flat.count(f) > 1})]
    problems += [f"missing: {c}" for c in sorted(expected - set(matrix.columns))]
    problems += [f"unexpected: {c}" for c in sorted(set(matrix.columns) - expected)]
    return problems


def condition_columns(matrix: DataFrame, condition: str, label: str) -> list[str]:
    """Feature columns of a run condition."""
    columns = [c for c in matrix.columns if c not in (KEY, "subject_id", label)]
    if condition == "No Process":
        return [c for c in columns if c not in GROUPS["process"] and not c.startswith("bow_")]
    if condition == "With Process":
        return [c for c in columns if not c.startswith("bow_")]
    return columns
