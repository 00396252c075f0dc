import datetime as dt

from pyspark.sql import functions as F

from caseflow.functions import recode
from caseflow.functions.locations import AREA_ICU, HOSPITAL_AREAS, HOSPITAL_LADDER, LEVEL_NAMES, activity_name
from caseflow.operators import analysis as an
from caseflow.operators import events as ev
from caseflow.operators import features as ft
from tests.conftest import at, rows


def apply(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_age_bands(spark):
    got = apply(spark, [17, 18, 27, 28, 87, 88, None], "INT", recode.age_band)
    assert got == ["88+", "18-27", "18-27", "28-37", "78-87", "88+", "88+"]


def test_ethnicity_cascade(spark):
    texts = ["White - Russian", "BLACK/CAPE VERDEAN", "South American", "Asian - Chinese", "PATIENT DECLINED", None, "PORTUGUESE", "Other thing",
             "AMERICAN INDIAN/ALASKA NATIVE", "MULTIPLE RACE", "white hispanic"]
    assert apply(spark, texts, "STRING", recode.ethnicity) == [
        "WHITE", "BLACK", "HISPANIC/LATINO", "ASIAN", "UNKNOWN", "UNKNOWN", "WHITE", "OTHER", "NATIVE", "MULTIPLE", "WHITE",
    ]


def test_insurance_and_admission_type(spark):
    assert apply(spark, ["Medicare", "No charge", None], "STRING", recode.insurance_group) == ["Medicare", "Other", "Other"]
    assert apply(spark, ["URGENT", "ELECTIVE", None], "STRING", recode.emergency_or_elective) == ["emergency", "elective", "elective"]
    assert apply(spark, ["EW EMER.", None], "STRING", recode.emergency_flag) == [1, 0]


def test_bmi_text_and_classes(spark):
    texts = ["18.5", "24.", "abc", "9", "101", "10", "100", "-20", "1e2", "", None]
    assert apply(spark, texts, "STRING", lambda c: recode.measured_number(c, 10, 100)) == [
        18.5, 24.0, None, None, None, 10.0, 100.0, None, None, None, None,
    ]
    values = [18.4, 18.5, 24.9, 24.95, 25.0, 29.9, 29.95, 30.0, None]
    assert apply(spark, values, "DOUBLE", recode.bmi_category) == [
        "Underweight", "Normal", "Normal", "Unknown", "Overweight", "Overweight", "Unknown", "Obese", "Unknown",
    ]


def test_chapters(spark):
    cases = {
        (9, "000"): None, (9, "001"): 1, (9, "139"): 1, (9, "140"): 2, (9, "999"): 17, (9, "E812"): 18, (9, "v10"): 18, (9, "12"): None,
        (9, "4280"): 7, (10, "D49"): 2, (10, "D50"): 4, (10, "D89"): 4, (10, "D90"): None, (10, "Z00"): 18, (10, "a00"): None, (10, "A00"): 1,
        (10, "H60"): 6, (10, "T88"): 17, (8, "001"): None, (9, None): None,
    }
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(cases)], "i INT, v INT, c STRING")
    got = [r[0] for r in df.orderBy("i").select(recode.icd_chapter(F.col("v"), F.col("c"))).collect()]
    assert got == list(cases.values())


def test_activity_names(spark):
    data = [("Coronary Care Unit (CCU)", "admit"), ("PACU", "transfer"), ("Emergency Department", "ED"), ("Medicine", "ED"), ("Nursery", "admit"),
            ("Surgery", "discharge"), (None, "admit"), ("Surgery", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i INT, u STRING, e STRING")
    got = [r[0] for r in df.orderBy("i").select(activity_name("u", "e", HOSPITAL_AREAS)).collect()]
    assert got == [f"Admission to {AREA_ICU}", "Transfer to Stepdown", "Admission to Emergency Department", None, None, None, None, None]


def admissions(spark, table):
    schema = "hadm_id BIGINT, subject_id BIGINT, admittime TIMESTAMP_NTZ, dischtime TIMESTAMP_NTZ, admission_type STRING"
    return spark.createDataFrame([(h, s, at(a), at(b), t) for h, s, a, b, t in table], schema)


DAY = 24


def readmission_table():
    return [
        (1, 1, 0, DAY, "ELECTIVE"), (2, 1, 31 * DAY, 32 * DAY, "URGENT"),  # exactly 30 days
        (3, 2, 0, DAY, "ELECTIVE"), (4, 2, 31 * DAY + 1 / 3600, 40 * DAY, "URGENT"),  # 30 days and a second
        (5, 3, 0, 9 * DAY, "ELECTIVE"), (6, 3, DAY, 2 * DAY, "URGENT"),  # overlapping
        (7, 4, 0, DAY, "ELECTIVE"), (8, 4, 2 * DAY, 3 * DAY, "ELECTIVE"), (9, 4, 4 * DAY, 5 * DAY, "URGENT"),  # elective next
    ]


def test_readmission(spark):
    flags = dict(rows(ft.readmission_flags(admissions(spark, readmission_table())), "hadm_id", "was_followed_by_uhr"))
    assert flags == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 1, 9: 0}


def prior_table(spark):
    data = [(1, 1, 0, 1), (2, 1, 5, 1), (3, 1, 5, 0), (4, 1, 6, 0), (5, 2, 0, None), (6, 1, 7, 1)]
    return spark.createDataFrame(
        [(h, s, at(t), f) for h, s, t, f in data], "hadm_id INT, subject_id INT, admittime TIMESTAMP_NTZ, was_followed_by_uhr INT"
    )


PRIOR = {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 2}


def test_prior_counts_ignore_equal_times(spark):
    assert dict(rows(ft.prior_counts(prior_table(spark)), "hadm_id", "uhr_count")) == PRIOR


def test_prior_counts_of_hot_subjects(spark, hot):
    assert dict(rows(ft.prior_counts(prior_table(spark)), "hadm_id", "uhr_count")) == PRIOR


def nearest(spark):
    adm = admissions(spark, [(1, 1, 48, 50, ""), (2, 1, 0, 1, ""), (3, 2, 0, 1, ""), (4, 1, 36, 37, ""), (5, 1, 500, 501, "")])
    marks = [(1, 11, 24, 20.0), (1, 10, 72, 30.0), (1, 12, 24, 21.0), (1, 13, 48, 40.0)]
    measured = spark.createDataFrame([(s, i, at(t), v) for s, i, t, v in marks], "subject_id BIGINT, event_id BIGINT, at TIMESTAMP_NTZ, v DOUBLE")
    return dict(rows(ft.nearest_measurement(adm, measured, "v"), "hadm_id", "v"))


def test_nearest_measurement(spark):
    # hadm 4 is twelve hours from 24 h (id 11) and from 48 h (id 13): the smaller id wins.
    assert nearest(spark) == {1: 40.0, 2: 20.0, 3: None, 4: 20.0, 5: 30.0}


def test_nearest_measurement_of_hot_subjects(spark, hot):
    assert nearest(spark) == {1: 40.0, 2: 20.0, 3: None, 4: 20.0, 5: 30.0}


def test_charlson_and_chronic(spark):
    codes = spark.createDataFrame(
        [(1, 9, "41001"), (1, 9, "412"), (1, 10, "C78"), (2, 9, "4"), (2, 10, "E11"), (3, 9, "V10"), (3, 9, "V10"), (4, 10, "410")],
        "hadm_id INT, icd_version INT, icd_code STRING",
    )
    mapping = spark.createDataFrame(
        [(9, "41", "mi", 1), (9, "410", "mi", 1), (10, "C", "cancer", 2), (10, "C7", "mets", 6), (10, "E11", "dm", 1)],
        "icd_version INT, icd_code STRING, condition STRING, weight INT",
    )
    assert rows(ft.charlson_scores(codes, mapping)) == [(1, 9), (2, 1)]  # mild and severe forms both count, once each
    listed = spark.createDataFrame([(9, "V10"), (10, "410")], "icd_version INT, icd_code STRING")
    assert rows(ft.chronic_counts(codes, listed)) == [(3, 2), (4, 1)]
    odd = codes.unionByName(spark.createDataFrame([(None, 9, "412"), (5, None, None), (6, 9, "")], codes.schema))
    one = ft.diagnosis_features(odd, mapping, listed)
    assert rows(one, "hadm_id", "charlson_score", "chronic_disease_count") == [(1, 9, 0), (2, 1, 0), (3, 0, 2), (4, 0, 1), (5, 0, 0), (6, 0, 0)]
    chapters = [c for c in one.columns if c.startswith("icd_ch")]
    assert rows(one, "hadm_id", *chapters) == rows(ft.chapter_counts(odd), "hadm_id", *chapters)


def test_code_features_keep_no_sets(spark):
    """Conditions are bits: the aggregation on the case holds numbers, also beyond 63 conditions and with an unknown weight."""
    mapping = spark.createDataFrame([(9, f"{i:03}", f"c{i}", i) for i in range(130)] + [(10, "Z", "open", None)], "icd_version INT, icd_code STRING, condition STRING, weight INT")
    codes = [(1, 9, f"{i:03}") for i in (0, 5, 62, 63, 64, 126, 129, 5)] + [(2, 9, "0621"), (2, 9, "062"), (3, 10, "Z1"), (4, 10, "A")]
    found = ft.diagnosis_features(spark.createDataFrame(codes, "hadm_id INT, icd_version INT, icd_code STRING"), mapping, mapping.filter("icd_code = '005'"))
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "hadm_id", "charlson_score", "chronic_disease_count") == [(1, 449, 2), (2, 62, 0), (3, None, 0), (4, 0, 0)]


def test_thinned_keeps_every_row_of_the_ids(spark):
    ids = spark.range(0, 60_000, 30).select((F.col("id") - 600).alias("hadm_id")).unionByName(spark.createDataFrame([(None,), (0,)], "hadm_id BIGINT"))
    facts = spark.range(-600, 59_400).select(F.col("id").alias("hadm_id")).unionByName(spark.createDataFrame([(None,), (30,), (30,)], "hadm_id BIGINT"))
    left = [r["hadm_id"] for r in ft.thinned(facts, ft.key_bits(ids)).collect()]
    assert left.count(None) == 1 and left.count(30) == 3 and {*range(-600, 59_400, 30)} <= set(left)
    assert len(left) < 2200
    assert ft.thinned(facts, ft.key_bits(ids.filter("false"))).count() == 0


def test_process_features_cap_at_the_point(spark, moves):
    table = moves([(1, "X", 0, 2), (1, "I", 2, 6), (1, "W", 5, 9), (1, "X", 6, 7), (1, "X", 1, None), (2, "I", 0, None)])
    points = ev.prediction_points(table, ("I",))
    got = {r["hadm_id"]: r for r in ft.process_features(table, points, ("I",), ("W",)).collect()}
    assert (got[1]["accumulated_duration_hrs"], got[1]["icu_duration_hrs"], got[1]["sw_duration_hrs"]) == (7.0, 4.0, 1.0)
    assert (got[1]["num_icu_stays"], got[1]["num_sw_stays"], got[1]["total_events"]) == (1, 1, 3)
    assert got[2]["total_events"] == 0  # the point of an open stay is NULL


def test_drugs_and_labs(spark):
    drugs = spark.createDataFrame([(1, d) for d in "abcdea"] + [(2, "a"), (None, "b")], "hadm_id INT, drug STRING")
    assert rows(ft.drug_counts(drugs)) == [(1, 5, 1), (2, 1, 0)]
    labs = spark.createDataFrame([(1, "abnormal"), (1, None), (1, None), (None, "abnormal")], "hadm_id INT, flag STRING")
    assert rows(ft.lab_counts(labs)) == [(1, 3, 1, 33.33)]


def test_matrix_checks(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "hadm_id INT, a STRING, b STRING")
    assert rows(ft.null_audit(df)) == [("a", 1), ("b", 2)]
    assert rows(ft.fill_unknown(df, ["a", "b"]), "a", "b") == [("UNKNOWN", "UNKNOWN"), ("x", "UNKNOWN")]
    assert len(ft.FEATURES) == len(set(ft.FEATURES)) == 39
    assert "missing: age_band" in ft.check_matrix(df, "y") and "unexpected: a" in ft.check_matrix(df, "y")


def test_location_ladder_of_the_hospital(spark):
    units = ["Coronary Care Unit (CCU)", "PACU", "Neuro Stepdown", "Medicine", "Cardiology", "Nursery"]
    profile = spark.createDataFrame([(u, 10, 5) for u in units], "careunit STRING, n_rows INT, n_admissions INT")
    ladder = {r["careunit"]: r for r in an.location_ladder(profile, HOSPITAL_LADDER, LEVEL_NAMES).collect()}
    assert [ladder[u]["level"] for u in units] == [3, 1, 1, 0, 0, None]
    assert [ladder[u]["ladder_rung"] for u in units] == [2, None, 1, 0, 0, None]
    assert [ladder[u]["in_ladder"] for u in units] == [True, False, True, True, True, False]
    assert [ladder[u]["contestable"] for u in units] == [True, True, True, False, True, False]


def test_log_cleaning(spark):
    data = [(1, "2024-01-01 00:00:00", "A"), (1, "nonsense", "A"), (1, "2024-01-02 00:00:00", None), (1, "2024-01-02 00:00:00", "UNKNOWN"),
            (1, None, "B")]
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "case_id INT, event_time STRING, activity STRING, tie INT")
    assert ev.clean_log(log).count() == 1
    assert rows(ev.cleaning_report(log)) == [(5, 2, 2, 1)]
    assert ev.export_log(ev.clean_log(log)).collect()[0].asDict() == {"Case ID": 1, "Activity": "A", "Timestamp": "2024-01-01 00:00:00"}
    assert dt.datetime(2024, 1, 1) == ev.clean_log(log).collect()[0]["event_time"]
