from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.functions.locations import ACTIVITY_IDS
from caseflow.operators import design as de
from caseflow.operators import encode as en
from caseflow.operators import events as ev
from tests.conftest import at, rows

ICU, WARD = "Transfer to ICU", "Transfer to Medical Ward"


def log_of(spark, cases):
    """cases: {case: [(hour, tie, activity), ...]}"""
    data = [(c, at(h), a, t) for c, events in cases.items() for h, t, a in events]
    return spark.createDataFrame(data, "case_id BIGINT, event_time TIMESTAMP_NTZ, activity STRING, tie BIGINT")


def points_of(spark, points):
    data = [(c, None if h is None else at(h)) for c, h in points.items()]
    return spark.createDataFrame(data, "hadm_id BIGINT, prediction_point TIMESTAMP_NTZ")


def long_case(n):
    return [(i, i, ICU if i % 2 else WARD) for i in range(n)]


def test_sequences(spark):
    log = log_of(spark, {1: long_case(30), 2: long_case(31), 3: [(5, 0, ICU)], 4: [(1, 7, ICU), (1, -1, "Hospital Admission"), (1, 3, WARD)]})
    points = points_of(spark, {1: 100, 2: 100, 3: 5, 4: 2, 5: 9, 6: None})
    got = dict(rows(en.encode_sequences(log, points), "hadm_id", "seq"))
    assert set(got) == {1, 2, 4}  # the event of case 3 lies at its point, 5 and 6 have none
    assert got[1] == [7, 8] * 15 and got[2] == [8, 7] * 15
    assert got[4] == [0] * 27 + [1, 7, 8]  # equal times in tie order
    profile = en.sequence_profile(log, points).collect()[0]
    assert (profile["n_cases"], profile["encoded"], profile["dropped"], profile["max_len"], profile["truncated"]) == (6, 3, 3, 31, 1)


def test_padding_does_not_change_the_trace(spark):
    log, points = log_of(spark, {1: long_case(7), 2: long_case(3)}), points_of(spark, {1: 99, 2: 99})
    strip = lambda n: {k: [t for t in v if t] for k, v in rows(en.encode_sequences(log, points, max_len=n), "hadm_id", "seq")}
    assert strip(10) == strip(30)
    seq = en.encode_sequences(log, points, max_len=5).select("hadm_id", en.right_pad(F.col("seq"), 5).alias("r"), en.token_count(F.col("seq")).alias("n"))
    assert rows(seq) == [(1, [7, 8, 7, 8, 7], 5), (2, [7, 8, 7, 0, 0], 3)]


def test_unknown_activities(spark):
    log = log_of(spark, {1: [(0, 0, "Admission to ICU"), (1, 1, "Moon")]})
    assert rows(en.unknown_activities(log)) == [("Moon", 1)]
    assert sorted(ACTIVITY_IDS.values()) == list(range(1, 12))


CASES = {1: long_case(4), 2: long_case(5), 3: [(0, 0, ICU)], 4: long_case(9)}


def brute(cases, longest=3):
    out = Counter()
    for case, events in cases.items():
        words = [a.lower().replace(" ", "_") for *_, a in sorted(events)]
        for n in range(1, longest + 1):
            for i in range(len(words) - n + 1):
                out[case, " ".join(words[i : i + n])] += 1
    return sorted((c, g, n) for (c, g), n in out.items())


def check_ngrams(spark):
    counts = en.ngrams(log_of(spark, CASES), points_of(spark, {c: 50 for c in CASES}))
    assert rows(counts, "hadm_id", "ngram", "n") == brute(CASES)
    return counts


def test_ngrams(spark):
    check_ngrams(spark)


def test_ngrams_of_hot_cases(spark, hot):
    check_ngrams(spark)


def test_vocabulary_is_fitted_on_train_only(spark):
    counts = check_ngrams(spark)
    train = spark.createDataFrame([(1,), (2,), (3,)], "hadm_id BIGINT")
    vocabulary = en.fit_vocabulary(counts, train)
    by_hand = Counter(g for c, g, _ in brute(CASES) if c in (1, 2, 3))
    assert dict(rows(vocabulary, "ngram", "df")) == {g: n for g, n in by_hand.items() if n >= 2}
    known = [g for g in sorted(by_hand) if by_hand[g] >= 2]
    ids = spark.createDataFrame([(c,) for c in [*CASES, 9]], "hadm_id BIGINT")
    bags = {r["hadm_id"]: r["bag"] for r in de.bag_vectors(ids, counts, vocabulary).collect()}
    assert all(v.size == len(known) for v in bags.values()) and bags[9].numNonzeros() == 0
    assert sorted((c, known[i], int(v[int(i)])) for c, v in bags.items() for i in v.indices) == [r for r in brute(CASES) if r[1] in known]
    assert rows(en.bag_of_ngrams(counts, vocabulary), "hadm_id", "ngram", "n") == [r for r in brute(CASES) if by_hand.get(r[1], 0) >= 2]


def test_directly_follows(spark):
    edges = {(r["source"], r["target"]): r for r in ev.directly_follows(log_of(spark, CASES)).collect()}
    assert edges[ICU, WARD]["n"] == 7 and edges[ICU, WARD]["n_cases"] == 3 and edges[WARD, ICU]["median_gap_hours"] == pytest.approx(1.0)


def test_case_trace_and_ends(spark):
    log = log_of(spark, {1: [(1, 2, "c"), (0, 0, "a"), (1, 1, "b")], 2: [(0, 0, "a")]})
    assert rows(ev.case_trace(log, F.col("case_id") == 1), "pos", "activity") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(ev.first_activity(log)) == [("a", 2)]
    assert rows(ev.end_points(log)) == [("end", "a", 1), ("end", "c", 1), ("start", "a", 2)]


def test_unknown_activities_stop_the_encoder(spark):
    log = log_of(spark, {1: [(1, 0, ICU), (2, 0, "Somewhere else")]})
    points = points_of(spark, {1: 9})
    with pytest.raises(Exception, match="activity without a token: Somewhere else"):
        en.encode_sequences(log, points).collect()
    assert en.encode_sequences(log, points_of(spark, {1: 2})).count() == 1  # the prefix ends before it


@pytest.mark.parametrize("point", [0, 3, 50])
def test_one_pass_has_both_sides_of_the_point(spark, point):
    log, points = log_of(spark, CASES), points_of(spark, {c: point for c in CASES})
    both = en.flagged_ngrams(log, points)
    assert rows(both.filter("n_before > 0"), "hadm_id", "ngram", "n_before") == rows(en.ngrams(log, points), "hadm_id", "ngram", "n")
    assert rows(both, "hadm_id", "ngram", "n_upto") == rows(en.ngrams(log, points, inclusive=True), "hadm_id", "ngram", "n")
    train = spark.createDataFrame([(1,), (2,)], "hadm_id BIGINT")
    words = en.boundary_vocabularies(both, train)
    strict = en.ngrams(log, points)
    for setting, want in {"A": en.fit_vocabulary(en.ngrams(log, points, inclusive=True), None), "B": en.fit_vocabulary(strict, None), "C": en.fit_vocabulary(strict, train)}.items():
        assert rows(words.filter(setting), "ngram") == rows(want, "ngram")


def test_trainer_inputs_join_written_parts(spark, tmp_path):
    """The last stage joins finished parts; the windows over the events have ended before it."""
    from __spark_entry__ import queries

    kinds = F.element_at(F.array(*[F.lit(k) for k in ("view", "purchase", "click", "signup")]), (F.xxhash64("id") % 4 + 5).cast("int") % 4 + 1)
    events = spark.range(400).select(
        F.col("id").alias("event_id"), (F.lit(at(0)) + F.make_dt_interval((F.col("id") % 25).cast("int"), F.lit(0), (F.col("id") % 60).cast("int"))).alias("ts"),
        (F.col("id") % 11).alias("user_id"), kinds.alias("event_type"), (F.col("id") % 37).cast("double").alias("value"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = queries()["trainer_inputs"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Window" not in plan and "parquet" not in plan
    got = found.collect()
    assert {r["cohort"] for r in got} == {"ICU", "SW"} and {r["part"] for r in got} == {"train", "val", "test"}
    assert len({(r["cohort"], r["hadm_id"]) for r in got}) == len(got) and all(r["n_tabular"] == 7 for r in got)
