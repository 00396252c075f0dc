import hashlib
from collections import Counter

import pytest

from caseflow.operators import split as sp
from tests.conftest import rows


@pytest.fixture
def labels(spark):
    # 60 subjects with 1 to 4 cases; every third subject has one positive case; one small stratum of 3 subjects.
    data = [(s * 10 + i, s, int(s % 3 == 0 and i == 0)) for s in range(60) for i in range(1 + s % 4)]
    return spark.createDataFrame(data, "hadm_id BIGINT, subject_id BIGINT, y INT")


def parts(split):
    return {r["hadm_id"]: r["part"] for r in split.collect()}


def test_grouped_split(labels):
    split = sp.grouped_split(labels, "y").persist()
    assert {r["check"]: r["n_bad"] for r in sp.split_checks(split, labels).collect()} == {
        "case_in_two_parts": 0, "subject_in_two_parts": 0, "not_covered": 0, "not_in_cohort": 0, "unknown_part": 0,
    }
    profile = {r["part"]: r for r in sp.split_profile(split, "y").collect()}
    assert profile["test"]["n_subjects"] == 4 + 8  # a fifth of 20 and of 40 subjects
    assert sum(p["n"] for p in profile.values()) == labels.count()
    assert abs(sum(p["share"] for p in profile.values()) - 1) < 1e-3


def test_split_by_the_hot_path_is_the_same(labels, spark, hot):
    on = parts(sp.grouped_split(labels, "y"))
    spark.conf.unset("spark.caseflow.hotRows")
    assert on == parts(sp.grouped_split(labels, "y"))


def test_tiny_strata(spark):
    few = spark.createDataFrame([(1, 1, 1), (2, 2, 0), (3, 3, 0)], "hadm_id BIGINT, subject_id BIGINT, y INT")
    assert sorted(parts(sp.grouped_split(few, "y"))) == [1, 2, 3]


def test_ungrouped_split_leaks_subjects(labels):
    split = sp.stratified_split(labels, "y")
    bad = {r["check"]: r["n_bad"] for r in sp.split_checks(split, labels).collect()}
    assert bad["case_in_two_parts"] == 0 and bad["subject_in_two_parts"] > 0


def test_digest_ignores_order_and_sees_changes(labels, spark):
    split = sp.grouped_split(labels, "y")
    one = sp.split_digest(split).first()
    assert one == sp.split_digest(split.orderBy("hadm_id")).first()
    moved = split.replace({"test": "val"}, subset=["part"]).filter("hadm_id >= 0")
    assert sp.split_digest(moved).first()["split_id"] != one["split_id"]


def test_store_and_verify(labels, tmp_path, spark):
    split = sp.grouped_split(labels, "y")
    folder = str(tmp_path / "s")
    sp.write_split(split, sp.manifest(split, "SW", "canonical", "lat"), folder)
    assert parts(sp.read_split(spark, folder)) == parts(split)
    with pytest.raises(ValueError, match="stratified_on"):
        sp.read_split(spark, folder, "old")
    split.limit(5).select("hadm_id", "subject_id", "part").write.mode("append").parquet(folder + "/parts")
    with pytest.raises(ValueError, match="split_id"):
        sp.read_split(spark, folder)


def test_overlap_and_provenance(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "hadm_id INT")
    assert rows(sp.set_overlap(ids(1, 2, 3), ids(3, 4))) == [(3, 2, 1, 2, 1, 0.25)]
    results = spark.createDataFrame(
        [("ICU", "lat", "a"), ("ICU", "lat", " "), ("SW", "lat", "a"), ("SW", "lat", "b"), ("SW", "old", None)], "Cohort STRING, Variant STRING, split_id STRING"
    )
    assert rows(sp.provenance(results)) == [("ICU", "lat", 1, 1, True), ("SW", "lat", 2, 0, False), ("SW", "old", 0, 1, True)]
    with pytest.raises(ValueError, match="SW/lat"):
        sp.require_one_split(results)
    assert sp.require_one_split(results.filter("Cohort = 'ICU'")).count() == 2


def tree_by_hand(ids, bits, levels):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes = {}
    for i, c in sorted(Counter(ids).items()):
        nodes.setdefault(i >> bits, []).append((c, f"{i}:{c}"))
    out = []
    for level in range(levels + 1):
        made = {n: (sum(c for c, _ in own), sha(",".join(e for _, e in own))) for n, own in nodes.items()}
        out += [(level, n, c, d) for n, (c, d) in made.items()]
        nodes = {}
        for n, (c, d) in sorted(made.items()):
            nodes.setdefault(n >> bits if level < levels - 1 else 0, []).append((c, f"{n}={d}"))
    return sorted(out)


def test_digest_tree(spark):
    ids = [*range(0, 90, 3), 7, 7, 4000, 4001, -5, 70_000]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "hadm_id BIGINT")
    tree = sp.digest_tree(frame(ids), bits=4)
    assert sorted(tuple(r) for r in tree.collect()) == tree_by_hand(ids, 4, 5)
    assert sp.digest_tree(frame([]), bits=4).count() == 0
    # Two equal ids cancel in a XOR; here they show.  An id less and an id more are found where they are.
    other = [i for i in ids if i != 7] + [4002]
    found = sp.differing_ranges(tree, sp.digest_tree(frame(other), bits=4), bits=4).collect()
    assert sorted(tuple(r) for r in found) == [(0, 15, 8, 6), (4000, 4015, 2, 3)]


def test_a_changed_split_names_the_range(labels, spark, tmp_path):
    split = sp.grouped_split(labels, "y")
    folder = str(tmp_path / "split")
    sp.write_split(split, sp.manifest(split, "SW", "canonical", "lat"), folder)
    assert sp.split_differences(spark, folder).count() == 0
    extra = split.filter("part = 'train'").limit(1)
    case = extra.first()["hadm_id"]
    extra.select("hadm_id", "subject_id", "part").write.mode("append").parquet(f"{folder}/parts")
    with pytest.raises(ValueError, match=f"ids {case >> 10 << 10} to .* of part train"):
        sp.read_split(spark, folder)
