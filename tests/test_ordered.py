"""Ordered operations: the plain and the segmented path against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import ordered
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(1)
    # Key 'a' holds most rows, many of them at one single time; one key is NULL.
    data = [("a", rng.choice([5, 5, 5, rng.randint(0, 50)]), i, rng.randint(0, 2)) for i in range(120)]
    data += [("b", rng.randint(0, 9), i, 1) for i in range(200, 210)]
    data += [(None, rng.randint(0, 9), i, rng.randint(0, 2)) for i in range(300, 306)] + [("c", 1, 400, None)]
    return data


def frame(spark, sample):
    return spark.createDataFrame(sample, "k STRING, t INT, id INT, v INT")


def expected(sample):
    out = {}
    for key in {k for k, *_ in sample}:
        own = sorted((r for r in sample if r[0] == key), key=lambda r: (r[1], r[2]))
        total, island, best = None, 0, None
        for i, (_, _, ident, v) in enumerate(own):
            total = v if total is None else total + (v or 0)
            best = max((x for x in (best, v) if x is not None), default=None)
            if i == 0 or v is None or own[i - 1][3] is None or own[i - 1][3] != v:
                island += 1
            nxt = own[i + 1][2] if i + 1 < len(own) else None
            third = own[i + 2][2] if i + 2 < len(own) else None
            before = own[i - 1][2] if i else None
            out[ident] = (i + 1, total, best, island, nxt, third, before)
    return out


def computed(df):
    order = ["t", "id"]
    a = ordered.positions(df, ["k"], order)
    b = ordered.running(df, ["k"], order, {"total": ("sum", F.col("v")), "best": ("max", F.col("v"))})
    c = ordered.islands(df, ["k"], order, "v")
    d = ordered.shifted(df, ["k"], order, {"n": (F.col("id"), 1), "n2": (F.col("id"), 2), "p": (F.col("id"), -1)})
    parts = [
        {r["id"]: r for r in x.collect()} for x in (a, b, c, d)
    ]
    return {
        i: (parts[0][i]["pos"], parts[1][i]["total"], parts[1][i]["best"], parts[2][i]["island"], parts[3][i]["n"], parts[3][i]["n2"], parts[3][i]["p"])
        for i in parts[0]
    }


def test_plain_path(spark, sample):
    assert computed(frame(spark, sample)) == expected(sample)


def test_segmented_path(spark, sample, hot):
    df = frame(spark, sample)
    assert ordered.split_hot(df, ["k"])[1] is not None
    assert computed(df) == expected(sample)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile(spark, q, hot):
    values = [3.0, 3.0, 3.0, 1.0, 10.0, 7.5, 7.5]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 2.0), ("y", None)], "k STRING, v DOUBLE")
    import numpy as np

    got = dict(rows(ordered.quantile(df, ["k"], "v", q, "m"), "k", "m"))
    assert got["x"] == pytest.approx(np.percentile(values, 100 * q)) and got["y"] == 2.0


def test_small_inputs_are_not_searched(spark, sample):
    assert ordered.hot_keys(frame(spark, sample), ["k"]) == (["k"], None)


def test_group_values_agree(spark, sample):
    df = frame(spark, sample).filter("k IS NOT NULL")
    value = {"m": F.max("t")}
    assert rows(ordered.group_values(df, ["k"], value), "id", "m") == rows(ordered.group_values(df, ["k"], value, hot=True), "id", "m")


def test_declared_hot_keys_are_counted_once(spark, sample):
    asked = []

    def source():
        asked.append(1)
        return frame(spark, sample)

    with ordered.hot_rows(20), ordered.known_hot(k=source):
        assert computed(frame(spark, sample)) == expected(sample)
        columns, (table, n_rows) = ordered.hot_keys(frame(spark, sample), ["v", "k"])
        assert columns == ["k"] and [r["k"] for r in table.collect()] == ["a"] and n_rows == 120
    assert len(asked) == 1


def test_a_low_limit_does_not_cut_a_segment_per_few_rows(spark):
    """Segments are tasks: 50 000 hot rows under a limit of 4 were cut into 12 500 of them."""
    many = spark.range(50_000).selectExpr("id % 100 AS k", "id DIV 100 AS t", "id")
    with ordered.hot_rows(4):
        parts = ordered._segments(many, 50_000, ["k"], ["t", "id"])
        assert parts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = ordered.positions(many, ["k"], ["t", "id"])
        assert placed.filter("pos <> t + 1").count() == 0 and placed.count() == 50_000
        assert ordered._n_segments(many, 50_000_000) == 500
    with ordered.hot_rows(1_000_000):
        assert ordered._n_segments(many, 50_000_000) == 50
