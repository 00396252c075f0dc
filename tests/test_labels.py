"""One hand-made table per label rule."""

import pytest

from caseflow.functions.locations import Tiers
from caseflow.operators import events as ev
from caseflow.operators import labels as lb
from tests.conftest import at, rows

TIER = ("W",)
TIERS = Tiers(critical=("I",), intermediate=("M",), pacu=("P",))
US = 1 / 3_600_000_000


def one(moves, table, tier=TIER):
    return lb.returns(moves(table), tier, TIERS).collect()[0]


def test_start_at_t0_is_no_return_but_a_gap_row(moves):
    r = one(moves, [(1, "W", 0, 5), (1, "W", 5, 6)])
    assert r["t0"] == at(5) and r["t_return"] is None and r["left_old"] == 0
    r = one(moves, [(1, "W", 0, 5), (1, "I", 5, 6), (1, "W", 5 + US, 7)])
    assert r["t_return"] == at(5 + US) and r["route"] == "via_critical"


def test_t0_is_the_earliest_end_while_the_point_is_the_end_of_the_first_stay(moves):
    table = [(1, "W", 0, None), (1, "W", 2, 4), (1, "W", 6, 8)]
    assert one(moves, table)["t0"] == at(4)
    assert ev.prediction_points(moves(table), TIER).collect()[0]["prediction_point"] is None
    assert ev.cohort_points(moves(table), {"w": TIER}).collect()[0]["prediction_point"] is None
    table = [(1, "W", 0, 9), (1, "W", 2, 4)]
    assert one(moves, table)["t0"] == at(4)
    assert ev.prediction_points(moves(table), TIER).collect()[0]["prediction_point"] == at(9)


def test_all_stays_open(moves):
    r = one(moves, [(1, "W", 0, None), (1, "I", 1, 2)])
    assert (r["t0"], r["left_old"], r["route"]) == (None, 0, "no_return")


def test_lateral_moves_are_relabelled(moves):
    lateral = one(moves, [(1, "W", 0, 1), (1, "V", 1.5, 2), (1, "W", 2, 3)], ("W", "V"))
    assert (lateral["left_old"], lateral["left_lat"]) == (1, 0)
    real = one(moves, [(1, "W", 0, 1), (1, "X", 1, 2), (1, "W", 2, 3)], ("W", "V"))
    assert (real["left_old"], real["left_lat"]) == (1, 1)


def test_a_null_unit_counts_as_outside(moves):
    assert one(moves, [(1, "W", 0, 1), (1, None, 1, 2), (1, "W", 2, 3)])["left_lat"] == 1


@pytest.mark.parametrize(
    "gap, route",
    [(("M", "I", "P"), "via_critical"), (("M", "P"), "via_intermediate"), (("P",), "via_pacu"), (("X",), "via_ward"), ((), "via_ward")],
)
def test_route_precedence(moves, gap, route):
    r = one(moves, [(1, "W", 0, 1), *[(1, u, 1 + i / 10, 2) for i, u in enumerate(gap)], (1, "W", 2, 3)])
    assert r["route"] == route
    assert r["left_corr"] == int(route == "via_ward") and r["left_corrpacu"] == int(route in ("via_ward", "via_pacu"))


COLLAPSE = [
    (1, "A", 0, 1), (1, "A", 1, 5), (1, "A", 2, 3), (1, None, 3, 4), (1, None, 4, 5), (1, "A", 5, 6),
    (2, "A", 0, 1), (2, "B", 1, 2), (2, "B", 2, None), (3, "B", 0, 1),
]
COLLAPSED = [
    (1, "A", at(0), at(5)), (1, "A", at(5), at(6)), (1, "~", at(3), at(4)), (1, "~", at(4), at(5)), (2, "A", at(0), at(1)),
    (2, "B", at(1), at(2)), (3, "B", at(0), at(1)),
]


def collapsed(df):
    return rows(lb.collapse(df).fillna("~", ["careunit"]), "hadm_id", "careunit", "intime", "outtime")


def test_collapse(moves):
    assert collapsed(moves(COLLAPSE)) == COLLAPSED


def test_collapse_of_hot_cases_and_idempotence(moves, hot):
    assert collapsed(moves(COLLAPSE)) == COLLAPSED
    assert collapsed(lb.collapse(moves(COLLAPSE))) == COLLAPSED


def test_dwell_and_second_collapse(moves):
    table = [(1, "W", 0, 4), (1, "I", 4, 4.5), (1, "W", 4.5, 8), (1, "X", 8, 12), (1, "W", 12, None)]
    sweep = {r["min_dwell_h"]: r for r in lb.dwell_sweep(moves(table), {"w": TIER}, TIERS, (0, 1, 4)).collect()}
    # Without the short stay the two W rows become one, and the open W row is gone.
    assert sweep[0.0]["returned"] == 1 and sweep[0.0]["via_critical"] == 1
    assert sweep[1.0]["returned"] == 0 and sweep[1.0]["n_cases"] == 1
    assert sweep[4.0]["returned"] == 0
    assert lb.dwell(moves(table), 4).count() == 2 and lb.dwell(moves(table), 0).count() == 5


def test_restricted_and_structural_negatives(moves):
    table = [(1, "W", 0, 1), (1, "X", 1, 2), (2, "X", 0, 1), (2, "W", 1, 2), (3, "X", 0, 1), (4, "W", 0, None), (4, "X", 1, 2)]
    assert rows(lb.restricted(moves(table), TIER), "hadm_id") == [(1,)]
    assert rows(lb.structural_negatives(moves(table), TIER), "hadm_id") == [(2,), (4,)]


def test_discharge_rows_and_missing_cases_are_dropped(spark, moves):
    df = moves([(1, "W", 0, 1)]).unionByName(moves([(1, "X", 1, 2)], "discharge")).unionByName(moves([(None, "X", 1, 2)]))
    assert ev.usable(df.unionByName(moves([(5, "X", 1, 2)], None))).count() == 2


def test_gate_and_swap(spark):
    stored = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "hadm_id INT, y INT")
    fresh = spark.createDataFrame([(1, 0), (2, 0)], "hadm_id INT, y INT")
    assert rows(lb.label_gate(stored, fresh, "y")) == [(2, 1)]
    assert rows(lb.swap_label(stored, fresh, "y", "y"), "hadm_id", "y") == [(1, 0), (2, 0), (3, 0)]


def test_invariants_on_the_test_tables(spark):
    from caseflow.plans import pipeline as pl
    from caseflow.sources import mapping as m
    from tests.conftest import DATA

    frame = pl.frames(pl.Tables(spark, DATA)).collect()
    assert all(r["left_lat"] <= r["left_old"] for r in frame)
    assert all((r["route"] == "no_return") == (r["left_old"] == 0) for r in frame)
    onward = lb.onward_cases(pl.usable_moves(pl.Tables(spark, DATA)), m.TIER_B)
    assert onward.count() == sum(r["cohort"] == "SW" for r in frame)
    counts = {c: [sum(r[k] for r in frame if r["cohort"] == c) for k in ("left_old", "left_lat")] for c in ("ICU", "SW")}
    assert counts == {"ICU": [50, 44], "SW": [54, 49]}
