"""Every registered query with SQL against that SQL on the small test tables."""

import importlib

import pandas as pd
import pytest

from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
entry = importlib.import_module("__spark_entry__")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> tuple[list, list]:
    """Rows sorted by their exact values (columns by name), and their decimal values as (column, value) in the same order."""
    names = sorted(df.columns)

    def split(row):
        exact, decimals = [], []
        for c, v in zip(names, row):
            if v is None or v is pd.NaT or v is pd.NA or v != v:
                exact.append("")
            elif isinstance(v, float) and not float(v).is_integer():
                decimals.append((c, float(v)))
                exact.append("~")
            else:
                exact.append(str(int(v)) if isinstance(v, float) else str(v))
        return exact, decimals

    rows = sorted(split(row) for row in df[names].astype(object).itertuples(index=False, name=None))
    return [e for e, _ in rows], [x for _, d in rows for x in d]


def last_digits(decimals: list) -> dict[str, float]:
    """One unit of the last digit that a column shows."""
    shown: dict[str, int] = {}
    for c, v in decimals:
        shown[c] = max(shown.get(c, 0), len(f"{v:.12f}".rstrip("0").split(".")[1]))
    return {c: 10.0**-n for c, n in shown.items()}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, engine, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = engine.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    (exact, decimals), (want_exact, want_decimals) = canonical(got), canonical(want)
    assert exact == want_exact
    # The engines may round a tie in the last shown digit differently.
    unit = last_digits(want_decimals)
    assert [c for c, _ in decimals] == [c for c, _ in want_decimals]
    far = [(c, x, y) for (c, x), (_, y) in zip(decimals, want_decimals) if abs(x - y) > 1.01 * unit[c] + 1e-9 * abs(y)]
    assert not far, far[:5]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["cohort", "hadm_id", "label"]


def test_result_table(spark):
    rows = entry.queries()["model_scores"](spark, DATA).collect()
    assert len(rows) == 2 * 3 * 4 + 2 * 2
    assert all(0 <= r["AUROC"] <= 1 and r["n_features"] > 32 and len(r["split_id"]) == 16 for r in rows)
