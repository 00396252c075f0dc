"""A table is committed only if it passes its checks, and the checks ride along with the write.

``DataFrame.observe`` counts NULLs, rows and repeated ids while the rows are written; nothing is read
twice.  Afterwards a verdict row is stored beside the data.  Readers look at the verdict first: data
without one, or with problems, is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import features as ft

_REPEAT = "__repeat"
VERDICT = "n_rows BIGINT, n_repeated BIGINT, problems ARRAY<STRING>"


class Refused(ValueError):
    """The table fails its checks; it is not committed, or not read."""


def problems_of(counts: dict[str, int], layout: list[str], allowed_nulls: tuple[str, ...] = ()) -> list[str]:
    """What a written table fails by: layout faults, NULLs, repeated ids, no rows."""
    found = list(layout)
    found += [f"NULL in {c.removeprefix('null_')}: {n}" for c, n in sorted(counts.items()) if c.startswith("null_") and n and c.removeprefix("null_") not in allowed_nulls]
    found += [f"repeated ids: {counts['n_repeated']}"] if counts["n_repeated"] else []
    found += ["no rows"] if not counts["n_rows"] else []
    return found


def write_checked(matrix: DataFrame, folder: str, label: str, keys: list[str] = [ft.KEY], groups=ft.GROUPS, allowed_nulls: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> list[str]:
    """Write a feature matrix and commit it if its columns are those of the groups, no cell is NULL and no id is there twice.

    Returns the problems; with any, ``folder`` holds no commit.  ``extra`` names further key columns of the layout.
    """
    layout = ft.check_matrix(matrix.drop(*extra), label, groups)
    # Rows of one id lie together after the joins that made the matrix, so this window adds no exchange there.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    numbered = matrix.withColumn(_REPEAT, place > 1)
    seen = Observation("matrix gate")
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(_REPEAT).alias("n_repeated")]
    counts += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in matrix.columns]
    numbered.observe(seen, *counts).drop(_REPEAT).write.mode("errorifexists").parquet(f"{folder}/rows")
    problems = problems_of(seen.get, layout, allowed_nulls)
    verdict = [(seen.get["n_rows"], seen.get["n_repeated"], problems)]
    matrix.sparkSession.createDataFrame(verdict, VERDICT).coalesce(1).write.mode("errorifexists").json(f"{folder}/verdict")
    return problems


def read_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The committed rows, or an error that says what they fail by."""
    verdict = spark.read.schema(VERDICT).json(f"{folder}/verdict").first()
    if verdict is None or verdict["problems"]:
        raise Refused(f"{folder}: {'; '.join(verdict['problems']) if verdict else 'no verdict'}")
    return spark.read.parquet(f"{folder}/rows")
