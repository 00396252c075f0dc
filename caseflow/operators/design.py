"""Model inputs as one sparse vector per case, cut into feature groups by index ranges.

Numeric columns come first, then one block per categorical column (an entry per value, none dropped),
then the n-grams.  Every entry has its index from a dictionary table that stays distributed; a case's
entries are folded into one sparse vector.  The driver knows where a block begins and ends, and never
the names in it, so a block may have any number of entries.

A condition, an ablation or a single group is a slice of the same vectors: they are scaled and written
down once.  Scaling divides by the deviation of the training rows and does not centre: a vector stays sparse, and
neither a linear model with a free intercept nor trees nor distances change by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import ElementwiseProduct, VectorSlicer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from caseflow.operators.ordered import attach, positions
from caseflow.session import durable

BAG = "bow"
_VECTOR = StructType([StructField("v", VectorUDT())])
_PLAIN = "v STRUCT<size: INT, indices: ARRAY<INT>, values: ARRAY<DOUBLE>>"


def sparse(size: Column, indices: Column, values: Column) -> Column:
    """A Spark ML vector from ascending indices and their values, made without leaving the JVM."""
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"),
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


def entries_of(vector: str) -> Column:
    """(size, indices, values) of a sparse Spark ML vector, as plain SQL values."""
    return F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), _PLAIN)["v"]


def entries(vector: str, at: str = "i", value: str = "v") -> list[Column]:
    """The places and values of a Spark ML vector, sparse or dense, as two arrays; read as they are stored, without a call per row."""
    own = F.unwrap_udt(F.col(vector))
    every = F.when(F.size(own["values"]) > 0, F.sequence(F.lit(0), F.size(own["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return [F.coalesce(own["indices"], every).alias(at), own["values"].alias(value)]


def dense(pdf: pd.DataFrame, size: int, kind=np.float64) -> np.ndarray:
    """A row per vector of the columns of ``entries``."""
    out = np.zeros((len(pdf), size), kind)
    if len(pdf):
        row = np.repeat(np.arange(len(pdf)), [len(i) for i in pdf["i"]])
        out[row, np.concatenate(pdf["i"].to_list()).astype(np.int64)] = np.concatenate(pdf["v"].to_list())
    return out


def numbered(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each distinct name with its 0-based place within the key: a dictionary that stays distributed."""
    return positions(names.select(*keys, name).distinct(), keys, [name], "at").withColumn("at", F.col("at") - 1)


def folded(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, indices, values) from rows (keys, index, value); no more entries a row than the dictionary has."""
    pairs = F.sort_array(F.collect_list(F.struct("index", F.col("value").cast("double").alias("value"))))
    return entries.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.col("p.index").alias("indices"), F.col("p.value").alias("values"))


def bag_vectors(ids: DataFrame, counts: DataFrame, vocabulary: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, hadm_id, bag): counts of the fitted n-grams of every case as one sparse vector.

    ``counts`` is (by, hadm_id, ngram, n), ``vocabulary`` has (by, ngram).  Indices follow the n-grams in ascending order.
    A case without any has an empty vector of the same size.
    """
    keys = [*by, "hadm_id"]
    words = durable(numbered(vocabulary, by or [], "ngram")) if by else durable(numbered(vocabulary.withColumn("__all", F.lit(0)), ["__all"], "ngram").drop("__all"))
    rows = counts.join(words, [*by, "ngram"]).select(*keys, F.col("at").alias("index"), F.col("n").alias("value"))
    cases = ids.select(*keys).join(folded(rows, keys), keys, "left")
    if by:
        cases = attach(cases, words.groupBy(*by).agg(F.count(F.lit(1)).alias("size")), by)
        size = F.coalesce("size", F.lit(0))
    else:
        size = F.lit(words.count())
    none = F.array()
    return cases.select(*keys, sparse(size, F.coalesce("indices", none), F.coalesce("values", none)).alias("bag"))


@dataclass(frozen=True)
class View:
    """Training, validation and test rows (hadm_id, label, weight, features) of one choice of columns."""

    rows: DataFrame
    size: int

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("part") == name).drop("part")

    @cached_property
    def train(self) -> DataFrame:
        return self.part("train")

    @cached_property
    def test(self) -> DataFrame:
        return self.part("test")


@dataclass(frozen=True)
class Design:
    """``rows``: (hadm_id, label, part, weight, features), written down; ``blocks``: column -> index range in ``features``."""

    rows: DataFrame
    blocks: dict[str, tuple[int, int]]

    def indices(self, columns: list[str] | tuple[str, ...]) -> list[int]:
        """Where the chosen columns lie, in that order."""
        ranges = sorted(self.blocks[c] for c in columns)
        return [i for start, stop in ranges for i in range(start, stop)]

    def view(self, columns: list[str] | tuple[str, ...]) -> View:
        """The chosen columns, in the order they lie in."""
        indices = self.indices(columns)
        if len(indices) == max((stop for _, stop in self.blocks.values()), default=0):
            return View(self.rows, len(indices))
        slicer = VectorSlicer(inputCol="features", outputCol="__sliced", indices=indices)
        rows = slicer.transform(self.rows).drop("features").withColumnRenamed("__sliced", "features")
        return View(rows, len(indices))


def _blocks(numeric: list[str], sizes: dict[str, int], others: list[str]) -> dict[str, tuple[int, int]]:
    blocks = {c: (i, i + 1) for i, c in enumerate(numeric)}
    at = len(numeric)
    for c in others:
        blocks[c] = (at, at + sizes.get(c, 0))
        at += sizes.get(c, 0)
    return blocks


def design(matrix: DataFrame, split: DataFrame, label: str, columns: list[str], categorical: list[str], bag: tuple[DataFrame, DataFrame] | None = None) -> Design:
    """Fold the columns of a matrix (and n-gram ``bag`` = counts and vocabulary) of one cohort into scaled vectors.

    Category values are those of the whole cohort; scale and class weights come from the training rows.  A
    NULL number counts as 0, a NULL category has no entry.  Cases outside the split are left out.
    """
    named = [c for c in columns if c in categorical]
    numeric = [c for c in columns if c not in categorical]
    parts = split.select("hadm_id", "part")
    chosen = durable(matrix.select("hadm_id", F.col(label).cast("int").alias("label"), *columns))
    tall = [(chosen.select("hadm_id", *[F.col(c).cast("string") for c in named]).unpivot(["hadm_id"], named, "column", "name").filter("name IS NOT NULL").withColumn("value", F.lit(1)), None)] if named else []
    if bag is not None:
        counts, vocabulary = (df.withColumnRenamed("ngram", "name").withColumn("column", F.lit(BAG)) for df in bag)
        tall.append((counts.select("hadm_id", "column", "name", F.col("n").alias("value")), vocabulary))
    # n_gram entries outside the fitted vocabulary find no index and fall away in the join.
    names = [(rows if words is None else words).select("column", "name") for rows, words in tall]
    raw = chosen.join(parts, "hadm_id")
    fixed = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]).cast("array<double>")
    sizes: dict[str, int] = {}
    indices, values = F.sequence(F.lit(0), F.lit(len(numeric) - 1)) if numeric else F.array().cast("array<int>"), fixed
    if tall:
        union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
        words = durable(numbered(union(names), ["column"], "name"))
        sizes = {r["column"]: r["n"] for r in words.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
    blocks = _blocks(numeric, sizes, [*named, *([BAG] if bag is not None else [])])
    if tall:
        start = F.element_at(F.create_map(*[F.lit(x) for c in [*named, BAG] if c in blocks for x in (c, blocks[c][0])]), F.col("column"))
        found = union([rows for rows, _ in tall]).join(words, ["column", "name"]).select("hadm_id", (start + F.col("at")).cast("int").alias("index"), "value")
        raw = raw.join(folded(found, ["hadm_id"]), "hadm_id", "left")
        none = F.array().cast("array<int>")
        indices, values = F.concat(indices, F.coalesce("indices", none)), F.concat(values, F.coalesce("values", none.cast("array<double>")))
    size = max((stop for _, stop in blocks.values()), default=0)
    raw = durable(raw.select("hadm_id", "label", "part", sparse(F.lit(size), indices, values).alias("raw")))
    return Design(durable(_weighted(_scaled(raw, size))), blocks)


def _scaled(raw: DataFrame, size: int) -> DataFrame:
    found = raw.filter("part = 'train'").agg(Summarizer.metrics("variance", "count").summary(F.col("raw")).alias("s")).first()["s"]
    n = found["count"]
    # Population deviation; an entry that is constant in the training rows tells nothing and is set to 0.
    factor = [1.0 / (v * (n - 1) / n) ** 0.5 if v > 0 else 0.0 for v in found["variance"]] if n > 1 else [0.0] * size
    return ElementwiseProduct(scalingVec=Vectors.dense(factor), inputCol="raw", outputCol="features").transform(raw).drop("raw")


def _weighted(rows: DataFrame) -> DataFrame:
    """Balanced class weights of the training rows: n / (2 n_class)."""
    n, pos = rows.filter("part = 'train'").agg(F.count("label"), F.count_if(F.col("label") == 1)).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(n - pos, 1)))
    return rows.withColumn("weight", weight)
