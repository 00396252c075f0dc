"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks of vectors.  Every block pair is scored by one matrix
product.  Rounds of global score histograms narrow, for each query, the interval that holds its
k-th highest score: the first over the whole score range, each next one over the bin found before,
until a bin is one integer wide.  A last pass keeps what lies above that score and, of the ties on
it, the smallest ids that are still needed.

Nothing grows with the number of candidates but the number of block pairs.  A block counts only bins
from its own k-th score up, since the global one cannot be lower, so a pair sends at most ``k`` bins
a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import durable, record_batch

SCALE = 256
#: Up to this bound on the absolute score, products of doubles are exact integers.
EXACT_DOUBLE = 2**53


@dataclass(frozen=True)
class Search:
    k: int = 5
    bins: int = 4096
    query_block: int = 512
    block: int = 4096


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): floor(256 * x) of every component as whole doubles; vectors that are NULL, or hold
    NULL or non-finite components, are left out.  A row that is there twice is a candidate twice."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    # "NaN" is above every number; a NULL makes the whole test fail.
    fine = F.forall("e", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(fine).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * float(SCALE)).cast("double")).alias("v"), F.size("e").alias("dim")
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of at most ``size`` vectors of one length: dim, ids and values as bytes, largest absolute value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            group = held.pop(dim)
            ids, values = np.array([i for i, _ in group], "<i8"), np.array([v for _, v in group], "<f8")
            return record_batch(
                {"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary()),
                 "most": pa.array([float(np.abs(values).max(initial=0))], pa.float64())}
            )

        for batch in batches:
            flat, ends = batch.column("v").flatten().to_numpy(), np.cumsum([0, *batch.column("dim").to_pylist()])
            for j, i in enumerate(batch.column("vec_id").to_pylist()):
                dim = int(ends[j + 1] - ends[j])
                held.setdefault(dim, []).append((i, flat[ends[j] : ends[j + 1]]))
                if len(held[dim]) == size:
                    yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(pack, "dim int, ids binary, values binary, most double")


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], np.ndarray, np.ndarray]]:
    """The queries, candidate ids and scores of every block pair of one vector length."""
    for pair in batch.to_pylist():
        dim, asked = pair["dim"], pair["asked"]
        if pair["q_dim"] != dim:
            continue
        ids = np.frombuffer(pair["ids"], "<i8")
        q, c = np.array([a["v"] for a in asked], "<f8").reshape(len(asked), dim), np.frombuffer(pair["values"], "<f8").reshape(len(ids), dim)
        if float(np.abs(q).max(initial=0)) * pair["most"] * max(dim, 1) < EXACT_DOUBLE:
            yield asked, ids, (q @ c.T).astype(np.int64)
        else:
            yield asked, ids, q.astype(np.int64) @ c.astype(np.int64).T


def _longs(names: tuple[str, ...], rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * len(names)
    return record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _histogram(width: int, n_bins: int):
    """Counts in the bins of each query's interval, from the block's own k-th score up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for asked, ids, scores in _pairs(batch):
                for a, row in zip(asked, scores):
                    row = row[ids != a["query_id"]] - a["low"]
                    bins = row[(row >= 0) & (row < width * n_bins)] // width
                    if a["need"] and len(bins) > a["need"]:
                        bins = bins[bins >= np.partition(bins, len(bins) - a["need"])[len(bins) - a["need"]]]
                    value, n = np.unique(bins, return_counts=True)
                    out.append((np.full(len(value), a["query_id"]), value, n))
            yield _longs(("query_id", "bin", "n"), out)

    return count


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What scores above each query's k-th score, and of the ties on it the smallest ids still needed."""
    for batch in batches:
        out = []
        for asked, ids, scores in _pairs(batch):
            for a, row in zip(asked, scores):
                other = ids != a["query_id"]
                above, ties = np.flatnonzero(other & (row > a["low"])), np.flatnonzero(other & (row == a["low"]))
                if len(ties) > a["need"]:
                    ties = ties[np.argsort(ids[ties], kind="stable")[: a["need"]]]
                at = np.concatenate([above, ties])
                out.append((np.full(len(at), a["query_id"]), ids[at], row[at]))
        yield _longs(("query_id", "vec_id", "score"), out)


def top_k(vectors: DataFrame, is_query: Column, search: Search = Search(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` highest integer inner products.

    Candidates are all rows but those with the query's own id; fewer than k candidates give fewer rows.
    Ties go to the smaller id.  Only vectors of the query's length are compared.  A query id that is
    there twice asks once (with its smallest vector).  No rows give none.  Components must keep the
    scores within 64 bits.
    """
    k, n_bins = search.k, search.bins
    rows = durable(quantised(vectors, vec_id, embedding))
    candidates = durable(_blocks(rows, search.block))
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("f"))
    asked = durable(asked.select(F.col("vec_id").alias("query_id"), "f.v", "f.dim"))
    most = candidates.agg(F.max(F.col("most") * F.col("most") * F.col("dim"))).first()[0] or 0.0
    low, width = -int(most) - 1, 1
    while width * n_bins < 1 - 2 * low:
        width *= n_bins
    n_blocks = -(-asked.count() // search.query_block)
    # An interval's lower end, and how many of the k best are still to be found within it.
    state = asked.withColumns({"low": F.lit(low).cast("long"), "need": F.lit(k).cast("long"), "part": F.pmod(F.xxhash64("query_id"), F.lit(max(n_blocks, 1)))})

    def against(state: DataFrame) -> DataFrame:
        packed = state.groupBy("part", F.col("dim").alias("q_dim")).agg(F.collect_list(F.struct("query_id", "v", "low", "need")).alias("asked"))
        return candidates.crossJoin(packed.select("q_dim", "asked"))  # the stated queries against all rows, in blocks

    while True:
        counts = against(state).mapInArrow(_histogram(width, n_bins), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bin").desc()))
        reached = counts.withColumn("upto", upto).join(state.select("query_id", "need"), "query_id").filter("upto >= need")
        found = reached.groupBy("query_id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("hit"))
        # Without a hit there are fewer than k candidates: all of them lie above the lowest score.
        state = durable(
            state.join(found, "query_id", "left").select(
                "query_id", "v", "dim", "part",
                F.when(F.col("hit").isNotNull() & (F.col("need") > 0), F.col("low") + F.col("hit.bin") * width).otherwise(low).alias("low"),
                F.when(F.col("hit").isNotNull() & (F.col("need") > 0), F.col("need") - F.col("hit.above")).otherwise(0).alias("need"),
            )
        )
        if width == 1:
            break
        width //= n_bins
    chosen = against(state).mapInArrow(_select, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
