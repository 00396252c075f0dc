"""k nearest neighbours by Euclidean distance: all pairs in blocks, or through an index.

The exact form compares every query with every training vector, block by block, and says so.  The index
assigns each training vector to the nearest of about sqrt(n) centres; a query looks into the cells of the
nearest few centres only.  How few is measured: for a bounded sample of training vectors the true
neighbours are found exactly, and the number of cells is the least that holds the wanted share of them.

Both forms cut either side into blocks of bounded size, so a cell that holds most vectors, or draws most
queries, is spread over many tasks.  Only k candidates per query and block leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import durable

NEIGHBOURS = 5
BLOCK_ROWS = 8192
_CHUNK = 512
#: Pairs measured again at once, about; one query may have a block of them.
_PAIRS = 65_536
#: Groups that the vectors of a block are taken in to bound the k-th distance.
_GROUPS = 256
FOUND = "query_id BIGINT, neighbour_id BIGINT, distance DOUBLE"


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def _sliced(batches, size: int):
    """The rows of all batches in pieces of at most ``size``: what is made of a piece (a distance per centre, a copy per
    cell looked into) is many times its size."""
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def _block_of(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _blocks(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS)).cast("int")


def _search(k: int):
    """The k nearest of one block of training vectors for each query of one block."""

    def search(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        ids, near, far = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
        if len(queries) and len(train):
            t, t_id = _stack(train["vec"]), train["id"].to_numpy()
            q, q_id = _stack(queries["vec"]), queries["id"].to_numpy()
            squares = (t * t).sum(1)
            most = np.fmax.reduce(squares)
            wide, begin = np.column_stack([t, squares]).T.copy(), np.arange(0, len(t), max(1, len(t) // _GROUPS))
            for i in range(0, len(q), _CHUNK):
                own_q = q[i : i + _CHUNK]
                # The squared distance but for the query's own square, by one product.
                rough = np.column_stack([-2 * own_q, np.ones(len(own_q))]) @ wide
                least = np.fmin.reduceat(rough, begin, axis=1)
                # The k-th least of the groups' minima is no less than the k-th least of all.
                kth = np.partition(least, k - 1, axis=1)[:, k - 1] if len(begin) >= k else np.full(len(own_q), np.inf)
                # The product form is rounded; what it puts near the limit is measured again.
                close = rough <= (kth + 1e-12 * ((own_q * own_q).sum(1) + most))[:, None]
                ends = np.cumsum(np.count_nonzero(close, axis=1))
                for own in np.split(np.arange(len(kth)), np.nonzero(np.diff(ends // _PAIRS))[0] + 1):
                    row, maybe = np.nonzero(close[own])
                    row += i + own[0]
                    exact = np.sqrt(((t[maybe] - q[row]) ** 2).sum(1))
                    order = np.lexsort((t_id[maybe], exact, row))
                    row, maybe, exact = row[order], maybe[order], exact[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    ids.append(q_id[row[keep]])
                    near.append(t_id[maybe[keep]])
                    far.append(exact[keep])
        return pd.DataFrame({"query_id": np.concatenate(ids), "neighbour_id": np.concatenate(near), "distance": np.concatenate(far)})

    return search


def _joined(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """``cells``: (id, vec, cell) of every training vector, written down; ``probes``: how many cells a query looks into."""

    cells: DataFrame
    centres: np.ndarray
    probes: int

    def routed(self, queries: DataFrame) -> DataFrame:
        """(id, vec, cell): each query once for every cell it looks into."""
        centres, probes = self.centres, self.probes

        def route(batches):
            for pdf in _sliced(batches, _CHUNK):
                order = np.argsort(_distances(_stack(pdf["vec"]), centres), axis=1, kind="stable")[:, :probes]
                step = max(1, BLOCK_ROWS // order.shape[1])
                for at in range(0, len(pdf), step):
                    cells, own = order[at : at + step], pdf.iloc[at : at + step]
                    row = np.repeat(np.arange(len(own)), cells.shape[1])
                    yield pd.DataFrame({"id": own["id"].to_numpy()[row], "vec": own["vec"].to_numpy()[row], "cell": cells.ravel().astype("int32")})

        return queries.select("id", "vec").mapInPandas(route, "id BIGINT, vec ARRAY<DOUBLE>, cell INT")

    def nearest(self, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        """(query_id, neighbour_id, distance, rank) among the vectors of the cells looked into."""
        asked = durable(self.routed(queries))
        count = lambda df, n: df.groupBy("cell").agg(F.count(F.lit(1)).alias(n))
        sizes = durable(count(self.cells, "n_train").join(count(asked, "n_asked"), "cell"))  # one row a cell
        spread = lambda n: F.explode(F.sequence(F.lit(0), _blocks(F.col(n)) - 1))
        left = asked.join(sizes, "cell").withColumns({"qb": _block_of("id", _blocks(F.col("n_asked"))), "tb": spread("n_train")})
        right = self.cells.join(sizes, "cell").withColumn("tb", _block_of("id", _blocks(F.col("n_train")))).withColumn("qb", spread("n_asked"))
        return _joined(left.select("id", "vec", "cell", "qb", "tb"), right.select("id", "vec", "cell", "qb", "tb"), ["cell", "qb", "tb"], k)

    def pairs(self, queries: DataFrame) -> int:
        """How many pairs of vectors the index compares for these queries."""
        sizes = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return self.routed(queries).select("cell").join(sizes, "cell").agg(F.sum("n")).first()[0] or 0


def _cells(train: DataFrame, centres: np.ndarray) -> DataFrame:
    def assign(batches):
        for pdf in _sliced(batches, _CHUNK):
            yield pdf.assign(cell=_distances(_stack(pdf["vec"]), centres).argmin(1).astype("int32"))

    return durable(train.select("id", "vec").mapInPandas(assign, "id BIGINT, vec ARRAY<DOUBLE>, cell INT"))


def fit_index(train: DataFrame, k: int = NEIGHBOURS, recall: float = 0.95, centres: int | None = None, sample: int = 512, seed: int = 42) -> Index:
    """An index over every training vector (id, vec).

    Fitted on two bounded samples drawn by hash: ``centres`` vectors (about sqrt(n); 4096 at most unless
    given) and ``sample`` vectors whose true k neighbours are found exactly; ``probes`` is the least number of cells that
    holds ``recall`` of these.
    """
    train = durable(train.select("id", "vec"))
    n = train.count()
    drawn = lambda size, salt: train.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(size)
    some = drawn(centres or int(max(1, min(4096, n**0.5))), seed)
    points = _stack(some.toPandas()["vec"])
    cells = _cells(train, points)
    if n <= 1:
        return Index(cells, points, 1)
    asked = durable(drawn(sample, seed + 1))
    # One more neighbour than wanted, since a vector is its own nearest.
    found = nearest(train, asked, k + 1).filter("query_id <> neighbour_id").join(cells.select(F.col("id").alias("neighbour_id"), "cell"), "neighbour_id")
    hits = found.select("query_id", "cell").toPandas()  # at most sample * (k + 1) rows
    vectors = asked.toPandas()
    place = np.argsort(np.argsort(_distances(_stack(vectors["vec"]), points), axis=1, kind="stable"), axis=1)
    row = {i: r for r, i in enumerate(vectors["id"])}
    needed = np.sort(place[[row[i] for i in hits["query_id"]], hits["cell"]])
    return Index(cells, points, int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def nearest(train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, index: Index | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) from ``train`` (id, vec) and ``queries`` (id, vec).

    At equal distance the smaller id is nearer.  Without an index the answer is exact and every pair is
    compared; with one, only what lies in the cells looked into.
    """
    if index is not None:
        return index.nearest(queries, k)
    train, queries = train.select("id", "vec"), queries.select("id", "vec")
    n_train, n_asked = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (train, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumns({"qb": _block_of("id", F.lit(n_asked)), "tb": every(n_train)})
    right = train.withColumns({"tb": _block_of("id", F.lit(n_train)), "qb": every(n_asked)})
    return _joined(left, right, ["qb", "tb"], k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the true neighbours among those found."""
    keys = ["query_id", "neighbour_id"]
    return found.select(*keys).join(exact.select(*keys), keys, "left_semi").count() / max(1, exact.count())


def vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, score): share of positive labels among the neighbours; labels are (id, label)."""
    return (
        found.join(labels.withColumnRenamed("id", "neighbour_id"), "neighbour_id")
        .groupBy("query_id")
        .agg(F.avg(F.col("label").cast("double")).alias("score"))
    )
