import numpy as np
import pytest

from caseflow.operators import neighbours as nb


def brute(train, queries, k):
    out = {}
    for q, v in queries.items():
        d = sorted((float(np.sqrt(((np.array(v) - np.array(t)) ** 2).sum())), i) for i, t in train.items())
        out[q] = [i for _, i in d[:k]]
    return out


def frame(spark, d):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in d.items()], "id BIGINT, vec ARRAY<DOUBLE>")


def clustered():
    rng = np.random.default_rng(0)
    # A third of the training vectors are copies of one point; another part forms two clusters.
    train = {i: [1.0, 1.0, 1.0] for i in range(30)}
    train |= {i: list(rng.normal(c, 0.3, 3)) for c in (0, 5) for i in range(100 + 10 * c, 130 + 10 * c)}
    return train, {1000 + i: list(rng.normal(2, 2, 3)) for i in range(25)} | {2000: [1.0, 1.0, 1.0]}


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbour_id"])
    return out


@pytest.mark.parametrize("block, k", [(8192, 5), (7, 3), (5, 5)])
def test_exact(spark, monkeypatch, block, k):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    train, queries = clustered()
    assert lists(nb.nearest(frame(spark, train), frame(spark, queries), k)) == brute(train, queries, k)


@pytest.mark.parametrize("block", [8192, 6])
def test_index_with_all_probes_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    train, queries = clustered()
    index = nb.fit_index(frame(spark, train), 5, recall=1.0, centres=6, sample=90)
    assert index.cells.count() == len(train)
    every = nb.Index(index.cells, index.centres, len(index.centres))
    assert lists(nb.nearest(frame(spark, train), frame(spark, queries), 5, every)) == brute(train, queries, 5)
    assert every.pairs(frame(spark, queries)) == len(train) * len(queries)


def test_index_finds_most_in_few_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (40, 8))
    make = lambda n, at: {at + i: list(centres[rng.integers(40)] + rng.normal(0, 1, 8)) for i in range(n)}
    train, queries = make(3000, 0), make(300, 10_000)
    left, right = frame(spark, train), frame(spark, queries)
    index = nb.fit_index(left, 5, sample=200)
    recall = nb.recall_of(nb.nearest(left, right, 5, index), nb.nearest(left, right, 5))
    assert recall >= 0.9 and index.pairs(right) < 0.35 * len(train) * len(queries)


def test_fewer_vectors_than_neighbours(spark):
    few = frame(spark, {1: [0.0], 2: [1.0]})
    found = nb.nearest(few, few, 5)
    assert found.count() == 4
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id BIGINT, label INT")
    assert {r["score"] for r in nb.vote(found, labels).collect()} == {0.5}
    assert nb.nearest(few.limit(0), few).count() == 0
    assert nb.nearest(few, few, 5, nb.fit_index(few)).count() in (2, 4)


def test_routed_queries_leave_in_bounded_pieces(spark, monkeypatch):
    """A batch of queries times the cells each looks into was one piece, which grows with the number of cells."""
    rng = np.random.default_rng(2)
    queries = frame(spark, {i: list(rng.normal(0, 1, 4)) for i in range(300)}).coalesce(1)
    centres, sizes = rng.normal(0, 1, (50, 4)), []
    index = nb.Index(queries, centres, 40)
    whole = sorted(tuple(r) for r in index.routed(queries).select("id", "cell").collect())
    assert len(whole) == 300 * 40

    class Rows:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInPandas(self, route, schema):
            pdf = queries.toPandas()
            sizes.extend(len(piece) for piece in route([pdf, pdf.iloc[:0]]))

    monkeypatch.setattr(nb, "BLOCK_ROWS", 1000)
    index.routed(Rows())
    assert sum(sizes) == 300 * 40 and max(sizes) <= 1000
