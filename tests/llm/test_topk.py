import math
import random

import pytest
from pyspark.sql import functions as F

from caseflow.llm import topk
from caseflow.llm.topk import Search


def brute(rows, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 50 == 0}):
        own = min(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q and len(v) == len(own))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def vectors(n, dim, spread):
    r = random.Random(9)
    return [(i, [r.uniform(-spread, spread) for _ in range(dim)]) for i in range(n)]


CASES = {
    "plain": vectors(400, 8, 1),
    "ties": [(i, [float(i % 3), 0.5]) for i in range(300)],
    "one vector": [(i, [0.25, -1.0]) for i in range(300)],
    "few": vectors(4, 3, 1),
    "large": vectors(120, 4, 3e5),
    "odd": vectors(120, 3, 1) + [(200, None), (250, [1.0, None, 2.0]), (300, [float("nan"), 1.0, 1.0]), (301, [float("inf"), 1.0, 1.0]), (350, [1.0, 2.0]), (351, []), (400, []), (None, [1.0, 1.0, 1.0]), (0, [2.0, 2.0, 2.0]), (7, [5.0, 5.0, 5.0])],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("search", [Search(), Search(k=7, bins=16, query_block=3, block=11)])
def test_against_brute_force(spark, name, search):
    table = spark.createDataFrame([(i, v, "l", "x") for i, v in CASES[name]], "vec_id long, embedding array<double>, label string, low string")
    found = topk.top_k(table, F.col("vec_id") % 50 == 0, search).collect()
    assert sorted(map(tuple, found)) == brute(CASES[name], search.k)
