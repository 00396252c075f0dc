import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import negatives
from caseflow.llm.negatives import Mining


def brute(rows, mining):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sorted({i for i, _, _ in fine if i % 10 == 0}):
        own, vec = min((lab, v) for i, lab, v in fine if i == a)
        others = [(-dot(vec, v), i, lab) for i, lab, v in fine if i != a and len(v) == len(vec)]
        for s, p, _ in sorted(o for o in others if o[2] == own)[: mining.positives]:
            close = sorted((n, i) for n, i, lab in others if lab != own and mining.low * -s <= 100 * -n <= mining.high * -s)
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(close[: mining.negatives], 1)]
    return sorted(out)


def table(n, dim, spread, labels=3, seed=4):
    r = random.Random(seed)
    return [(i, [r.uniform(-spread / 3, spread) for _ in range(dim)], r.randrange(labels)) for i in range(n)]


CASES = {
    "plain": table(150, 8, 1),
    "ties": [(i, [float(i % 3), 0.5], i % 2) for i in range(120)],
    "one label": table(60, 3, 1, labels=1),
    "large": table(60, 5, 2e5),
    "negative scores": [(i, [float(-1) ** i, 0.25 * i], i % 2) for i in range(40)],
    "odd": table(60, 3, 1) + [(100, None, 1), (110, [1.0, None, 1.0], 1), (120, [1.0, 1.0, 1.0], None), (130, [float("nan"), 1.0, 1.0], 0), (140, [float("-inf"), 1.0, 1.0], 0), (150, [1.0, 2.0], 0), (151, [1.0, 2.0], 0), (152, [1.0, 1.9], 2), (160, [], 1), (161, [], 1), (None, [1.0, 1.0, 1.0], 1), (0, [0.5, 0.5, 0.5], 1), (7, [0.5, 0.5, 0.5], 1)],
    "none": [],
}


SMALL = Mining(positives=3, negatives=2, low=60, high=95, anchor_block=4, block=9)


@pytest.mark.parametrize("name, mining", [("plain", Mining()), ("odd", Mining()), *[(name, SMALL) for name in CASES]])
def test_against_brute_force(spark, name, mining):
    rows = spark.createDataFrame([(*r, "x", 1.0) for r in CASES[name]], "vec_id long, embedding array<double>, label int, dim string, score double")
    found = negatives.hard_negatives(rows, F.col("vec_id") % 10 == 0, mining).collect()
    assert sorted(map(tuple, found)) == brute(CASES[name], mining)


@pytest.mark.parametrize("dim, most", [(1, 5), (64, 300), (64, 2**24), (5000, 1000), (9000, 2**20), (3, 2**30)])
def test_residue_products_are_exact(dim, most):
    r = np.random.default_rng(dim)
    a, b = (r.integers(-most, most, (n, dim), endpoint=True) for n in (7, 11))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a])
    assert (negatives.exact_products(a, b) == want).all()
    bound = most * most * dim
    primes = negatives.moduli(bound, dim)
    assert math.prod(primes) > 2 * bound and all(min(dim, negatives.DEPTH) * ((p - 1) // 2) ** 2 <= negatives.EXACT_FLOAT for p in primes)
