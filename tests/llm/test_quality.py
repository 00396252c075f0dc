import random
import zlib

import numpy as np
import pytest

from caseflow.llm import quality
from caseflow.llm.quality import Fitting


def corpus(n=300):
    r = random.Random(8)
    words = ["the", "of", "weather", "reading", "garden", "slow", "river", "and", "light", "stone"]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        lines = []
        for _ in range(r.randrange(1, 6)):
            said = r.choices(words, k=r.randrange(5, 30))
            lines.append(" ".join(said).capitalize() + "." if good else r.choice([" ".join(w.upper() + "!!" for w in said), " ".join(said[:1] * 20), " ".join(w + "###" for w in said)]))
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0, "x"))
    return rows, labels


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    model = quality.fit(docs(rows), labelled(spark, labels))
    found = quality.scored(docs(rows), model).collect()
    want = {i: q for i, q, *_ in labels}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    kept = quality.without_rejected(docs(rows), model)
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.predicted)


def test_held_out_labels_are_never_read(spark, docs):
    rows, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x) for i, q, t, x in labels]
    a, b = (quality.fit(docs(rows), labelled(spark, n), Fitting(rounds=20)) for n in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def test_marginals_against_all_labellings():
    r = np.random.default_rng(1)
    scores, chain, document = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2])
    good, pairs = quality._chances(scores, document, chain)
    for d in range(3):
        at = np.flatnonzero(document == d)
        weight, share, both = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for code in range(1 << len(at)):
            y = [code >> i & 1 for i in range(len(at))]
            w = np.exp(sum((y[i] - 0.5) * scores[at[i]] for i in range(len(at))) + sum(chain[y[i - 1], y[i]] for i in range(1, len(at))))
            weight += w
            share += w * np.array(y)
            for i in range(1, len(at)):
                both[i, y[i - 1], y[i]] += w
        assert good[at] == pytest.approx(share / weight) and pairs[at] == pytest.approx(both / weight)


def test_odd_texts_and_labels(spark, docs, odd):
    rows, labels = corpus(80)
    model = quality.fit(docs(rows), labelled(spark, labels + [(1, None, None, None), (None, 1, 1, "")]), Fitting(rounds=20))
    found = quality.scored(docs(odd), model).collect()
    assert len(found) == len(odd) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2, 10)} == {model.base}
    assert quality.scored(docs([]), model).count() == 0 and quality.without_rejected(docs([]), model).count() == 0
    flat = quality.fit(docs(rows), labelled(spark, []))
    assert {r.score for r in quality.scored(docs(odd), flat).collect()} == {0.5}
