from collections import defaultdict

import pytest

from caseflow.llm import mixing
from caseflow.llm.mixing import Mix


def fill(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """The rule as stated: what is above goes back and is shared anew, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        unit = rest / sum(w[s] for s in free)
        above = {s for s in free if unit * w[s] > repeats * sizes[s]}
        if not above:
            return target | {s: unit * w[s] for s in free}
        for s in above:
            target[s] = float(repeats * sizes[s])
            rest -= target[s]
        free -= above
    return target


def table(n=400):
    return [(i, " ".join(["w"] * (i * 37 % 211)), ["a", "b", "é", None, "z", "Z"][i % 6 if i % 3 else 0]) for i in range(n)]


@pytest.mark.parametrize("mix", [Mix(blocks=16, depth=2), Mix(blocks=64, depth=3, weights=(1, 4), share=1.2)])
def test_targets_are_met(docs, mix):
    rows = table()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    documents, pieces = mixing.mixed(docs(rows), mix)
    found = documents.collect()
    assert len(found) == len(rows)
    want = fill(dict(sizes), mix.weights, mix.share)
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in found:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert {s: t for s, t in taken.items()} == {s: round(want[s]) for s in taken}
    per_shard = defaultdict(set)
    for p in pieces.collect():
        per_shard[p.shard].add(p.source)
    assert len(per_shard) == 1 << mix.depth
    again = sorted(map(tuple, mixing.mixed(docs(rows[::-1]), mix)[0].collect()))
    assert again == sorted(map(tuple, found))


def test_every_item_lies_in_one_shard(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 7), (None, 1), ("c", 0)], "source string, quota int")
    leaves = mixing.leaves(quotas, Mix(depth=3)).collect()
    items = sorted((r.source or "", i) for r in leaves for i in range(r.first, r.last + 1))
    assert items == [("", 1), *[("a", i) for i in range(1, 41)], *[("b", i) for i in range(1, 8)]]
    per_shard = defaultdict(int)
    for r in leaves:
        per_shard[r.shard] += r.last - r.first + 1
    assert set(per_shard.values()) == {6}


def test_odd_texts(docs, odd):
    documents, _ = mixing.mixed(docs([(i, t, "s" if i % 2 else None) for i, t in odd]), Mix(blocks=4, depth=1))
    found = documents.collect()
    assert len(found) == len(odd) and all(r.taken <= 2 * r.size for r in found)
    assert sum(r.taken for r in found) == pytest.approx(1.5 * sum(r.size for r in found), abs=2)
    for rows in ([], [(1, None)], [(1, " "), (2, "")]):
        documents, pieces = mixing.mixed(docs(rows), Mix(blocks=4, depth=1))
        assert documents.count() == len(rows) and pieces.count() == 0


def test_mixture_has_the_words_taken(docs):
    rows, mix = table(60), Mix(blocks=8, depth=1)
    taken = defaultdict(int)
    out = mixing.mixture(docs(rows), mix)
    assert out.columns == docs(rows).columns
    for r in out.collect():
        taken[r.doc_id] += len(r.text.split())
    assert {r.doc_id: r.taken for r in mixing.mixed(docs(rows), mix)[0].collect() if r.taken} == dict(taken)


def test_texts_of_one_id_and_size(docs):
    """Ids that are shared or missing: each text is drawn by itself, and reruns in another order agree."""
    rows = [(7 if i % 3 else None, f"text number {i} of one size", "st"[i % 2]) for i in range(40)] + [(7, "text number 1 of one size", "t")] * 2
    mix = Mix(blocks=4, depth=1, weights=(1, 3))
    use = lambda rows: sorted((str(r.doc_id), r.text) for r in mixing.mixture(docs(rows), mix).collect())
    first = use(rows)
    assert first == use(rows[::-1]) == use(sorted(rows, key=str))
    documents = mixing.mixed(docs(rows), mix)[0].collect()
    assert sum(r.taken for r in documents) == sum(len(t.split()) for _, t in first) and len(documents) == 42
