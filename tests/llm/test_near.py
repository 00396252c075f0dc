import random

import numpy as np

from caseflow.llm import near
from caseflow.llm.components import components
from caseflow.llm.near import Near
from caseflow.llm.shingles import shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


def corpus():
    """Groups whose members differ from each other, not only from the first; chains; short texts."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(6):
        base = r.choices(words, k=r.choice([8, 40, 120, 300]))
        for _ in range(12):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((i, " ".join(text)))
            i += 1
    chain = r.choices(words, k=200)
    for _ in range(10):
        chain = chain[3:] + r.choices(words, k=3)
        rows.append((i, "\n".join(chain)))
        i += 1
    r.shuffle(rows)
    return rows


def test_against_all_pairs(docs):
    rows = corpus()
    assert sorted(map(tuple, near.near_classes(docs(rows)).collect())) == brute(rows)


def test_small_blocks_and_shares(docs):
    rows = corpus()
    assert sorted(map(tuple, near.near_classes(docs(rows), Near(share=2, block=3, filter_bits=1 << 15)).collect())) == brute(rows)


def test_odd_texts(docs, odd):
    assert sorted(map(tuple, near.near_classes(docs(odd)).collect())) == brute(odd)
    assert near.near_classes(docs([])).count() == 0
    assert near.near_classes(docs([(1, None), (2, "")])).count() == 2


def test_sets_match_plain_words():
    texts = [b"a b c d e f", b"A\tb\x0bc  d e\nf", b"", b"  ", b"one two", b"x" * 500 + b" y" * 9, "é ü ß a b c".encode()]
    found = list(shingle_sets(iter(texts)))
    assert [len(f) for f in found] == [len(shingles(t.decode())) for t in texts]
    assert np.array_equal(found[0], found[1])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)], "a long, b long")
    assert {r.node: r.label for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components(links.filter("a < 0")).count() == 0


def test_posterior_bounds_grow():
    needed = near.least_matches(Near())
    assert all(a < b for a, b in zip(needed, needed[1:])) and needed[-1] > 0.6 * 192


def test_stage_keeps_one_of_each(docs):
    rows = corpus()
    left = near.without_near_copies(docs(rows + rows[:3]))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, _, kept in brute(rows) if kept)


def test_stage_tells_texts_of_one_id_apart(docs):
    r = random.Random(8)
    text = lambda: r.choices([f"w{i}" for i in range(900)], k=120)
    a, b, c, d, e, f = (text() for _ in range(6))
    changed = lambda t: " ".join(t[:60] + ["new"] + t[61:])
    a2, d2 = changed(a), changed(d)
    a, b, c, d, e, f = map(" ".join, (a, b, c, d, e, f))
    rows = [(5, a), (7, a2), (7, b), (7, b), (9, d), (9, d2), (4, e), (4, None), (3, f), (3, f + " "), (None, c), (None, e), (None, b), (None, b), (None, None)]
    for given in (rows, rows[::-1]):
        left = [(x.doc_id, x.text) for x in near.without_near_copies(docs(given)).collect()]
        held = [x for x in left if x[0] not in (9, 3)]
        assert sorted(map(str, held)) == sorted(map(str, [(5, a), (7, b), (4, e), (4, None), (None, c), (None, e), (None, b), (None, None)]))
        assert len([x for x in left if x[0] == 9]) == 1 and len([x for x in left if x[0] == 3]) == 1
        classes = sorted(map(tuple, near.near_classes(docs(given).filter("doc_id in (5, 7)")).select("doc_id", "component_id").collect()))
        assert classes == [(5, 5), (7, 5), (7, 7), (7, 7)]
