import random

import numpy as np

from caseflow.llm import repeats
from caseflow.llm.repeats import Repeats


def brute(rows, length=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        out.add((i, len(b), int(gone.sum()), bytes(c for c, g in zip(b, gone) if not g)))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choices("abcdefgh ü\n", k=n))
    shared = [noise(r.choice([49, 50, 51, 60, 90, 200, 700])) for _ in range(12)]
    rows = []
    for i in range(60):
        text = noise(r.randrange(0, 60))
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) - 40))
            text += s[a : r.randrange(a, len(s)) + 1] if r.random() < 0.5 else s
            text += noise(r.randrange(0, 50))
        rows.append((i, text))
    rows += [(60, rows[3][1]), (61, rows[3][1] + "x"), (62, "ab" * 120), (63, "ab" * 90), (64, "z" * 300), (65, "z" * 49), (66, "z" * 50)]
    r.shuffle(rows)
    return rows


def result(found):
    return {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in found.collect()}


def test_against_all_windows(docs):
    rows = corpus()
    found = repeats.without_repeats(docs(rows))
    assert result(found) == brute(rows)
    for r in found.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_hot_seeds_and_small_parts(docs):
    rows = corpus(5)
    for settings in (Repeats(hot=2), Repeats(least_parts=2, bits=1 << 15), Repeats(length=30)):
        assert result(repeats.without_repeats(docs(rows), settings)) == brute(rows, settings.length)


def periodic(seed=9):
    r = random.Random(seed)
    rows = []
    for i in range(70):
        text = ""
        for _ in range(r.randrange(1, 5)):
            unit = r.choice(["-", " ", "ab", "ab", "-=", "abc", "x" * 14 + "y", "0123456789abcdef", "z" * 7 + "q" * 6])
            run = (unit * 200)[r.randrange(len(unit)) :][: r.choice([40, 49, 50, 51, 64, 65, 66, 80, 81, 97, 180])]
            text += run + r.choice(["", "!", "end of a line\n", "-", "ab"])
        rows.append((i, text))
    r.shuffle(rows)
    return rows


def test_runs_of_a_short_period(docs):
    for rows, settings in ((periodic(), Repeats()), (periodic(4), Repeats(hot=2)), (periodic(5), Repeats(length=30, least_parts=2))):
        assert result(repeats.without_repeats(docs(rows), settings)) == brute(rows, settings.length)


def test_long_runs_are_few_records(docs):
    blank = repeats.Sampled(b"x" + b" " * 100_000 + b"y", 50)
    assert len(blank.places) < 200
    rows = [(1, " " * 70_000), (2, "a" + " " * 150_000 + "b" * 60), (3, "b" * 49), (4, " " * 49 + "-" * 100)]
    found = {r.doc_id: (r.n_removed, [(s.start, s.stop) for s in r.spans]) for r in repeats.without_repeats(docs(rows)).collect()}
    assert found == {1: (0, []), 2: (150_000, [(1, 150_001)]), 3: (0, []), 4: (0, [])}


def test_odd_texts(docs, odd):
    odd = [(i, t[:6000] if t else t) for i, t in odd]
    assert result(repeats.without_repeats(docs(odd))) == brute(odd)
    assert repeats.without_repeats(docs([])).count() == 0


def test_intervals_of_the_prefix_tree():
    assert sorted(repeats.intervals([0, 3, 1, 2, 2, 0])) == sorted([(3, 0, 1), (2, 2, 4), (1, 0, 4), (0, 0, 5)])
    assert list(repeats.intervals([0])) == []


def test_repeats_are_maximal():
    """Every group of suffixes that agree to the left and right, and nothing else, by comparing all of them."""
    r = random.Random(7)
    for _ in range(30):
        n = r.randrange(2, 9)
        left = np.array([[r.choice(b"ab") for _ in range(6)] for _ in range(n)], np.uint8)
        right = np.array([[1] * repeats.SEED + [r.choice(b"ab") for _ in range(6)] for _ in range(n)], np.uint8)
        pairs = {(left[i].tobytes(), right[i].tobytes()): i for i in range(n)}
        keep = sorted(pairs.values())
        left, right = left[keep], right[keep]
        n, length = len(keep), repeats.SEED + 6
        sizes_l, sizes_r = np.full(n, 6), np.full(n, repeats.SEED + 6)
        head = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        want = set()
        for i in range(n):
            for j in range(i):
                a, f = head(left[i], left[j]), head(right[i], right[j])
                if a + f >= length:
                    group = frozenset(k for k in range(n) if head(left[k], left[i]) >= a and head(right[k], right[i]) >= f)
                    want.add((a, f, group))
        found = {(a, f, frozenset(m.tolist())) for a, f, m in repeats.maximal_repeats(np.zeros(n, int), left, sizes_l, right, sizes_r, length)}
        assert found == want


def all_maximal(rows, length, periods=15):
    """Every maximal repeat that has no short period, with all its places, by growing strings from single places."""
    text = {i: (t or "").encode() for i, t in rows}
    places = {}
    for i, b in text.items():
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((i, p))
    left = lambda i, p: text[i][p - 1] if p else (i, "start")
    right = lambda i, q: text[i][q] if q < len(text[i]) else (i, "end")
    out, size = set(), length
    while places:
        longer = {}
        for w, at in places.items():
            if len(at) < 2:
                continue
            several = len({left(i, p) for i, p in at}) > 1 and len({right(i, p + size) for i, p in at}) > 1
            if several and all(w[:-k] != w[k:] for k in range(1, periods + 1)):
                out |= {(w, i, p) for i, p in at}
            for i, p in at:
                if p + size < len(text[i]):
                    longer.setdefault(text[i][p : p + size + 1], []).append((i, p))
        places, size = longer, size + 1
    return out


def test_repeat_groups_against_all_substrings(docs):
    for rows, length in ((corpus(), 50), (corpus(8)[:30] + periodic()[:6], 50), (corpus(11)[:30], 30)):
        rows = [(n, t) for n, (_, t) in enumerate(rows)]
        text = {i: t.encode() for i, t in rows}
        settings = Repeats(length=length, least_parts=3, bits=1 << 20)
        found = repeats.repeat_groups(docs(rows), settings).collect()
        maximal = [r for r in found if r.kind == "maximal"]
        got = [(text[r.doc_id][r.start : r.stop], r.doc_id, r.start) for r in maximal]
        assert len(set(got)) == len(got) and set(got) == all_maximal(rows, length, repeats.periods(length))
        assert all(r.length == r.stop - r.start for r in maximal)
        names = {(r.group, text[r.doc_id][r.start : r.stop]) for r in maximal}
        assert len(names) == len({g for g, _ in names}) == len({w for _, w in names})
        for r in found:
            if r.kind == "run":
                step = next(k for k in range(1, 16) if text[r.doc_id][r.start : r.stop - k] == text[r.doc_id][r.start + k : r.stop])
                assert step <= repeats.periods(length)


def test_repeat_groups_of_frequent_seeds_and_odd_rows(docs, odd):
    passage = "a passage that very many of the documents have in common, word for word"
    rows = [(i, f"{i * 7919} {passage} {i * 104729}") for i in range(12)]
    found = repeats.repeat_groups(docs(rows), Repeats(hot=5, least_parts=2, bits=1 << 20)).collect()
    text = {i: t.encode() for i, t in rows}
    full = all_maximal(rows, 50)
    assert {(text[r.doc_id][r.start : r.stop], r.doc_id, r.start) for r in found if r.kind == "maximal"} <= full
    found = [r for r in found if r.kind == "window"]
    assert {r.length for r in found} == {50} and len({(r.group, r.doc_id) for r in found}) == len(found)
    covers = {i: set() for i, _ in rows}
    for r in found:
        covers[r.doc_id] |= set(range(r.start, r.stop))
    for i, t in rows:
        assert covers[i] >= set(range(t.index(passage), t.index(passage) + len(passage)))
    twice = [(1, passage), (1, passage), (None, passage), (2, None), (3, "")]
    few = Repeats(least_parts=2, bits=1 << 16)
    assert repeats.repeat_groups(docs(twice), few).count() == 0
    assert repeats.repeat_groups(docs([]), few).count() == 0
    odd = [(i, t[:3000] if t else t) for i, t in odd]
    odd = [(i, t) for i, t in odd if i is not None]
    assert repeats.repeat_groups(docs(odd), few).columns == ["group", "kind", "length", "doc_id", "start", "stop"]
