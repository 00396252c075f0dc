import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import rules
from caseflow.llm.rules import Rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def vectors(stats):
    n, chars, symbols, lines, dup, repeats = (np.array(c, float) for c in zip(*stats))
    share = lambda a, b: np.log1p(100.0 * a / np.maximum(b, 1))
    x = np.stack([np.log(np.maximum(n, 1)), np.log(np.maximum(chars, 1) / np.maximum(n, 1)), share(symbols, n), share(dup, lines), share(repeats, n)], 1)
    return np.floor(np.abs(x) * 256 + 0.5) * np.sign(x)


def estimate(z, factor):
    return z.mean(0), factor * np.cov(z.T, bias=True) + np.diag([(f * 256) ** 2 for _, f in rules.STATISTICS.values()])


def distance(z, mean, cov):
    d = z - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def determinant(z, r):
    """The estimate of one group, written with matrices."""
    quart = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
    floor = np.diag([(f * 256) ** 2 for _, f in rules.STATISTICS.values()])
    states = [(quart[1], np.diag(((quart[2] - quart[0]) / 1.349) ** 2) + floor), estimate(z, 1.0)]
    for _ in range(r.steps):
        after = []
        for s in states:
            bins = np.floor(np.log2(np.maximum(distance(z, *s), 2.0**-10)) * 16)
            order = np.sort(bins)
            limit = order[math.ceil(r.share * len(z)) - 1]
            after.append(estimate(z[bins <= limit], rules._consistent(r.share, 5)))
        states = after
    best = min(states, key=lambda s: np.linalg.slogdet(s[1])[1])
    return estimate(z[distance(z, *best) <= rules.chi_square_at(r.inner, 5)], rules._consistent(r.inner, 5))


def brute(docs, r):
    """(doc_id, statistics, base_failed, distance or None) in the order of ``docs``."""
    stats = [plain(d[1]) for d in docs]
    z = vectors(stats)
    failed = np.array([s[0] < 10 or 100 * s[5] > 20 * s[0] for s in stats])
    n = Counter((d[2], d[3]) for d, f in zip(docs, failed) if not f)
    small = Counter()
    for (lang, _), c in n.items():
        small[lang] += c if c < r.least else 0
    name = lambda d: None if (d[2], d[3]) not in n else (d[2], d[3]) if n[d[2], d[3]] >= r.least else (d[2],) if small[d[2]] >= r.least else ()
    groups = [name(d) for d in docs]
    out = [None] * len(docs)
    for g in set(groups) - {None}:
        own = np.array([h == g for h in groups])
        if (own & ~failed).sum() >= (r.least if g == () else 1):
            for i, x in zip(np.flatnonzero(own), distance(z[own], *determinant(z[own & ~failed], r))):
                out[i] = x
    return [(d[0], s, bool(f), x) for d, s, f, x in zip(docs, stats, failed, out)]


def corpus():
    rng = random.Random(2)
    made = []
    for i in range(700):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["hot"] * 6 + ["b", "c", None])
        words = ["".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(5, 2))))) for _ in range(int(rng.lognormvariate(4, 0.8)) + 1)]
        if i % 20 == 0:
            words = [w + "#$" for w in words]
        if i % 7 == 0:
            words += words[:9]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        made.append((i, "\n".join(lines + lines[: i % 11 == 0]), lang, source))
    made += [(800 + i, "few rows of a rare language here " + "x y z " * 2 + f"{i} one two three", "zz", f"s{i}") for i in range(7)]
    return made


ODD = [(1, None, "en", "s"), (2, "", None, None), (3, " \n\t\n", "en", "s"), (4, "a b c d e " * 3000, "en", "s"), (5, "a b c d e a b c d e f", "en", "s"), (5, "a b c d e a b c d e f", "en", "s"),
       (5, "another text of one id", "en", "s"), (None, "x\nx\nx\n\n\ny", "fr", "s"), (6, "ÄÖ 𝒳𝒴 #&|< $ %*> " * 4, "en", None), (7, "w " * 5, "en", "s"), (8, "w " * 6, "en", "s"), (9, "a" * 80_000, "en", "s")]


def frame(spark, docs):
    schema = "doc_id long, text string, lang string, source string, key string, n_words string, grp string"
    return spark.createDataFrame([(*d, "k", "x", "g") for d in docs], schema)


def test_statistics(spark):
    docs = corpus() + ODD
    got = [tuple(r) for r in rules.statistics(frame(spark, docs)).collect()]
    want = [(d[0], d[2], d[3], *plain(d[1])) for d in docs]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("settings", [Rules(), Rules(least=15, share=0.6, steps=2, outer=0.999)])
def test_against_matrices(spark, settings):
    docs = corpus() + ODD
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["base_failed"], r["distance"], r["kept"]) for r in rules.judged(rules.statistics(frame(spark, docs)), settings).collect()), key=str)
    want = sorted(((d if d is not None else -1, s[0], f, x, not f and (x is None or x <= rules.chi_square_at(settings.outer, 5))) for d, s, f, x in brute(docs, settings)), key=str)
    assert [(g[:3], g[4]) for g in got] == [(w[:3], w[4]) for w in want]
    assert [g[3] is None for g in got] == [w[3] is None for w in want]
    assert [g[3] for g in got if g[3] is not None] == pytest.approx([w[3] for w in want if w[3] is not None], rel=1e-6)
    marked = {d[0] for d in docs if d[0] is not None and d[0] % 20 == 0 and d[0] < 700}
    rejected = {g[0] for g in got if not g[2] and not g[4]}
    assert len(rejected & marked) > 0.9 * len([g for g in got if g[0] in marked and not g[2]])


def verdicts(docs, settings=Rules()):
    return sorted(((d, not f and (x is None or x <= rules.chi_square_at(settings.outer, 5))) for d, _, f, x in brute(docs, settings)), key=str)


def test_joins_by_exchange_give_the_same(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(rules, "MAX_SENT", 0)
    found = rules.judged(rules.statistics(frame(spark, docs))).select("doc_id", "kept").collect()
    assert sorted(map(tuple, found), key=str) == verdicts(docs)


def test_too_few_rows_are_kept(spark):
    found = rules.judged(rules.statistics(frame(spark, [(i, f"a text that has more than ten words in it, and number {i} $$$$", "en", "s") for i in range(9)])))
    assert {(r["distance"], r["kept"]) for r in found.collect()} == {(None, True)}
    assert rules.judged(rules.statistics(frame(spark, []))).count() == 0


def test_documents_that_stay(spark):
    docs = corpus() + ODD
    left = rules.without_outliers(frame(spark, docs))
    assert left.columns == frame(spark, docs).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((d for d, kept in verdicts(docs) if kept), key=str)


def test_chi_square():
    assert rules.chi_square_at(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert rules.chi_square_at(0.975, 5) == pytest.approx(12.8325, abs=1e-4)
    assert rules.chi_square(2.0, 2) == pytest.approx(1 - math.exp(-1))
