import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import conversations as cv

WORD = re.compile(r"[^\x20\x09-\x0D]")
ONWARD = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(turns):
    """All audits of one conversation by plain recursion over (role, text) in order."""
    signs, seen = [], set()
    for role, text in turns:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        signs.append((role[:1], fault))
    memo = {}

    def best(i, last, inserts):
        if (i, last, inserts) in memo:
            return memo[i, last, inserts]
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            c, a, t = best(i, ONWARD[last], inserts + 1)
            found.append((c + 5, "I" + a, (({"u": "user", "a": "assistant"}[ONWARD[last]], ""),) + t))
        if i < len(turns):
            (initial, fault), (role, text) = signs[i], turns[i]
            c, a, t = best(i + 1, last, 0)
            found.append((c + 2, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if initial == "s" and last == "" or initial == ONWARD[last]:
                    c, a, t = best(i + 1, initial, 0)
                    found.append((c + extra, "K" + a, ((role, text),) + t))
                c, a, t = best(i + 1, ONWARD[last], 0)
                found.append((c + extra + 1, "R" + a, (({"u": "user", "a": "assistant"}[ONWARD[last]], text),) + t))
        memo[i, last, inserts] = min(found) if found else (10**9, "", ())
        return memo[i, last, inserts]

    cost, audit, kept = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(signs, signs[1:]))
    return [sum(f == k for _, f in signs) for k in cv.FAULTS], illegal, cost, audit, kept


def some(rng, n):
    texts = ["Yes.", "No?", "cut off", " \t", "", "Fine! ", "Ünï. \n", "e" * 5]
    return [(rng.choice(["user"] * 4 + ["assistant"] * 4 + ["system", "tool", " ", ""]), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.") for _ in range(n)]


def test_symbols_against_all_edits():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 5, 8, 13, 30] * 12:
        turns = some(rng, n)
        signs, seen = "", set()
        for role, text in turns:
            words = WORD.findall(text)
            known = role[:1] if role[:1] in ("s", "u", "a") and role else "-"
            signs += "x" if not words or (role, text) in seen else known if words[-1] in ".!?" else cv.CUT[known]
            seen.add((role, text))
        _, _, cost, audit, _ = brute(turns)
        assert cv.cheapest(signs) == (cost, audit)


@pytest.mark.parametrize("symbol", "suaxSUA-=")
def test_long_runs(symbol):
    """The audit of a long run costs what the programme says and leads to a good end."""
    cost, audit = cv.cheapest(symbol * 1_000_000)
    place = cv.NOTHING
    total = at = 0
    for letter in audit:
        if letter == "I":
            total, place = total + cv.INSERT, cv.ONWARD[place]
            continue
        _, price, place = next(e for e in cv._edits(symbol, place) if e[0] == letter)
        total, at = total + price, at + 1
    assert at == 1_000_000 and total == cost and place in (cv.NOTHING, cv.AFTER_A)


@pytest.mark.parametrize("limit", [None, "3"])
def test_against_brute_force(spark, limit):
    rng = random.Random(8)
    made = {c: some(rng, n) for c, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 40] * 3)}
    made[None] = some(rng, 9)
    made[77] = [("user", "Again and again.")] * 300
    rows = [(c, i, r, t, "x", 0) for c, turns in made.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, kind int")
    if limit:
        spark.conf.set("spark.caseflow.hotRows", limit)
    try:
        found = cv.repaired(table)
        facts = {r["conv_id"]: r for r in found.facts.collect()}
        kept = {}
        for r in sorted(found.turns().collect(), key=lambda r: (str(r["conv_id"]), r["step"])):
            if r["edit"] != "D":
                kept.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        digests = {r["conv_id"]: r["repaired_sha256"] for r in found.digests().collect()}
    finally:
        spark.conf.unset("spark.caseflow.hotRows")
    assert set(facts) == set(made) == set(digests)
    for c, turns in made.items():
        faults, illegal, cost, audit, want = brute(turns)
        f = facts[c]
        assert ([f[k] for k in cv.FAULTS], f["illegal"], f["cost"], f["audit"], f["gaps"]) == (faults, illegal, cost, audit, 0)
        assert tuple(kept.get(c, ())) == want
        assert digests[c] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want).encode()).hexdigest()


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "Hi."), (1, 5, "assistant", "Ho."), (1, 2, None, "What?"), (2, None, None, None), (3, 4, "user", "A."), (3, 4, "user", "A."), (3, 9, "assistant", "B" * 100_000 + ".")]
    found = cv.repaired(spark.createDataFrame(rows, schema))
    facts = {r["conv_id"]: tuple(r)[1:] for r in found.facts.collect()}
    assert facts[1] == (2, 0, 0, 0, 2, 2, "KDK")
    assert facts[2] == (0, 1, 0, 0, 0, 2, "D")
    assert facts[3] == (4, 0, 1, 0, 1, 2, "KDK")
    every = cv.with_conversations(spark.createDataFrame([(9,), (1,), (None,)], "conv_id long"), found)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in every.collect()} == {9: (0, ""), None: (0, ""), 1: (2, "KDK")}
    empty = cv.repaired(spark.createDataFrame([], schema))
    assert empty.facts.count() == empty.turns().count() == empty.digests().count() == 0
    assert cv.repaired(spark.createDataFrame(rows, schema).withColumn("copy", F.lit(3)), "copy").facts.count() == 3
