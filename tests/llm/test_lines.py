import random

from caseflow.llm import lines
from caseflow.llm.lines import Lines


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least):
    listed = sorted({(i, n, tuple(x.split())) for i, t in rows for n, x in enumerate((t or "").encode().lower().split(b"\n")) if x.split()})
    out = set()
    for k, (i, n, w) in enumerate(listed):
        if any(w == v or (min(len(w), len(v)) >= least and close(w, v)) for *_, v in listed[:k]):
            out.add((i, n))
    return out


def corpus():
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    pool = [r.choices(words, k=r.choice([1, 3, 7, 8, 9, 15, 16, 30])) for _ in range(14)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(r.randrange(0, 7)):
            line = list(r.choice(pool))
            change = r.randrange(5)
            if change == 1:
                line[r.randrange(len(line))] = r.choice(words)
            elif change == 2:
                line.insert(r.randrange(len(line) + 1), r.choice(words))
            elif change == 3:
                del line[r.randrange(len(line))]
            text.append(r.choice(["  ", "", "\t"]) + " ".join(line) + r.choice(["", " "]))
        rows.append((i, "\n".join(text)))
    return rows


def gone(found):
    return {(r.doc_id, r.line_no) for r in found.collect() if not r.kept}


def test_against_all_pairs(docs):
    rows = corpus()
    for settings in (Lines(), Lines(least_words=2, bits=1 << 15)):
        assert gone(lines.line_decisions(docs(rows), settings)) == brute(rows, settings.least_words)


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a, b = (r.choices([b"x", b"y"], k=r.randrange(0, 6)) for _ in range(2))
        assert lines.one_word_apart(a, b) == close(tuple(a), tuple(b)), (a, b)


def test_cleaned_text(docs, odd):
    rows = corpus()
    table = docs(rows)
    out = lines.without_repeated_lines(table, Lines())
    assert out.columns == table.columns
    dropped = brute(rows, 8)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in dropped) for i, t in rows}
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert gone(lines.line_decisions(docs(odd))) == brute(odd, 8)
    assert lines.line_decisions(docs([])).count() == 0 and lines.line_decisions(docs([(1, None), (2, "")])).count() == 0


def test_rows_in_any_order(docs):
    line = "one two three four five six seven eight nine"
    rows = [(9, line), (3, line), (5, line.replace("two", "zwei"))]
    assert gone(lines.line_decisions(docs(rows).coalesce(1))) == {(5, 0), (9, 0)}
    for seed in range(3):
        rows = corpus()
        random.Random(seed).shuffle(rows)
        assert gone(lines.line_decisions(docs(rows).coalesce(1))) == brute(rows, 8)


def test_ids_that_are_null_or_shared(docs):
    line = "one two three four five six seven eight nine"
    rows = [(None, line + "\nonly here"), (None, "only there\n" + line), (None, None), (4, line), (7, "unique line of the first text"), (7, line + "\nunique line of the other text"), (7, line + "\nunique line of the other text"), (8, "unique line of the first text\nlast")]
    table = docs(rows)
    out = sorted(((r.doc_id, r.text) for r in lines.without_repeated_lines(table).collect()), key=str)
    want = [(None, "only here"), (None, "only there"), (None, None), (4, line), (7, "unique line of the first text"), (7, "unique line of the other text"), (7, "unique line of the other text"), (8, "last")]
    assert out == sorted(want, key=str)
    decided = lines.line_decisions(table).collect()
    assert len(decided) == 2 + 2 + 1 + 1 + 2 + 2
    assert sorted((str(r.doc_id), r.line_no) for r in decided if not r.kept) == [("7", 0), ("8", 0), ("None", 0), ("None", 1)]


def test_shared_ids_change_nothing_for_the_others(docs):
    rows = corpus()
    more = rows + [(100, "something else entirely"), (100, "and another one"), (None, "no id at all")]
    assert {g for g in gone(lines.line_decisions(docs(more))) if g[0] is not None and g[0] < 100} == brute(rows, 8)
