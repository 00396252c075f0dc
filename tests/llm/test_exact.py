import hashlib
import random

from caseflow.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g)


def test_fingerprints_compose():
    text = random.Random(1).randbytes(5 * exact.CHUNK_BYTES + 1001)
    n = (len(text) + 1) // 2
    total = [0, 0]
    for at in range(0, len(text), exact.CHUNK_BYTES):
        chunk = text[at : at + exact.CHUNK_BYTES]
        for i, h in enumerate(exact.shifted(exact.chunk_hashes(chunk), n - (at + len(chunk) + 1) // 2)):
            total[i] = (total[i] + h) % exact.PRIMES[i]
    assert exact.fingerprint(text) == total[0] << 31 | total[1]
    value = 0  # the same polynomial, word by word
    for i in range(0, len(text), 2):
        value = (value * exact.BASES[0] + int.from_bytes(text[i : i + 2], "little")) % exact.PRIMES[0]
    assert exact.fingerprint(text) >> 31 == value


def test_odd_texts(docs, odd):
    found = exact.exact_classes(docs(odd)).collect()
    assert sorted(tuple(r) for r in found) == brute(odd)


def test_empty_table(docs):
    assert exact.exact_classes(docs([])).count() == 0
    assert exact.without_copies(docs([])).count() == 0


def test_huge_documents_are_cut_over_the_cluster(docs, odd):
    whole = {(r.doc_id, r.n_bytes): r.print for r in exact.fingerprints(docs(odd)).collect()}
    cut = {(r.doc_id, r.n_bytes): r.print for r in exact.fingerprints(docs(odd), huge_bytes=1000).collect()}
    assert whole == cut


def test_huge_texts_that_share_an_id(docs, odd):
    """Texts of one length under one id, or under none, are as different as they are."""
    rows = [(1, "a" * 500), (1, "b" * 500), (None, "c" * 500), (None, "d" * 500), (None, "D" * 500), (3, "A" * 500), (3, "A" * 500), (4, "short"), *odd]
    found = sorted((tuple(r) for r in exact.exact_classes(docs(rows), huge_bytes=100).collect()), key=str)
    least = lambda i: -1 if i is None else i
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = [(i, max(g, key=least), len(g), i == max(g, key=least), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g]
    assert found == sorted(want, key=str)


def test_equal_fingerprints_of_different_texts(docs, monkeypatch):
    monkeypatch.setattr(exact, "fingerprints", lambda d, *a: _constant(d))
    monkeypatch.setattr(exact, "collisions", lambda d, p, t: p.select("print", "n_bytes").distinct())
    rows = [(1, "ab"), (2, "cd"), (3, "AB")]
    assert sorted(tuple(r) for r in exact.exact_classes(docs(rows)).collect()) == brute(rows)


def _constant(d):
    from pyspark.sql import functions as F

    return d.select("doc_id", F.lit(2).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("print"), F.sha2(F.lower("text"), 256).alias("text_sha256"))


def test_comparison_finds_collisions(docs, spark):
    rows = docs([(i, f"text {i % 3}") for i in range(50)])
    same = exact.fingerprints(rows)
    assert exact.collisions(rows, same, "text", bits=1 << 15, salts=2).count() == 0
    assert exact.differs(b"a" * 70_000, b"a" * 69_999 + b"b") and not exact.differs(b"x" * 70_000, b"x" * 70_000)


def test_stage_keeps_one_row_and_all_columns(docs, odd):
    table = docs(odd)
    left = exact.without_copies(table)
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in set(brute(odd)) if r[3])
