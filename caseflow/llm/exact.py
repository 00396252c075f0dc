"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text (A-Z lower-cased, UTF-8) is a row of 16-bit words.  A chunk's hash is the value of the
polynomial with these words as coefficients, modulo two primes.  Chunk hashes compose: the hash of
``a + b`` is ``hash(a) * base ** words(b) + hash(b)``, so the chunks of a huge document are hashed
on different executors and their shifted values are simply added up.

Rows with equal (fingerprint, length) are only candidates.  Their texts are streamed past each
other chunk by chunk; where two texts differ, the candidates are told apart by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import bit_filter, durable, record_batch, same, texts

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_013)
#: Words of a chunk: 2**15 products of 16 and 31 bits stay below 2**63.
CHUNK_WORDS = 1 << 15
CHUNK_BYTES = 2 * CHUNK_WORDS
#: Documents from this size on are cut into chunk rows that the whole cluster hashes.
HUGE_BYTES = 64 << 20
#: Bits of the filter that spares the texts of unrepeated fingerprints the shuffle (4 MiB).  When more
#: fingerprints repeat than it can tell apart, more texts are compared; the result stays the same.
FILTER_BITS = 1 << 25
#: Parts in which the copies of one text are compared at first.
SALTS = 16


def _powers(prime: int, base: int) -> np.ndarray:
    out = np.empty(CHUNK_WORDS, np.uint64)
    value = 1
    for i in range(CHUNK_WORDS):
        out[CHUNK_WORDS - 1 - i] = value
        value = value * base % prime
    return out


_TABLES: dict[int, np.ndarray] = {}


def chunk_hashes(chunk: bytes) -> tuple[int, int]:
    """The two hashes of at most CHUNK_BYTES bytes."""
    words = np.frombuffer(chunk + b"\0" * (len(chunk) & 1), "<u2").astype(np.uint64)
    found = []
    for prime, base in zip(PRIMES, BASES):
        if prime not in _TABLES:
            _TABLES[prime] = _powers(prime, base)
        found.append(int(np.dot(words, _TABLES[prime][CHUNK_WORDS - len(words) :]) % prime))
    return found[0], found[1]


def shifted(hashes: tuple[int, int], words_after: int) -> tuple[int, int]:
    """A chunk's share of the whole text's hash, given the number of words behind the chunk."""
    return tuple(h * pow(b, words_after, p) % p for h, b, p in zip(hashes, BASES, PRIMES))


def fingerprint(text: bytes) -> int:
    """Both hashes in 62 bits, from the chunks' shifted hashes."""
    if len(text) <= CHUNK_BYTES:
        first, second = chunk_hashes(text)
        return first << 31 | second
    total, words = [0, 0], (len(text) + 1) // 2
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        for i, h in enumerate(shifted(chunk_hashes(chunk), words - (at + len(chunk) + 1) // 2)):
            total[i] = (total[i] + h) % PRIMES[i]
    return total[0] << 31 | total[1]


def differs(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that stops at the first chunk that differs."""
    if len(a) != len(b):
        return True
    left, right = memoryview(a), memoryview(b)
    return any(left[i : i + CHUNK_BYTES] != right[i : i + CHUNK_BYTES] for i in range(0, len(a), CHUNK_BYTES))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, print, text_sha256) of every row; ``print`` is NULL for no row."""

    def inline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, digests = [], [], []
            for raw in texts(batch, "text"):
                value = raw.lower()  # of bytes: A-Z only
                sizes.append(len(value))
                prints.append(fingerprint(value) if len(value) < huge_bytes else None)
                digests.append(hashlib.sha256(value).hexdigest())
            yield record_batch(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "print": pa.array(prints, pa.int64()), "text_sha256": pa.array(digests, pa.string())}
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                shifted(chunk_hashes(chunk.lower()), (n + 1) // 2 - (at + len(chunk) + 1) // 2)
                for chunk, n, at in zip(texts(batch, "chunk"), batch.column("n_bytes").to_pylist(), batch.column("at").to_pylist())
            ]
            yield record_batch(
                {k: batch.column(k) for k in ("text_sha256", "n_bytes", "at")}
                | {"h0": pa.array([s[0] for s in sums], pa.int64()), "h1": pa.array([s[1] for s in sums], pa.int64())}
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = rows.mapInArrow(inline, "doc_id long, n_bytes long, print long, text_sha256 string")
    # A text's hash belongs to the text, not to the id of its row: shares are gathered under the digest.
    digest = F.sha2(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256).alias("text_sha256")
    huge = rows.filter(F.octet_length("text") >= huge_bytes).select(
        digest, F.octet_length("text").cast("long").alias("n_bytes"), F.encode("text", "UTF-8").alias("raw"),
        F.explode(F.expr(f"sequence(0L, octet_length(text) - 1L, {CHUNK_BYTES}L)")).alias("at"),
    )
    chunks = huge.select("text_sha256", "n_bytes", "at", F.substring("raw", F.col("at").cast("int") + 1, F.lit(CHUNK_BYTES)).alias("chunk"))
    chunks = chunks.repartition("text_sha256", "at").mapInArrow(hashed, "text_sha256 string, n_bytes long, at long, h0 long, h1 long")
    # Equal texts bring every chunk once each; a text's shares count once.
    shares = chunks.groupBy("text_sha256", "at").agg(F.min("h0").alias("h0"), F.min("h1").alias("h1"))
    composed = shares.groupBy("text_sha256").agg((F.shiftleft(F.sum("h0") % PRIMES[0], 31) + F.sum("h1") % PRIMES[1]).alias("composed"))
    big = known.filter("print IS NULL").join(composed, "text_sha256")
    return known.filter("print IS NOT NULL").unionByName(big.select("doc_id", "n_bytes", F.col("composed").alias("print"), "text_sha256"))


def collisions(docs: DataFrame, prints: DataFrame, text: str, bits: int = FILTER_BITS, salts: int = SALTS) -> DataFrame:
    """(print, n_bytes) under which different texts were found by comparing them.

    Copies within one Arrow batch are compared there and travel once.  What is left is compared in
    ``salts`` parts per fingerprint, then one text of each part with each other; every task streams
    sorted rows and holds the text before only.
    """
    repeated = prints.groupBy("print", "n_bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, "print", bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], list[bytes]] = {}
            for raw in texts(batch, "text"):
                value = raw.lower()
                mark = fingerprint(value)
                slot = mark % bits
                if marks.value[slot >> 3] >> (slot & 7) & 1:
                    held = seen.setdefault((mark, len(value)), [])
                    if all(differs(value, other) for other in held):
                        held.append(value)
            rows = [(mark, n, value) for (mark, n), held in seen.items() for value in held]
            yield record_batch(
                {"print": pa.array([r[0] for r in rows], pa.int64()), "n_bytes": pa.array([r[1] for r in rows], pa.int64()), "value": pa.array([r[2] for r in rows], pa.binary())}
            )

    def distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int, bytes] | None = None
        for batch in batches:
            keep = []
            for i, (mark, n, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "value"))):
                if before is None or (mark, n) != before[:2] or differs(value, before[2]):
                    keep.append(i)
                before = (mark, n, value)
            yield batch.take(pa.array(keep, pa.int64()))

    schema = "print long, n_bytes long, value binary"
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(candidates, schema)
    order = ["print", "n_bytes", "value"]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition("print", "n_bytes", "salt")
    parts = salted.drop("salt").sortWithinPartitions(*order).mapInArrow(distinct_texts, schema)
    merged = parts.repartition("print", "n_bytes").sortWithinPartitions(*order).mapInArrow(distinct_texts, schema)
    return merged.groupBy("print", "n_bytes").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").drop("n_texts")


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The row with the largest doc_id stays.
    NULL counts as the empty text; empty texts equal each other.  A NULL doc_id is smaller than any
    other (it stays only where all ids of its group are NULL).  A row that is there twice is counted
    twice; both carry the same decision.  No rows give no rows; further columns are ignored.
    """
    prints = durable(fingerprints(docs, doc_id, text, huge_bytes))
    apart = durable(collisions(docs, prints, text))
    # One row a text and map task goes over the network; the digest only says which text a row has.
    own = ["print", "n_bytes", "text_sha256"]
    held = prints.groupBy(*own).agg(F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("rows"))
    parted = held.alias("h").join(
        apart.withColumn("apart", F.lit(True)).alias("a"), F.expr("h.print = a.print AND h.n_bytes = a.n_bytes"), "left"
    ).select("h.*", F.expr("CASE WHEN apart THEN text_sha256 ELSE '' END").alias("part"))
    group = Window.partitionBy("print", "n_bytes", "part")
    classes = durable(parted.select(*own, F.max("most").over(group).alias("keep_id"), F.sum("rows").over(group).alias("group_size")))
    joined = prints.join(classes, same(prints, classes, own))
    return joined.select(
        prints["doc_id"], "keep_id", "group_size", prints["doc_id"].eqNullSafe(F.col("keep_id")).alias("kept"), prints["text_sha256"]
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one row for each group of equal texts, all columns kept.

    NULL counts as the empty text.  Of rows that agree in id and text one stays, also where the id is NULL; an
    empty table gives none.  Columns of any name pass through.
    """
    stays = exact_classes(docs, doc_id, text).filter("kept").select("keep_id", "text_sha256").distinct()
    value = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.sha2(value, 256).alias("digest"))
    found = rows.join(stays, rows["id"].eqNullSafe(stays["keep_id"]) & (rows["digest"] == stays["text_sha256"]), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select("row.*")
