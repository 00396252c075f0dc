"""Line dedup by a deletion-neighbourhood join over words.

Two lines are close when at most one word has to be inserted, deleted or replaced.  A line's
neighbourhood is the line itself and the line without its j-th word, for every j.  Close lines share
a variant: the same one with the same j where a word was replaced, the whole line of one and a
shortened one of the other where a word was added.  Lines that share a variant in this way are all
close to each other, so no pairs within a group are needed: its earliest line is the one that stays,
and each other line is verified against it.

Few lines have a close one.  Cut in two halves, close lines agree in one of them; only lines that share a
half with another line emit their variants.  This leaves nothing out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import bit_filter, durable, has_bit, record_batch, texts
from caseflow.llm.shingles import mix, word_hashes
from caseflow.operators.ordered import attach

#: Bytes of text that are hashed together.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Lines:
    """Lines of fewer than ``least_words`` words are compared for equality only.  ``bits`` of each filter."""

    least_words: int = 8
    bits: int = 1 << 26


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TAGS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


class _Measured:
    """The lines with words of many texts: where they are, their words' hashes and running sums."""

    def __init__(self, group: list[bytes]) -> None:
        raw = b"\n".join(group) + b"\n"
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        offsets = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
        text = np.searchsorted(offsets[1:], starts, side="right")
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets[text], side="left")
        at, words = word_hashes(raw)
        line = np.searchsorted(starts, at, side="right") - 1
        full, first, count = np.unique(line, return_index=True, return_counts=True)
        self.raw, self.starts, self.ends = raw, starts[full], ends[full]
        self.text, self.number = text[full], number[full]
        self.first, self.count = first, count
        place = np.arange(len(words)) - np.repeat(first, count)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(count.max(initial=0)), _BASE, np.uint64)]))
        self.powers, self.place = powers, place
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[place])])
        self.whole = mix((self.sums[first + count] - self.sums[first]) ^ count.astype(np.uint64) * _TAGS[0])

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Per line four keys: of its first and second part, and of the parts a line one word shorter would share with it."""
        keys = np.empty((len(self.first), 4), np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.powers), _INVERSE, np.uint64)]))
        for c, change in enumerate((-1, 0)):
            n = self.count + change
            head = n // 2
            tail = n - head
            left = self.sums[self.first + np.minimum(head, self.count)] - self.sums[self.first]
            cut = np.maximum(self.count - tail, 0)
            right = (self.sums[self.first + self.count] - self.sums[self.first + cut]) * inverse[cut]
            keys[:, 2 * c] = mix(left + n.astype(np.uint64) * _TAGS[1])
            keys[:, 2 * c + 1] = mix(right + n.astype(np.uint64) * _TAGS[2])
        return keys

    def variants(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, key) of the neighbourhoods of some lines; place -1 is the line itself."""
        count, first = self.count[rows], self.first[rows]
        owner = np.repeat(np.arange(len(rows)), count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = first[owner] + place
        total = self.sums[(first + count)[owner]]
        less = (self.sums[at] - self.sums[first[owner]]) + (total - self.sums[at + 1]) * _INVERSE
        keys = mix(less ^ (count[owner] - 1).astype(np.uint64) * _TAGS[0])
        return np.concatenate([rows[owner], rows]), np.concatenate([place, np.full(len(rows), -1)]), np.concatenate([keys, self.whole[rows]])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Measured, np.ndarray]]:
    """Measured lines and the ids of their texts, about TOGETHER bytes at a time."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        held, size, first = [], 0, 0
        values = list(texts(batch, "text"))
        for i, value in enumerate(values):
            held.append(value)
            size += len(value)
            if size >= TOGETHER or i == len(values) - 1:
                yield _Measured(held), ids[first : i + 1]
                held, size, first = [], 0, i + 1


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return record_batch({n: pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for n, c in columns.items()})


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line with a word; ``line`` is the hash of its words, A-Z lower-cased."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, ids in _measured(batches):
            yield _longs(doc_id=ids[m.text], line_no=m.number, line=m.whole)

    return docs.mapInArrow(walk, "doc_id long, line_no long, line long")


def close_lines(docs: DataFrame, settings: Lines) -> DataFrame:
    """(line, of_line, of_doc_id, of_line_no): lines with an earlier close one, the earliest of those, verified."""
    spark, least, bits = docs.sparkSession, settings.least_words, settings.bits

    def half_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, _ in _measured(batches):
            rows = np.flatnonzero(m.count >= least)
            _, once = np.unique(m.whole[rows], return_index=True)
            rows = rows[once]
            keys = m.halves()[rows]
            yield _longs(key=keys.ravel(), line=np.repeat(m.whole[rows], 4))

    shared = docs.mapInArrow(half_keys, "key long, line long").groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b")
    halves = spark.sparkContext.broadcast(bit_filter(shared, "key", bits))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, ids in _measured(batches):
            rows = np.flatnonzero(m.count >= least)
            rows = rows[np.lexsort((m.number[rows], ids[m.text[rows]]))]  # the earliest place of a line speaks for it
            _, once = np.unique(m.whole[rows], return_index=True)
            rows = rows[once]
            rows = rows[has_bit(halves.value, m.halves()[rows].view(np.int64), bits).any(axis=1)]
            row, place, key = m.variants(rows)
            yield _longs(key=key, place=place, line=m.whole[row], doc_id=ids[m.text[row]], line_no=m.number[row])

    found = docs.mapInArrow(variants, "key long, place long, line long, doc_id long, line_no long").repartition("key")
    own = F.struct("doc_id", "line_no", "line")
    # A key under which two different lines meet; most keys have one.  The same shuffled rows are read twice.
    met = found.groupBy("key").agg(
        F.min("line").alias("a"), F.max("line").alias("b"),
        F.min(F.when(F.col("place") >= 0, own)).alias("shortened"), F.min(F.when(F.col("place") < 0, own)).alias("whole"),
    )
    meeting = durable(found.join(met.filter("a <> b").drop("a", "b"), "key").select("key", "place", "line", own.alias("own"), "shortened", "whole"))
    replaced = durable(meeting.groupBy("key", "place").agg(F.min("own").alias("replaced")))
    best = meeting.join(replaced, ["key", "place"]).select(
        "line", "own", F.least("replaced", F.when(F.col("place") >= 0, F.col("whole")).otherwise(F.col("shortened"))).alias("other")
    )
    best = best.groupBy("line").agg(F.min("own").alias("own"), F.min("other").alias("other")).filter("other < own")
    pairs = durable(best.select("line", F.col("other.line").alias("of_line"), F.col("other.doc_id").alias("of_doc_id"), F.col("other.line_no").alias("of_line_no")))

    needed = pairs.select("line").unionByName(pairs.select(F.col("of_line").alias("line"))).distinct()
    marks = spark.sparkContext.broadcast(bit_filter(needed, "line", bits))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, _ in _measured(batches):
            _, rows = np.unique(m.whole, return_index=True)
            rows = rows[has_bit(marks.value, m.whole[rows].view(np.int64), bits)]
            values = [m.raw[m.starts[r] : m.ends[r]] for r in rows]
            yield record_batch({"line": pa.array(m.whole[rows].view(np.int64), pa.int64()), "value": pa.array(values, pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = zip(batch.column("value").to_pylist(), batch.column("of_value").to_pylist())
            yield batch.filter(pa.array([one_word_apart(a.lower().split(), b.lower().split()) for a, b in pair], pa.bool_())).drop_columns(["value", "of_value"])

    words = docs.mapInArrow(contents, "line long, value binary").groupBy("line").agg(F.min("value").alias("value"))
    words = durable(words.join(needed, "line", "left_semi"))
    both = durable(pairs.join(words, "line")).join(words.select(F.col("line").alias("of_line"), F.col("value").alias("of_value")), "of_line")
    return both.select("line", "of_line", "of_doc_id", "of_line_no", "value", "of_value").mapInArrow(verify, "line long, of_line long, of_doc_id long, of_line_no long")


def one_word_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most one: what the common head and tail leave is one word at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    tail = next((i for i, (x, y) in enumerate(zip(a[:head - 1 if head else None:-1], b[::-1])) if x != y), len(a) - head)
    return len(b) - head - tail <= 1


def _keyed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Rows with ``key``, which is one for rows of one id and text, and grows with the id (NULL last), then the text's hash.

    Where no id is NULL or there twice, the id is the key, and nothing but ids is looked at to know that.
    """
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.withColumn("key", F.col("doc_id")), False
    last = F.col("doc_id").isNull()
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    in_order = hashed.repartitionByRange(last, "doc_id", "hash").sortWithinPartitions(last, "doc_id", "hash")
    # Partitions are numbered in order, rows within them too, so this number grows with the order; it is written down.
    numbered = durable(in_order.withColumn("number", F.monotonically_increasing_id()))
    first = numbered.groupBy("doc_id", "hash").agg(F.min("number").alias("key"))
    return durable(attach(numbered, first, ["doc_id", "hash"]).select(*rows.columns, "key")), True


def _decided(rows: DataFrame, settings: Lines) -> DataFrame:
    """(doc_id, line_no, kept, near) of rows (doc_id, text) whose ids are keys."""
    table = durable(line_table(rows))
    close = close_lines(rows, settings)
    first = table.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    decided = durable(first.join(close.select("line", F.lit(True).alias("near")), "line", "left"))
    joined = table.join(decided, "line")
    near = F.coalesce("near", F.lit(False))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    return joined.select("doc_id", "line_no", (own & ~near).alias("kept"), near.alias("near"))


def line_decisions(docs: DataFrame, settings: Lines = Lines(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, kept, near): every line with a word.

    Lines are what newlines separate, numbered from 0; words are separated by white space and compared
    with A-Z lower-cased.  A line goes when an earlier line of any document, dropped or not, is equal to it or, from
    ``least_words`` words on, one word apart (``near``).  Earlier is a smaller doc_id (NULL is the largest), of rows with
    one id the text with the smaller hash, then the smaller number.  NULL and empty texts have no lines; lines
    without words are never touched.  A row that is there twice (id and text) counts once here; both rows get the same decisions.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed, renamed = _keyed(rows)
    if not renamed:
        return _decided(rows, settings)
    once = durable(keyed.dropDuplicates(["key"]))
    found = _decided(once.select(F.col("key").alias("doc_id"), "text"), settings).withColumnRenamed("doc_id", "key")
    return found.join(once.select("key", "doc_id"), "key").select("doc_id", "line_no", "kept", "near")


def without_repeated_lines(docs: DataFrame, settings: Lines = Lines(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, each text without its dropped lines; odd rows as in ``line_decisions``."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed, renamed = _keyed(packed)
    once = keyed.dropDuplicates(["key"]) if renamed else keyed
    dropped = _decided(once.select(F.col("key").alias("doc_id"), "text"), settings).filter("NOT kept")
    gone = durable(dropped.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("line_no", F.lit(True)))).alias("gone")).withColumnRenamed("doc_id", "key"))
    joined = keyed.join(gone, "key", "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: F.element_at("gone", i.cast("long")).isNull())
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select("row", cleaned.alias("cleaned")).select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
