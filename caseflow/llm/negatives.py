"""Hard negatives by residue-number-system matrix products.

Anchors and candidates are cut into blocks of vectors.  A block pair is scored modulo several small
primes: residues are taken into the balanced range, where a float32 product over at most ``DEPTH``
components stays below 2**24 and is therefore exact.  The residues of a score give its balanced
mixed-radix digits (Chinese remaindering after Garner), and these the exact signed integer.

Two passes over the block pairs: the first finds each anchor's positives, the second, with their
scores known, the negatives close below each.  A pair of blocks sends at most ``positives`` rows an
anchor, then at most ``negatives`` rows an (anchor, positive); windows choose among these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import durable, record_batch

SCALE = 256
#: Components that one float32 product may sum before it is reduced; whole numbers below EXACT_FLOAT are exact.
DEPTH, EXACT_FLOAT = 4096, 2**24
_BLOCK = "dim int, ids binary, labels binary, values binary, most long, wanted array<array<long>>"


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the range of a negative's score in percent of the positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    anchor_block: int = 512
    block: int = 4096


@lru_cache(maxsize=None)
def moduli(bound: int, dim: int) -> tuple[int, ...]:
    """The largest odd primes whose balanced residues multiply exactly in float32, as many as tell -bound..bound apart."""
    found, product = [], 1
    p = 2 * isqrt(EXACT_FLOAT // max(1, min(dim, DEPTH))) + 1
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("scores too large for the available primes")
        if p % 2 and all(p % q for q in range(3, isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 1
    return tuple(found)


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues in -(p-1)/2 .. (p-1)/2 of whole numbers below 2**52 held in doubles."""
    return x - p * np.rint(x / p)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for whole numbers in int64, exact where the result fits into 64 bits."""
    dim = a.shape[1]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
    primes = moduli(bound, dim)
    digits: list[np.ndarray] = []
    total, weight = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        half = (p - 1) // 2
        left, right = (((m + half) % p - half).astype(np.float32) for m in (a, b))
        rest = np.zeros((len(a), len(b)))
        for at in range(0, dim, DEPTH):
            rest = _balanced(rest + left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T, p)
        for digit, q in zip(digits, primes):  # Garner: strip the digits already known
            rest = _balanced((rest - digit) * pow(q, -1, p), p)
        digits.append(rest)
        # Sums modulo 2**64: the true score fits, so what wraps on the way wraps back.
        total += rest.astype(np.int64) * np.uint64(weight % 2**64).astype(np.int64)
        weight *= p
    return total


def vectors_of(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, dim): floor(256 * x) of every component; rows with a NULL id, label or vector, or a
    NULL or non-finite component, are left out.  A row that is there twice is a candidate twice."""
    taken = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    return taken.filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").filter(fine).select(
        "vec_id", "label", F.transform("e", lambda x: F.floor(x * float(SCALE))).alias("v"), F.size("e").alias("dim")
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of at most ``size`` vectors of one length, with what each row has in ``wanted``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray, list]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, labels, values, wanted = zip(*held.pop(dim))
            values = np.array(values, "<i8")
            longs = lambda x: pa.array([np.asarray(x, "<i8").tobytes()], pa.binary())
            return record_batch(
                {"dim": pa.array([dim], pa.int32()), "ids": longs(ids), "labels": longs(labels), "values": longs(values),
                 "most": pa.array([int(np.abs(values).max(initial=0))], pa.int64()), "wanted": pa.array([list(wanted)], pa.list_(pa.list_(pa.int64())))}
            )

        for batch in batches:
            flat, ends = batch.column("v").flatten().to_numpy(), np.cumsum([0, *batch.column("dim").to_pylist()])
            ids, labels, wanted = (batch.column(c).to_pylist() for c in ("vec_id", "label", "wanted"))
            for j, i in enumerate(ids):
                dim = int(ends[j + 1] - ends[j])
                held.setdefault(dim, []).append((i, labels[j], flat[ends[j] : ends[j + 1]], wanted[j]))
                if len(held[dim]) == size:
                    yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(pack, _BLOCK)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


Choice = tuple[np.ndarray, np.ndarray, np.ndarray]


def _choose(choice: Callable[[int, int, list[int], np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]):
    """Score every block pair and keep, per anchor and group, the places that ``choice`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: np.frombuffer(x, "<i8")
        for batch in batches:
            out: list[Choice] = []
            for pair in batch.to_pylist():
                dim, ids, labels = pair["dim"], longs(pair["ids"]), longs(pair["labels"])
                anchors, own = longs(pair["a_ids"]), longs(pair["a_labels"])
                scores = exact_products(longs(pair["a_values"]).reshape(len(anchors), dim), longs(pair["values"]).reshape(len(ids), dim))
                for a, label, wanted, row in zip(anchors.tolist(), own.tolist(), pair["a_wanted"], scores):
                    for group, at in choice(a, label, wanted, row, ids, labels):
                        out.append((np.full(len(at), a), np.full(len(at), group), np.stack([ids[at], row[at]], 1)))
            a, g, found = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
            columns = {"anchor_id": a, "place": g, "vec_id": found[:, 0], "score": found[:, 1]}
            yield record_batch({n: pa.array(c, pa.int64()) for n, c in columns.items()})

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, mining: Mining = Mining(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being integer inner products.

    An anchor's positives are its best rows of the same label and another id, its negatives, per
    positive, the best rows of other labels that score from ``low`` to ``high`` percent of the positive;
    ties go to the smaller id.  Only vectors of the anchor's length are compared.  An anchor id that is
    there twice counts once (with its smallest label and vector).  An anchor without positives, or a
    positive without negatives, has no rows; an empty table gives none.  Components must keep the
    scores within 64 bits.
    """
    k, low, high = mining.positives, mining.low, mining.high
    none = F.array().cast("array<long>").alias("wanted")
    vectors = durable(vectors_of(rows, vec_id, embedding, label))
    candidates = durable(_blocks(vectors.select("*", none), mining.block).drop("wanted", "most"))
    asked = durable(vectors.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("f")).select("vec_id", "f.*"))

    def against(anchors: DataFrame, choice) -> DataFrame:
        blocks = _blocks(anchors, mining.anchor_block).drop("most")
        blocks = blocks.withColumnsRenamed({c: f"a_{c}" for c in blocks.columns})
        # The stated anchors against all rows, in blocks.
        pairs = candidates.crossJoin(blocks).filter(F.col("dim") == F.col("a_dim")).drop("a_dim")
        return pairs.mapInArrow(_choose(choice), "anchor_id long, place long, vec_id long, score long")

    def same_label(a, own, wanted, row, ids, labels):
        at = np.flatnonzero((labels == own) & (ids != a))
        yield 0, at[_first(row[at], ids[at], k)]

    def close_below(a, own, wanted, row, ids, labels):
        other = np.flatnonzero((labels != own) & (ids != a))
        scores = row[other]
        for place, score in enumerate(wanted):
            at = other[(scores >= -(-low * score // 100)) & (scores <= high * score // 100)]
            yield place, at[_first(row[at], ids[at], mining.negatives)]

    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    positives = against(asked.select("*", none), same_label).withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < k)
    positives = durable(positives)
    # At most ``positives`` entries an anchor.
    scores = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))
    wanted = asked.join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "dim", F.col("p.score").alias("wanted"))
    rank = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id")
    negatives = against(wanted, close_below).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= mining.negatives)
    named = positives.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
