"""A small neural network trained over Spark partitions, with class weight and early stopping.

Each epoch is one job: every part of the training rows goes on from the current weights, with mini-batches
and Adam, and sends its weights back; they are averaged by rows (local steps with synchronous
averaging).  Validation rows are scored after each epoch, and training stops once their AUROC has not risen for
``patience`` epochs; the best weights are kept.  What travels is one set of weights per part, added up in
groups before it reaches the driver; rows stay where they are.

Parts are fixed by the case id, and random numbers by seed, epoch and part, so a lost task repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators import metrics, ordered
from caseflow.operators.design import View
from caseflow.session import durable


@dataclass(frozen=True)
class Perceptron:
    """Fixed values of the reported runs: two hidden layers of 64, dropout 0.3, batches of 256, Adam at 1e-3, patience 10."""

    hidden: tuple[int, ...] = (64, 64)
    dropout: float = 0.3
    batch: int = 256
    rate: float = 1e-3
    epochs: int = 100
    patience: int = 10
    seed: int = 42
    #: Rows that one part trains on, about; at most ``most_parts`` parts, whose weights are averaged.
    part_rows: int = 20_000
    most_parts: int = 256


Weights = list[np.ndarray]
#: Rows of one packed matrix.
_PACK = 8192


def _begin(sizes: list[int], seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:]):
        bound = 1 / np.sqrt(a)
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, sizes: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out += [flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]]
        at += a * b + b
    return out


def probabilities(weights: Weights, x: np.ndarray) -> np.ndarray:
    for i in range(0, len(weights) - 2, 2):
        x = np.maximum(x @ weights[i] + weights[i + 1], 0)
    return 1 / (1 + np.exp(-(x @ weights[-2] + weights[-1])[:, 0]))


def gradient(weights: Weights, x: np.ndarray, y: np.ndarray, pos_weight: float, masks: list[np.ndarray] | None = None) -> tuple[float, Weights]:
    """Mean weighted cross-entropy of a batch and its gradient; ``masks`` are the dropout factors of the hidden layers."""
    layers = len(weights) // 2
    seen, h = [x], x
    for i in range(layers - 1):
        h = np.maximum(h @ weights[2 * i] + weights[2 * i + 1], 0)
        h = h * masks[i] if masks else h
        seen.append(h)
    z = (h @ weights[-2] + weights[-1])[:, 0]
    p, w = 1 / (1 + np.exp(-z)), np.where(y == 1, pos_weight, 1.0)
    loss = float(np.mean(w * (np.logaddexp(0, z) - y * z)))
    back, out = (w * (p - y) / len(y))[:, None], [np.zeros(0)] * len(weights)
    for i in reversed(range(layers)):
        out[2 * i], out[2 * i + 1] = seen[i].T @ back, back.sum(0)
        if i:
            back = (back @ weights[2 * i].T) * (seen[i] > 0)
            back = back * masks[i - 1] if masks else back
    return loss, out


def _epoch(flat: np.ndarray, adam: tuple[np.ndarray, np.ndarray, int], x: np.ndarray, y: np.ndarray, sizes: list[int], pos_weight: float, settings: Perceptron, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One pass over the rows of a part in random order."""
    flat, (m, v, steps) = flat.copy(), adam
    order = rng.permutation(len(y))
    keep = 1 - settings.dropout
    for at in range(0, len(y), settings.batch):
        rows = order[at : at + settings.batch]
        masks = [(rng.random((len(rows), n)) < keep) / keep for n in sizes[1:-1]] if settings.dropout else None
        g = _flat(gradient(_shaped(flat, sizes), x[rows], y[rows], pos_weight, masks)[1])
        steps += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat -= settings.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return flat, m, v, steps


@dataclass(frozen=True)
class Fitted:
    """``best_round``: the epoch (from 1) whose weights are kept; ``curve``: (epoch, AUROC) on the validation rows."""

    weights: np.ndarray
    sizes: list[int]
    mean: np.ndarray
    best_round: int
    curve: list[tuple[int, float | None]] = field(default_factory=list)

    def scored(self, rows: DataFrame) -> DataFrame:
        weights, mean = _shaped(self.weights, self.sizes), self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.stack(pdf["x"]) - mean if len(pdf) else np.zeros((0, len(mean)))
                yield pd.DataFrame({"hadm_id": pdf["hadm_id"], "label": pdf["label"], "score": probabilities(weights, x)})

        return rows.select("hadm_id", "label", vector_to_array("features").alias("x")).mapInPandas(run, "hadm_id BIGINT, label INT, score DOUBLE")

    def curve_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.curve, "epoch INT, AUROC DOUBLE")


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """(p, n, x, y): the rows (hadm_id, label, x, p) of each part by case id, as matrices of up to ``_PACK`` rows, written down.

    A part lies in one partition, so the epochs read it where it is and exchange nothing but weights."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, own in pdf.groupby("p"):
                for at in range(0, len(own), _PACK):
                    cut = own.iloc[at : at + _PACK]
                    x, y = np.stack(cut["x"]).astype(np.float64), cut["label"].to_numpy(np.float64)
                    yield pd.DataFrame({"p": [p], "n": [len(cut)], "x": [x.tobytes()], "y": [y.tobytes()]})

    placed = rows.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "hadm_id")
    return durable(placed.mapInPandas(pack, "p INT, n BIGINT, x BINARY, y BINARY"))


def _matrix(packs: pd.DataFrame, size: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b).reshape(-1, size) for b in packs["x"]])


def _learner(state: tuple, mean: np.ndarray, sizes: list[int], pos_weight: float, settings: Perceptron, epoch: int):
    """One epoch on each part of a partition, from ``state`` = (weights, Adam's two moments, steps so far)."""

    def one(p: int, packs: pd.DataFrame) -> pd.DataFrame:
        flat, m, v, steps = state
        x, y = _matrix(packs, sizes[0]) - mean, np.concatenate([np.frombuffer(b) for b in packs["y"]])
        rng = np.random.default_rng([settings.seed, epoch, p])
        *after, steps = _epoch(flat, (m, v, steps), x, y, sizes, pos_weight, settings, rng)
        return pd.DataFrame({"p": [p], "n": [len(y)], "steps": [steps], "sums": [(np.concatenate(after) * len(y)).tobytes()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = -1, []
        for pdf in batches:
            for p, own in pdf.groupby("p"):  # ascending, as the parts lie
                if held and p != at:
                    yield one(at, pd.concat(held))
                    held = []
                at, held = int(p), [*held, own]
        if held:
            yield one(at, pd.concat(held))

    return learn


def _summed(sent: DataFrame) -> pd.Series:
    """The parts' weights added up: first in groups on the executors, then what is left of them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf.sort_values("p")["sums"])
        return pd.DataFrame({"p": [int(pdf["p"].min())], "n": [int(pdf["n"].sum())], "steps": [int(pdf["steps"].max())], "sums": [total.tobytes()]})

    schema = "p INT, n BIGINT, steps BIGINT, sums BINARY"
    few = sent.groupBy(F.floor(F.col("p") / 16).alias("g")).applyInPandas(lambda pdf: add(pdf), schema)
    return add(few.toPandas()).iloc[0]  # a row per 16 parts


def fit_perceptron(view: View, settings: Perceptron = Perceptron()) -> Fitted:
    """Train on ``view.train``, stop by ``view.part("val")``.  The class weight is negatives by positives, in the loss."""
    n, pos = view.train.agg(F.count("label"), F.count_if(F.col("label") == 1)).first()
    parts = int(min(settings.most_parts, max(1, -(-n // settings.part_rows))))
    pos_weight = (n - pos) / max(pos, 1)
    x = vector_to_array("features").alias("x")
    train = _packed(view.train.select("hadm_id", F.col("label").cast("int").alias("label"), x, F.pmod(F.xxhash64("hadm_id"), F.lit(parts)).cast("int").alias("p")), parts)
    val = durable(view.part("val").select("hadm_id", F.col("label").cast("int").alias("label"), "features"))
    sizes = [view.size, *settings.hidden, 1]
    mean = _means(train, view.size)
    flat = _flat(_begin(sizes, settings.seed))
    m, v, steps = np.zeros_like(flat), np.zeros_like(flat), 0
    best, best_flat, best_round, curve = -1.0, flat, 0, []

    # Whether the validation rows are many enough to be ordered in segments is found out once.
    with ordered.known_hot(run=lambda: val.select(F.lit(1).alias("run"))):
        for epoch in range(1, settings.epochs + 1):
            learn = _learner((flat, m, v, steps), mean, sizes, pos_weight, settings, epoch)
            found = _summed(train.mapInPandas(learn, "p INT, n BIGINT, steps BIGINT, sums BINARY"))
            flat, m, v = np.split(np.frombuffer(found["sums"]) / found["n"], 3)
            steps = int(found["steps"])
            row = metrics.rank_metrics(Fitted(flat, sizes, mean, epoch).scored(val).withColumn("run", F.lit(1)), ["run"], 6).first()
            auroc = row["AUROC"] if row else None
            curve.append((epoch, auroc))
            if auroc is not None and auroc > best + 1e-6:
                best, best_flat, best_round = auroc, flat, epoch
            elif epoch - best_round >= settings.patience:
                break
    return Fitted(best_flat if best_round else flat, sizes, mean, best_round, curve)


def _means(train: DataFrame, size: int) -> np.ndarray:
    """Means of the packed training rows: the network sees centred inputs, which the sparse vectors are not."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"at": range(size), "s": _matrix(pdf, size).sum(0), "n": int(pdf["n"].sum())})

    rows = train.select("n", "x").mapInPandas(sums, "at INT, s DOUBLE, n BIGINT").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows["at"]] = rows["s"] / rows["n"]
    return out
