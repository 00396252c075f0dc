"""Many ridge-penalised logistic models on slices of one matrix, fitted side by side by Newton steps.

Each round is one job for all models: every partition adds up gradient and curvature of each, the sums are added per
model, and one small system per model is solved.  The training rows are packed once and stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import durable

#: Rows of one packed matrix.
_PACK = 4096
_SUMS = "model INT, sums BINARY"


def _packed(train: DataFrame) -> DataFrame:
    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), _PACK):
                own = pdf.iloc[at : at + _PACK]
                x, yw = np.stack(own["x"]).astype(float), own[["label", "weight"]].to_numpy(float)
                yield pd.DataFrame({"n": [len(own)], "x": [x.tobytes()], "yw": [yw.tobytes()]})

    rows = train.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("x"))
    return durable(rows.mapInPandas(pack, "n INT, x BINARY, yw BINARY"))


def _chance(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _round(packs: DataFrame, slices: list[np.ndarray], betas: dict[int, np.ndarray]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """Per model: sum of weights, loss, gradient and curvature at its coefficients, the intercept last."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for n, raw, yw in zip(pdf["n"], pdf["x"], pdf["yw"]):
                x, (y, w) = np.frombuffer(raw).reshape(n, -1), np.frombuffer(yw).reshape(n, 2).T
                for i, beta in betas.items():
                    own = np.column_stack([x[:, slices[i]], np.ones(n)])
                    z = own @ beta
                    p = _chance(z)
                    bent = own.T @ (own * (w * p * (1 - p))[:, None])
                    found = np.concatenate([[w.sum(), (w * (np.logaddexp(0, z) - y * z)).sum()], own.T @ (w * (p - y)), bent.ravel()])
                    sums[i] = sums.get(i, 0) + found
        if sums:
            for i, s in sums.items():
                yield pd.DataFrame({"model": [i], "sums": [s.tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "sums": [sum(np.frombuffer(b) for b in sorted(pdf["sums"])).tobytes()]})

    out = {}
    for r in packs.mapInPandas(add, _SUMS).groupBy("model").applyInPandas(total, _SUMS).collect():  # a row per model
        s, k = np.frombuffer(r["sums"]), len(betas[r["model"]])
        out[r["model"]] = (s[0], s[1], s[2 : 2 + k], s[2 + k :].reshape(k, k))
    return out


def fit_ridges(train: DataFrame, slices: list[np.ndarray], rounds: int = 100, tol: float = 1e-9) -> list[np.ndarray]:
    """Coefficients and intercept of each slice of the inputs of (label, weight, features).

    The penalty is of strength 1 on the summed loss, as in ``models.logistic``.  A step that does not lower the loss is halved.
    A model is done once no component of its gradient (of the mean loss) is above ``tol``."""
    packs = _packed(train)
    n = max(packs.agg(F.sum("n")).first()[0] or 0, 1)
    best = [np.zeros(len(s) + 1) for s in slices]
    loss, step, tried = [np.inf] * len(slices), [np.zeros(len(s) + 1) for s in slices], dict(enumerate(best))
    for _ in range(rounds):
        found = _round(packs, slices, tried)
        following = {}
        for i, (weight, value, slope, bent) in found.items():
            beta, free = tried[i], np.append(np.ones(len(slices[i])), 0.0)
            value = value / weight + (free * beta**2).sum() / (2 * n)
            if value > loss[i] + 1e-12 * abs(loss[i]):
                step[i] = step[i] / 2
                if abs(step[i]).max() > 1e-12:
                    following[i] = best[i] - step[i]
                continue
            best[i], loss[i] = beta, value
            slope = slope / weight + free * beta / n
            if abs(slope).max() > tol:
                step[i] = np.linalg.solve(bent / weight + np.diag(free / n) + 1e-14 * np.eye(len(beta)), slope)
                following[i] = beta - step[i]
        tried = following
        if not tried:
            break
    return best


def ridge_scores(rows: DataFrame, slices: list[np.ndarray], betas: list[np.ndarray], names: list[str]) -> DataFrame:
    """(cell, hadm_id, label, score): every row by every model, ``names`` are the cells."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                for own, beta, name in zip(slices, betas, names):
                    yield pd.DataFrame({"cell": name, "hadm_id": pdf["hadm_id"], "label": pdf["label"], "score": _chance(x[:, own] @ beta[:-1] + beta[-1])})

    kept = rows.select("hadm_id", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
    return kept.mapInPandas(run, "cell STRING, hadm_id BIGINT, label INT, score DOUBLE")
