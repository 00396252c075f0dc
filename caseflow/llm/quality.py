"""Quality of documents from a linear-chain conditional random field over their lines.

Every line of a text is good or bad.  A line's features are rates of its own signs and words and
those of the lines before and after it; a two-state chain ties neighbouring labels.  Forward and
backward sums give each line's chance of being good; weighted by length they make the document's
score, which a logistic curve fitted on the same sample turns into a chance of label 1.

The chain is fitted on a bounded sample of labelled documents, whose lines all carry the
document's label.  Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import record_batch, texts
from caseflow.llm.shingles import word_hashes

LINE_END = 10
#: Bytes of text whose lines are measured together.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Fitting:
    """``sample`` labelled documents of at most ``largest`` bytes, those with the smallest hash of their id, are fitted on."""

    sample: int = 6000
    largest: int = 1 << 16
    folds: int = 5
    rounds: int = 200
    rate: float = 0.1
    penalty: float = 1e-3


@dataclass
class Model:
    weights: np.ndarray  # of the good label against the bad one
    chain: np.ndarray  # 2 x 2, from a label (bad, good) to the next
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    base: float = 0.5
    flat: bool = field(default=False)


_SIGNS = np.arange(256)
_CLASSES = {
    "upper": (_SIGNS >= 65) & (_SIGNS <= 90),
    "letter": ((_SIGNS | 32) >= 97) & ((_SIGNS | 32) <= 122) | (_SIGNS >= 128),
    "digit": (_SIGNS >= 48) & (_SIGNS <= 57),
    "symbol": np.isin(_SIGNS, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]),
    "shout": _SIGNS == ord("!"),
    "comma": _SIGNS == ord(","),
    "stop": np.isin(_SIGNS, [ord(c) for c in ".?"]),
    "far": _SIGNS >= 128,
}
OWN = 15  # features of the line itself
AROUND = 8  # of these, the leading ones are also taken from the neighbours
WIDTH = 1 + OWN + 2 * AROUND + 2


def _measure(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, document number) of every line that is not empty."""
    raw = b"\n".join(group) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == LINE_END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    document = np.searchsorted(np.cumsum([len(g) + 1 for g in group]), starts, side="right")
    full = ends > starts
    starts, ends, document = starts[full], ends[full], document[full]
    n = len(starts)
    if not n:
        return np.zeros((0, WIDTH)), np.zeros(0), document
    size = (ends - starts).astype(float)
    bounds = np.column_stack([starts, ends]).ravel()
    count = {k: np.add.reduceat(np.append(table[data], False), bounds, dtype=np.int64)[::2].astype(float) for k, table in _CLASSES.items()}
    at, words = word_hashes(raw)
    line = np.searchsorted(starts, at, side="right") - 1
    n_words = np.maximum(np.bincount(line, minlength=n), 1).astype(float)
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (line[1:] == line[:-1])])
    order = np.lexsort((words, line))
    fresh = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])])[: len(order)]
    distinct = np.bincount(line[order][fresh], minlength=n)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, words)
    same = np.lexsort((whole, document))
    copy = np.zeros(n)
    copy[same[1:]] = (whole[same][1:] == whole[same][:-1]) & (document[same][1:] == document[same][:-1])
    own = np.column_stack([
        count["upper"] / (count["letter"] + 1), count["symbol"] / size, count["shout"] / n_words, np.bincount(line, again, minlength=n) / n_words,
        1 - distinct / n_words, count["digit"] / size, copy, count["stop"] / n_words,
        count["letter"] / size, size / n_words / 10, np.log1p(n_words) / 5, count["comma"] / n_words, count["far"] / size,
        _CLASSES["stop"][data[ends - 1]], _CLASSES["upper"][data[starts]],
    ])
    first = np.concatenate([[True], document[1:] != document[:-1]])
    last = np.concatenate([document[1:] != document[:-1], [True]])
    before, after = np.roll(own[:, :AROUND], 1, axis=0), np.roll(own[:, :AROUND], -1, axis=0)
    before[first], after[last] = own[first, :AROUND], own[last, :AROUND]
    return np.column_stack([np.ones(n), own, before, after, first, last]).astype(float), size, document


def _chances(scores: np.ndarray, document: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line: the chance of good, and the chances of its label pair with the line before (2 x 2, zero for first lines).

    All documents advance together: step t handles the t-th line of each that has one.
    """
    n = len(scores)
    first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
    lengths = np.diff(np.append(first, n))
    longest = np.argsort(-lengths, kind="stable")
    first, lengths = first[longest], lengths[longest]
    local = np.exp(np.column_stack([-scores / 2, scores / 2]).clip(-30, 30))
    step = np.exp(chain)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[first] = local[first]
    forward[first] /= forward[first].sum(axis=1, keepdims=True)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if n else []
    for t in range(1, len(alive)):
        now = first[: alive[t]] + t
        value = (forward[now - 1] @ step) * local[now]
        forward[now] = value / value.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 1, 0, -1):
        now = first[: alive[t]] + t
        value = (backward[now] * local[now]) @ step.T
        backward[now - 1] = value / value.sum(axis=1, keepdims=True)
    good = forward * backward
    good = good[:, 1] / good.sum(axis=1)
    pairs = np.zeros((n, 2, 2))
    inner = np.setdiff1d(np.arange(n), first, assume_unique=True)
    value = forward[inner - 1][:, :, None] * step[None] * (local[inner] * backward[inner])[:, None, :]
    pairs[inner] = value / value.sum(axis=(1, 2), keepdims=True)
    return good, pairs


def _scores(model: Model, features: np.ndarray) -> np.ndarray:
    return ((features - model.mean) / model.spread) @ model.weights


def fit_chain(features: np.ndarray, size: np.ndarray, document: np.ndarray, labels: np.ndarray, fitting: Fitting) -> Model:
    """Gradient ascent on the lines' conditional likelihood, with moments; then the curve from line chances to labels.

    Documents of either label weigh the same in sum, and a document's weight is shared by its lines.
    """
    line_label = labels[document].astype(float)
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    mean[0], spread[0] = 0.0, 1.0
    model = Model(np.zeros(features.shape[1]), np.zeros((2, 2)), mean, spread, base=float(labels.mean()))
    x = (features - mean) / spread
    per_line = np.bincount(document, minlength=len(labels))[document]
    weight = np.where(line_label == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) / per_line
    inner = np.concatenate([[False], document[1:] == document[:-1]])
    told = np.zeros((2, 2))
    np.add.at(told, (line_label.astype(int), line_label.astype(int)), weight * inner)
    first_w, first_c = np.zeros_like(model.weights), np.zeros((2, 2))
    second_w, second_c = np.zeros_like(model.weights), np.zeros((2, 2))
    for t in range(1, fitting.rounds + 1):
        good, pairs = _chances(x @ model.weights, document, model.chain)
        up_w = x.T @ (weight * (line_label - good)) - fitting.penalty * model.weights
        up_c = told - (pairs * weight[:, None, None]).sum(axis=0) - fitting.penalty * model.chain
        for value, up, first, second in ((model.weights, up_w, first_w, second_w), (model.chain, up_c, first_c, second_c)):
            first += 0.1 * (up - first)
            second += 0.01 * (up * up - second)
            value += fitting.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    share = np.clip(_document_share(model, features, size, document, len(labels)), 1e-6, 1 - 1e-6)
    z = np.log(share / (1 - share))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve in one variable
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        v = p * (1 - p)
        hessian = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([((labels - p) * z).sum() - 1e-3 * (slope - 1), (labels - p).sum()]))
        slope, shift = max(slope + step[0], 1e-3), shift + step[1]
    model.slope, model.shift = float(slope), float(shift)
    return model


def _document_share(model: Model, features: np.ndarray, size: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Share of a document's bytes that lie on good lines, in expectation; NaN without lines."""
    good, _ = _chances(_scores(model, features), document, model.chain) if len(features) else (np.zeros(0), None)
    with np.errstate(invalid="ignore"):
        return np.bincount(document, good * size, minlength=n) / np.bincount(document, size, minlength=n)


def document_scores(model: Model, group: list[bytes]) -> np.ndarray:
    if model.flat:
        return np.full(len(group), model.base)
    share = np.clip(_document_share(model, *_measure(group), len(group)), 1e-6, 1 - 1e-6)
    score = 1 / (1 + np.exp(-np.clip(model.slope * np.log(share / (1 - share)) + model.shift, -30, 30)))
    return np.where(np.isnan(score), model.base, score)


def _grouped(values: Iterator[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, fitting: Fitting = Fitting(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The chain fitted on the bounded sample; a flat model where the labels seen are all alike."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.filter(~held_out(F.col("doc_id"), fitting.folds)).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.filter(F.octet_length("text") <= fitting.largest)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitting.sample)
    sample = rows.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = [], []
            for value in texts(batch, "text"):
                features, size, _ = _measure([value])
                values.append(features.astype("<f8").tobytes())
                sizes.append(size.astype("<f8").tobytes())
            yield record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "features": pa.array(values, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    found = sample.mapInArrow(measure, "doc_id long, label int, features binary, sizes binary").filter("octet_length(sizes) > 0")
    table = {r["doc_id"]: r for r in found.toLocalIterator()}
    rows_ = [table[k] for k in sorted(table)]
    marks = np.array([r["label"] for r in rows_], int)
    if not len(rows_) or marks.min() == marks.max():
        seen = float(marks.mean()) if len(rows_) else 0.5
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH), base=seen, flat=True)
    features = np.concatenate([np.frombuffer(r["features"], "<f8").reshape(-1, WIDTH) for r in rows_])
    sizes = [np.frombuffer(r["sizes"], "<f8") for r in rows_]
    document = np.repeat(np.arange(len(rows_)), [len(s) for s in sizes])
    return fit_chain(features, np.concatenate(sizes), document, marks, fitting)


def scored(docs: DataFrame, model: Model, least: float = 0.3, folds: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    NULL counts as the empty text; texts without a line that is not empty score the sample's share of label 1.
    Rows that are there twice are answered twice; a NULL id is scored and never held out; no rows give none.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_scores(model, group) for group in _grouped(texts(batch, "text"))]
            values = np.concatenate(found) if found else np.zeros(0)
            yield record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(values, pa.float64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(score, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_rejected(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose text scores ``least`` or more, all columns kept; decided where the row lies, without a join."""
    columns = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_scores(model, group) for group in _grouped(texts(batch, text))]
            yield batch.filter(pa.array(np.concatenate(found) >= least if found else np.zeros(0, bool)))

    return docs.select(*columns).mapInArrow(keep, docs.schema)
