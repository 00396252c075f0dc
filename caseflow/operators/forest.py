"""Random forest whose trees begin over Spark partitions and end inside tasks.

Values are cut into at most 32 bins.  A node with more rows than a task shall hold is split by histograms that are
added up over all partitions, one job for all trees of a level.  Once a node is small enough, its rows meet in one
group, and the rest of its tree is grown there to the full depth.  What a level costs hence does not grow with
the number of nodes below it.

The bootstrap draws how often a row counts from its id, the tree and the seed, and features from the node, so
a lost task repeats itself.  Sums are whole numbers per class and do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.design import dense, entries
from caseflow.session import durable

BINS = 32
#: Rows of a node that one task holds, and bytes of their bins; a chunk of rows is cut and dealt at once.
NODE_ROWS = 131_072
NODE_BYTES = 64 << 20
_CHUNK = 8192
#: Values that the nodes of a piece are drawn from at once; a node's count of class 1 stands beside its count of rows in one sum.
_PIECE = 1 << 18
_BOTH = 2.0**26
_UNPACK = 1024
# P(count <= i) of a Poisson count of mean 1, which stands for drawing n rows with replacement.
_DRAWN = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)])
_PACK = "tree INT, node INT, ids BINARY, keys BINARY, x BINARY, y BINARY, n BINARY"
_GROWN = "tree INT, node INT, feature BINARY, bin BINARY, child BINARY, score BINARY"
_SPLIT = "tree INT, node INT, feature INT, bin INT, counts ARRAY<DOUBLE>"


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    leaf: int
    seed: int
    node_rows: int = NODE_ROWS


def edges(rows: DataFrame, size: int) -> list[np.ndarray]:
    """Ascending borders of each input: 0 and quantiles of its other values; x lies in the bin of the first border >= x."""
    found = rows.select(F.inline(F.arrays_zip(*entries("features", "at", "x")))).filter("x <> 0")
    shares = F.array(*[F.lit(i / (BINS - 2)) for i in range(BINS - 1)])
    found = found.groupBy("at").agg(F.percentile_approx("x", shares, F.lit(10_000)).alias("q")).toPandas()  # a row per input
    cuts = dict(zip(found["at"], found["q"]))
    return [np.unique([0.0, *cuts.get(j, [])])[: BINS - 1] for j in range(size)]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def _widths(cuts: list[np.ndarray]) -> np.ndarray:
    """Bits that a bin of each input takes."""
    return np.array([len(c).bit_length() for c in cuts], np.int64)


def _packed(x: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Rows of bins as bits, the lowest of all inputs first: most inputs have two bins, and these rows travel once per tree."""
    x = x[:, np.argsort(-widths, kind="stable")]
    planes = [(x[:, : np.count_nonzero(widths > b)] >> b) & 1 for b in range(int(widths.max(initial=0)))]
    return np.packbits(np.concatenate([*planes, np.zeros((len(x), 0), np.uint8)], 1), axis=1)


def _unpacked(raw: bytes, rows: int, widths: np.ndarray) -> np.ndarray:
    raw, out = np.frombuffer(raw, np.uint8).reshape(rows, -(-int(widths.sum()) // 8)), np.zeros((rows, len(widths)), np.uint8)
    place = np.argsort(np.argsort(-widths, kind="stable"))
    for at in range(0, rows, _UNPACK):
        bits = np.unpackbits(raw[at : at + _UNPACK], axis=1)
        x = bits[:, : len(widths)].copy()
        begin = len(widths)
        for b in range(1, int(widths.max(initial=0))):
            own = np.count_nonzero(widths > b)
            x[:, :own] |= bits[:, begin : begin + own] << b
            begin += own
        np.take(x, place, 1, out=out[at : at + _UNPACK], mode="clip")
    return out


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree, by a mix of its id, the tree and the seed."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_DRAWN, (z >> np.uint64(11)) / 2.0**53, side="right").astype(np.uint8)


def _chosen(nodes: int, size: int, rng) -> np.ndarray:
    """ceil(sqrt(size)) inputs for each node."""
    return np.argpartition(rng.random((nodes, size)), min(size - 1, int(np.ceil(size**0.5))), axis=1)[:, : int(np.ceil(size**0.5))]


def _impurity(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Gini impurity times weight."""
    return 2 * pos * neg / np.maximum(pos + neg, 1e-300)


def _best(hist: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Gain and last left bin of the best split of each node on one input; a gain of 0 is none."""
    left = hist.cumsum(1)
    right = left[:, -1:] - left
    pos, neg = left[..., 1] * weights[1], left[..., 0] * weights[0]
    all_pos, all_neg = pos[:, -1:], neg[:, -1:]
    gain = _impurity(all_pos, all_neg) - _impurity(pos, neg) - _impurity(all_pos - pos, all_neg - neg)
    gain[(left.sum(2) < max(leaf, 1)) | (right.sum(2) < max(leaf, 1))] = 0
    gain[gain <= 1e-9 * np.maximum(all_pos + all_neg, 1e-300)[:, 0][:, None]] = 0
    at = gain.argmax(1)
    return gain[np.arange(len(gain)), at], at


def _score(counts: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    pos, neg = counts[:, 1] * weights[1], counts[:, 0] * weights[0]
    return pos / np.maximum(pos + neg, 1e-300)


def _parted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class 0 and 1 out of sums of ``n * (1 + _BOTH * y)``; whole numbers below 2^53, hence exact."""
    pos = np.floor(both / _BOTH)
    return both - pos * (_BOTH + 1), pos


def _splits(x: np.ndarray, at: np.ndarray, both: np.ndarray, totals: np.ndarray, bins: np.ndarray, feats: np.ndarray, weights: tuple[float, float], leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes can be split, by which input, and the last left bin: the best of the inputs drawn for a node, the first of equals.

    Rows are ordered by their node ``at``.  An input has as many cells in a node as it has bins."""
    nodes, k = feats.shape
    cells = bins[feats].ravel()
    end = np.cumsum(cells)
    first = end - cells
    value = x.ravel().take(np.arange(0, x.size, x.shape[1])[:, None] + feats[at])
    sums = np.bincount((first.reshape(nodes, k)[at] + value).ravel(), np.repeat(both, k), end[-1])
    pair = np.repeat(np.arange(nodes * k), cells)
    left = np.cumsum(sums)
    left -= np.append(0.0, left)[first][pair]
    # With nothing on one side there is no split, as for most inputs of a small node.
    some = np.nonzero((left > 0) & (left < totals[pair // k]))[0]
    pair, left = pair[some], left[some]
    node = pair // k
    (neg, pos), (all_neg, all_pos) = _parted(left), _parted(totals[node])
    if leaf > 1:
        some_, n = some, neg + pos
        wide = (n >= leaf) & (all_neg + all_pos - n >= leaf)
        some, pair, node, neg, pos, all_neg, all_pos = (v[wide] for v in (some_, pair, node, neg, pos, all_neg, all_pos))
    neg, all_neg, pos, all_pos = neg * weights[0], all_neg * weights[0], pos * weights[1], all_pos * weights[1]
    gain = _impurity(all_pos, all_neg) - _impurity(pos, neg) - _impurity(all_pos - pos, all_neg - neg)
    good = gain > np.maximum(1e-9 * np.maximum(all_pos + all_neg, 1e-300), 0)
    some, pair, node, gain = some[good], pair[good], node[good], gain[good]
    begin = np.nonzero(np.append(True, node[1:] != node[:-1]))[0] if len(node) else np.zeros(0, np.int64)
    top = np.repeat(np.maximum.reduceat(gain, begin), np.diff(np.append(begin, len(node)))) if len(node) else gain
    hit = np.nonzero(gain == top)[0]
    hit = hit[np.append(True, node[hit][1:] != node[hit][:-1])] if len(hit) else hit
    return node[hit], feats.ravel()[pair[hit]], some[hit] - first[pair[hit]]


def grow(x: np.ndarray, y: np.ndarray, n: np.ndarray, weights: tuple[float, float], depth: int, leaf: int, rng) -> tuple[np.ndarray, ...]:
    """A tree on binned rows, level by level: input (-1: leaf), last left bin, left child (the right one follows), score.

    The nodes of a level are split in pieces of ``_PIECE`` drawn values, about, so that a piece stays in the cache."""
    feature, cut, child, score = [], [], [], []
    size, both = x.shape[1], n * (1 + _BOTH * y)
    bins, k = x.max(0, initial=0).astype(np.int64) + 1, int(np.ceil(size**0.5))
    at, first, nodes = np.zeros(len(y), np.int64), 0, 1
    for level in range(depth + 1):
        totals = np.bincount(at, both, nodes + 1)[:nodes]  # behind the nodes: rows that came to a leaf
        counts = np.stack(_parted(totals), 1)
        score.append(_score(counts, weights))
        own, cuts = np.full(nodes, -1, np.int32), np.zeros(nodes, np.uint8)
        open_ = np.nonzero((counts.min(1) > 0) & (counts.sum(1) >= 2 * leaf))[0] if level < depth and size else np.zeros(0, np.int64)
        place = np.full(nodes + 1, -1, np.int64)
        place[open_] = np.arange(len(open_))
        # Rows lie node by node, so that what a piece reads is near.
        at = place[at]
        order = np.nonzero(at >= 0)[0]
        order = order[np.argsort(at[order].astype(np.uint16 if len(open_) <= 65536 else np.int64), kind="stable")]
        x, both, at = x.take(order, 0), both[order], at[order]
        begin = np.searchsorted(at, np.arange(len(open_) + 1))
        # A piece ends with a node; one of many rows is a piece of its own.
        pieces = np.unique((begin[:-1] * k + np.arange(len(open_)) * size) // _PIECE, return_index=True)[1]
        for lo, hi in zip(pieces, [*pieces[1:], len(open_)]):
            a, b = begin[lo], begin[hi]
            node, feat, last = _splits(x[a:b], at[a:b] - lo, both[a:b], totals[open_[lo:hi]], bins, _chosen(hi - lo, size, rng), weights, leaf)
            own[open_[lo + node]], cuts[open_[lo + node]] = feat, last
        split = own >= 0
        kids = np.full(nodes, -1, np.int32)
        kids[split] = first + nodes + 2 * np.arange(split.sum())
        feature.append(own), cut.append(cuts), child.append(kids)
        if not split.any():
            break
        at = open_[at]
        right = x.ravel().take(np.arange(0, x.size, size) + np.maximum(own[at], 0)) > cuts[at]
        at = np.where(split[at], kids[at] - first - nodes + right, 2 * int(split.sum()))
        first, nodes = first + nodes, 2 * int(split.sum())
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(score)


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The leaf each row comes to."""
    at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        moving = moving[feature[at[moving]] >= 0]
        if not len(moving):
            return at
        own = at[moving]
        at[moving] = child[own] + (x[moving, feature[own]] > cut[own])


class _Top:
    """The splits above the groups, per tree: as long as every node is small, a root that is a leaf."""

    def __init__(self, trees: int):
        self.feature, self.cut, self.child = ([[v] for _ in range(trees)] for v in (-1, 0, -1))

    def split(self, tree: int, node: int, feature: int, cut: int) -> int:
        left = len(self.feature[tree])
        self.feature[tree][node], self.cut[tree][node], self.child[tree][node] = feature, cut, left
        for rows, v in ((self.feature, -1), (self.cut, 0), (self.child, -1)):
            rows[tree] += [v, v]
        return left

    def walk(self, tree: int, x: np.ndarray) -> np.ndarray:
        return walk(x, *(np.asarray(rows[tree]) for rows in (self.feature, self.cut, self.child)))


def _chunks(batches, cuts: list[np.ndarray]):
    """(ids, keys, binned rows, the same packed, labels) of at most ``_CHUNK`` rows."""
    widths = _widths(cuts)
    for pdf in batches:
        for at in range(0, len(pdf), _CHUNK):
            own = pdf.iloc[at : at + _CHUNK]
            if "bins" in own:
                raw = b"".join(own["bins"])
                x = _unpacked(raw, len(own), widths)
                packed = np.frombuffer(raw, np.uint8).reshape(len(own), -(-int(widths.sum()) // 8))
            else:
                x = _binned(dense(own, len(cuts)), cuts)
                packed = _packed(x, widths)
            yield own["hadm_id"].to_numpy(np.int64), own["key"].to_numpy(np.int64), x, packed, own["label"].to_numpy(np.int64)


def _dealt(rows: DataFrame, cuts: list[np.ndarray], top: _Top, s: Settings, closed: set | None = None, every: bool = False) -> DataFrame:
    """The rows of each tree's nodes in packs; ``every`` row once (to be scored), or as often as drawn (to be fitted)."""

    def deal(batches):
        for ids, keys, x, packed, y in _chunks(batches, cuts):
            for tree in range(s.trees):
                n = np.ones(len(ids), np.uint8) if every else drawn(ids, tree, s.seed)
                at = top.walk(tree, x)
                out = []
                for node in np.unique(at):
                    if closed and (tree, int(node)) in closed:
                        continue
                    own = np.nonzero((at == node) & (n > 0))[0]
                    if len(own):
                        whose = (ids[own].tobytes(), keys[own].tobytes()) if every else (b"", b"")
                        out.append((tree, int(node), *whose, packed[own].tobytes(), y[own].astype(np.uint8).tobytes(), n[own].tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["tree", "node", "ids", "keys", "x", "y", "n"])

    return rows.mapInPandas(deal, _PACK)


def _joined(packs: pd.Series, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(packs), kind)


def _most(s: Settings, size: int) -> int:
    """Rows of a node that are grown in one group."""
    return max(1, min(s.node_rows, NODE_BYTES // max(1, size), int(_BOTH) // 2))


def _tasks(s: Settings, rows: int, size: int) -> int:
    """Tasks that the groups are dealt to: their rows take little space and much work, which merging by bytes would put in a few tasks."""
    return max(1, -(-2 * s.trees * rows // _most(s, size)))


def _plain(rows: DataFrame, *keep: str) -> DataFrame:
    """(hadm_id, key, label, keep, i, v): the vectors as places and values; ``key`` tells rows of one id apart."""
    x = entries("features")
    return rows.select("hadm_id", F.xxhash64(*x).alias("key"), F.col("label").cast("long").alias("label"), *keep, *x)


@dataclass(frozen=True)
class Forest:
    """``grown``: a row per group with what grew in it, written down; ``top``: the splits above, ``cuts``: borders of the bins."""

    grown: DataFrame
    top: _Top
    cuts: list[np.ndarray]
    settings: Settings
    n_train: int

    def scored(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(hadm_id, label, keep, score): mean share of class 1 in the leaves of all trees."""
        widths = _widths(self.cuts)
        asked = durable(_plain(rows, *keep))
        # No group holds more rows to score than it was fitted on, about.
        parts = max(1, -(-asked.count() // max(1, self.n_train, self.settings.node_rows)))
        packs = _dealt(asked.select("hadm_id", "key", "label", "i", "v"), self.cuts, self.top, self.settings, every=True)
        packs = packs.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
        model = self.grown.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"hadm_id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "p": np.zeros(0)})
            g = right.iloc[0]
            ids = _joined(left["ids"], np.int64)
            x = _unpacked(b"".join(left["x"]), len(ids), widths)
            leaf = walk(x, np.frombuffer(g["feature"], np.int32), np.frombuffer(g["bin"], np.uint8), np.frombuffer(g["child"], np.int32))
            return pd.DataFrame({"hadm_id": ids, "key": _joined(left["keys"], np.int64), "p": np.frombuffer(g["score"])[leaf]})

        keys, s = ["tree", "node", "part"], self.settings
        tasks = _tasks(s, asked.count(), len(self.cuts))
        votes = packs.repartition(tasks, *keys).groupBy(*keys).cogroup(model.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(score, "hadm_id BIGINT, key BIGINT, p DOUBLE")
        # 30 binary places, so that the sum does not depend on the order of the trees.
        shares = votes.groupBy("hadm_id", "key").agg((F.sum(F.round(F.col("p") * 2**30).cast("long")) / F.count(F.lit(1)) / 2**30).alias("score"))
        return asked.join(shares, ["hadm_id", "key"]).select("hadm_id", F.col("label").cast("int").alias("label"), *keep, "score")

    def save(self, folder: str) -> None:
        spark, s, top = self.grown.sparkSession, self.settings, self.top
        self.grown.write.parquet(f"{folder}/grown")
        cuts = [[float(v) for v in c] for c in self.cuts]
        row = (s.trees, s.depth, s.leaf, s.seed, s.node_rows, self.n_train, cuts, top.feature, top.cut, top.child)
        schema = "trees INT, depth INT, leaf INT, seed INT, node_rows INT, n_train BIGINT, cuts ARRAY<ARRAY<DOUBLE>>, " + ", ".join(f"{c} ARRAY<ARRAY<INT>>" for c in ("feature", "cut", "child"))
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{folder}/top")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Forest:
        r = spark.read.parquet(f"{folder}/top").first()
        top = _Top(0)
        top.feature, top.cut, top.child = r["feature"], r["cut"], r["child"]
        settings = Settings(r["trees"], r["depth"], r["leaf"], r["seed"], r["node_rows"])
        return Forest(spark.read.parquet(f"{folder}/grown"), top, [np.array(c) for c in r["cuts"]], settings, r["n_train"])


def fit_forest(train: DataFrame, size: int, settings: Settings) -> Forest:
    """Fit on rows (hadm_id, label, weight, features); the weight is one per class."""
    s = settings
    cuts = edges(train, size)
    widths = _widths(cuts)

    def cut(batches):
        for pdf in batches:
            for at in range(0, len(pdf), _CHUNK):
                own = pdf.iloc[at : at + _CHUNK]
                x = _packed(_binned(dense(own, size), cuts), widths)
                yield pd.DataFrame({"hadm_id": own["hadm_id"], "key": own["key"], "label": own["label"], "bins": [r.tobytes() for r in x]})

    rows = durable(_plain(train).mapInPandas(cut, "hadm_id BIGINT, key BIGINT, label BIGINT, bins BINARY"))
    sums = {r["label"]: (r["n"], r["w"]) for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w")).collect()}
    n_train = sum(n for n, _ in sums.values())
    weights = tuple(sums.get(c, (0, 1.0))[1] for c in (0, 1))
    most = _most(s, size)
    top, closed, level = _Top(s.trees), {}, 0
    depth_of = {(t, 0): 0 for t in range(s.trees)}
    big = [(t, 0) for t in range(s.trees)] if n_train > most else []
    while big:
        found = {(r["tree"], r["node"]): r for r in _level(rows, cuts, top, s, big, weights).collect()}  # a row per open node
        following = []
        for tree, node in big:
            r = found[tree, node]
            counts = np.array(r["counts"]).reshape(2, 2)  # left, right by class
            if r["feature"] < 0:
                closed[tree, node] = float(_score(counts.sum(0)[None], weights)[0])
                continue
            left = top.split(tree, node, r["feature"], r["bin"])
            for i, own in enumerate(counts):
                depth_of[tree, left + i] = level + 1
                if own.min() == 0 or level + 1 == s.depth:
                    closed[tree, left + i] = float(_score(own[None], weights)[0])
                elif own.sum() > most:
                    following.append((tree, left + i))
        big, level = following, level + 1

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        y = _joined(pdf["y"]).astype(np.int64)
        x = _unpacked(b"".join(pdf["x"]), len(y), widths)
        rng = np.random.default_rng([s.seed, tree, node])
        f, b, c, p = grow(x, y, _joined(pdf["n"]).astype(float), weights, s.depth - depth_of[tree, node], s.leaf, rng)
        return pd.DataFrame([(tree, node, f.astype(np.int32).tobytes(), b.tobytes(), c.astype(np.int32).tobytes(), p.tobytes())], columns=["tree", "node", "feature", "bin", "child", "score"])

    dealt = _dealt(rows, cuts, top, s, set(closed)).repartition(_tasks(s, n_train, size), "tree", "node")
    grown = dealt.groupBy("tree", "node").applyInPandas(group, _GROWN)
    if closed:
        ends = [(t, n, np.int32(-1).tobytes(), b"\0", np.int32(-1).tobytes(), np.float64(p).tobytes()) for (t, n), p in closed.items()]
        grown = grown.unionByName(rows.sparkSession.createDataFrame(ends, _GROWN))
    return Forest(durable(grown), top, cuts, s, n_train)


def _level(rows: DataFrame, cuts: list[np.ndarray], top: _Top, s: Settings, big: list[tuple[int, int]], weights: tuple[float, float]) -> DataFrame:
    """The best split of each of these nodes, or input -1, and the counts of both sides by class."""
    size = len(cuts)
    feats = {(t, n): _chosen(1, size, np.random.default_rng([s.seed, t, n, 1]))[0] for t, n in big}
    by_tree: dict[int, list[int]] = {}
    for t, n in big:
        by_tree.setdefault(t, []).append(n)

    def count(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for ids, _, x, _, y in _chunks(batches, cuts):
            for t, nodes in by_tree.items():
                n, at = drawn(ids, t, s.seed).astype(float), top.walk(t, x)
                for node in nodes:
                    own, f = np.nonzero(at == node)[0], feats[t, node]
                    key = ((np.arange(len(f)) * BINS + x[np.ix_(own, f)]) * 2 + y[own][:, None]).ravel()
                    found = np.bincount(key, np.repeat(n[own], len(f)), len(f) * BINS * 2)
                    sums[t, node] = sums.get((t, node), 0) + found
        if sums:
            for (t, node), h in sums.items():
                yield pd.DataFrame({"tree": [t], "node": [node], "hist": [h.tobytes()]})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        hist = sum(np.frombuffer(h) for h in pdf["hist"]).reshape(-1, BINS, 2)
        gain, at = _best(hist, weights, s.leaf)
        i = int(gain.argmax())
        left = hist[i, : at[i] + 1].sum(0)
        counts = [*left, *(hist[i].sum(0) - left)]
        return pd.DataFrame({"tree": [t], "node": [node], "feature": [int(feats[t, node][i]) if gain[i] > 0 else -1], "bin": [int(at[i])], "counts": [counts]})

    return rows.mapInPandas(count, "tree INT, node INT, hist BINARY").groupBy("tree", "node").applyInPandas(choose, _SPLIT)
