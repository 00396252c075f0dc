"""Repeated byte strings across documents, from common-prefix interval trees over sampled suffixes.

1. Winnowing: of every ``length`` bytes, the SEED bytes with the smallest hash mark a place.  Equal strings
   of ``length`` bytes hold equal seeds at equal places, so suffixes need to start at seeds only.
2. Seeds that two documents share are found part by part (a part holds a range of seed hashes).
3. Every occurrence of a shared seed has a context: all strings of ``length`` bytes that hold the seed lie in
   it.  Occurrences with equal contexts (by hash) are one suffix with all its places.
4. The suffixes of a part are sorted behind their seeds into an enhanced suffix array.  A stack scan
   over the common prefix lengths visits every interval of the implied tree; within an interval, the same
   scan over the suffixes' left contexts finds where left extensions differ.  Each node of both
   that is long enough is a maximal repeat (within its context) with all its occurrences.
5. A repeat covers its occurrences in all documents but the smallest one.

Seeds that very many documents share are handled by a table of window hashes instead, so that no
part ever holds an unbounded group.

Runs of a short period (blanks, dashes) hold one seed over and over.  Of these places the first and the last ones
are kept, which every string that crosses the run's border holds; the strings inside it are one range each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import bit_filter, durable, has_bit, record_batch, texts
from caseflow.llm.shingles import mix

SEED = 20


@dataclass(frozen=True)
class Repeats:
    """Strings of ``length`` bytes.  A part takes ``part_bytes`` of text on average; seeds in more than ``hot`` documents go by windows."""

    length: int = 50
    part_bytes: int = 8 << 20
    least_parts: int = 256
    hot: int = 200_000
    bits: int = 1 << 28


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_random = np.random.Generator(np.random.PCG64(11))
_BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_TAGS = _random.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = max(2 * n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]))
    return _POWERS["up"], _POWERS["down"]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The smallest (or largest) of every ``width`` neighbouring values."""
    n = 1
    while 2 * n <= width:
        values = pick(values[:-n], values[n:])
        n *= 2
    return pick(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


class Sampled:
    """A text's seeds: places, hashes, and the running sums from which any substring's hash follows."""

    def __init__(self, text: bytes, length: int, seed: int = SEED, longest: int | None = None) -> None:
        self.n, self.length, self.seed = len(text), length, seed
        data = np.frombuffer(text, np.uint8)
        up, self.down = _powers(self.n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: self.n])])
        hashes = mix((self.sums[seed:] - self.sums[:-seed]) * self.down[: self.n - seed + 1])
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        width = length - seed + 1
        least = np.pad(_slide(short, width, np.minimum), width - 1)
        # A place is marked where it is the smallest of some window that holds it.
        marked = np.flatnonzero(_slide(least, width, np.maximum) == short)
        own, inside = hashes[marked], np.zeros(len(marked), bool)
        # Within a run, the mark before or behind has the same hash: only such marks are looked at.
        alike = np.concatenate([[False], own[1:] == own[:-1], [False]])
        near = np.flatnonzero(alike[1:] | alike[:-1])
        at, same = marked[near], own[near]
        for period in range(1, (longest or periods(length)) + 1):
            if not len(near):
                break
            before, after = np.maximum(at - period, 0), np.minimum(at + period, len(hashes) - 1)
            inside[near] |= (hashes[before] == same) & (hashes[after] == same) & (after - before == 2 * period)
        self.places = marked[~inside]
        self.seeds = own[~inside]

    def contexts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes before the seed, bytes from it on, and the context's hash."""
        at = self.places[rows]
        before, behind = np.minimum(at, self.length - self.seed), np.minimum(self.n - at, self.length)
        span = (self.sums[at + behind] - self.sums[at - before]) * self.down[at - before]
        return before, behind, mix(span ^ mix(before.astype(np.uint64) * _TAGS[0] + behind.astype(np.uint64) * _TAGS[1]))

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every string of ``length`` bytes that holds one of some seeds."""
        starts = np.unique((self.places[rows][:, None] - np.arange(self.length - self.seed + 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + self.length <= self.n)]
        return starts, mix((self.sums[starts + self.length] - self.sums[starts]) * self.down[starts])


def periods(length: int) -> int:
    """The longest period that counts as a run: half the seeds of ``length`` bytes, at most 15."""
    return min((length - SEED + 1) // 2, 15)


def runs(text: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(first, stop, period) of the maximal stretches of at least ``length`` bytes that have a short period, the smallest one."""
    data = np.frombuffer(text, np.uint8)
    for period in range(1, periods(length) + 1):
        equal = data[:-period] == data[period:]
        # A stretch of equal signs that is long enough fills one of these blocks of eight.
        if not (equal[: len(equal) // 8 * 8].view("<u8") == 0x0101010101010101).any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
        for first, last in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= length - period].tolist():
            stop = last + period
            shorter = (d for d in range(1, period) if period % d == 0)
            if not any(np.array_equal(data[first : stop - d], data[first + d : stop]) for d in shorter):
                yield first, stop, period


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common prefix tree; common[i] belongs to neighbours i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        depth = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows of a byte matrix; the first is 0."""
    equal = rows[1:] == rows[:-1]
    width = rows.shape[1]
    found = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1)) if len(rows) > 1 else np.zeros(0, np.int64)
    return np.concatenate([[0], np.minimum(found, np.minimum(sizes[1:], sizes[:-1]))]).astype(np.int64)


def _sorted(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Order by group, bytes, size."""
    keys = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
    rank = np.unique(keys, return_inverse=True)[1]
    return np.lexsort((sizes, rank, groups))


def maximal_repeats(groups: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, length: int, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes left of the seed, bytes from it on, members) of every maximal repeat of at least ``length`` bytes.

    ``right`` holds what follows from the seed on, ``left`` what precedes it, nearest byte first.
    """
    order = _sorted(right, n_right, groups)
    common = _common(right[order], n_right[order])
    common[np.concatenate([[False], groups[order][1:] != groups[order][:-1]])] = 0
    by_left = np.empty(len(order), np.int64)
    by_left[_sorted(left, n_left, groups)] = np.arange(len(order))
    # Two neighbours alone in their interval are most of all cases: their left contexts are compared at once.
    beside = _common(left[order], n_left[order]).tolist() if len(order) else []
    for depth, first, last in intervals(common.tolist()):
        least = length - depth
        if depth < seed:
            continue
        members = order[first : last + 1]
        if last - first == 1:
            if beside[last] >= least:
                yield beside[last], depth, members
            continue
        at = np.argsort(by_left[members])
        # The interval's children lie between neighbours that share no more than its depth.
        child = np.concatenate([[0], np.cumsum(common[first + 1 : last + 1] == depth)])[at]
        around = _common(left[members[at]], n_left[members[at]]).tolist()
        for reach, a, b in intervals(around):
            # Also right-diverse: not all within one child.
            if reach >= least and child[a : b + 1].min() < child[a : b + 1].max():
                yield reach, depth, members[at[a : b + 1]]


def _rows(batch: pa.RecordBatch, settings: Repeats) -> Iterator[tuple[int, bytes, Sampled]]:
    for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
        if len(text) >= settings.length:
            yield doc, text, Sampled(text, settings.length)


def _dealt(part: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row a part: the part's share of every array, as bytes."""
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    ends = np.append(starts[1:], len(part))
    columns = {"part": pa.array(parts.astype(np.int64), pa.int64())}
    for name, values in arrays.items():
        values = values[order]
        columns[name] = pa.array([values[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())
    return record_batch(columns)


def _gathered(batches: Iterator[pa.RecordBatch], types: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each part, sorted by part, put together again."""
    key, held = None, {n: [] for n in types}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("part", *types)}
        for i, part in enumerate(columns["part"]):
            if part != key and key is not None:
                yield {n: np.frombuffer(b"".join(v), types[n]) for n, v in held.items()}
                held = {n: [] for n in types}
            key = part
            for n in types:
                held[n].append(columns[n][i])
    if key is not None:
        yield {n: np.frombuffer(b"".join(v), types[n]) for n, v in held.items()}


def _pairs(schema: dict[str, np.ndarray]) -> pa.RecordBatch:
    return record_batch({n: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64), pa.int64()) for n, v in schema.items()})


def shared_seeds(docs: DataFrame, settings: Repeats, parts: int) -> DataFrame:
    """(seed, n_docs) of seeds in at least two documents."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(s.seeds) for _, _, s in _rows(batch, settings)]
            if own:
                seeds, counts = np.unique(np.concatenate(own), return_counts=True)
                yield _dealt(seeds % np.uint64(parts), seeds=seeds, counts=counts.astype("<u4"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, {"seeds": "<u8", "counts": "<u4"}):
            seeds, where = np.unique(held["seeds"], return_inverse=True)
            n = np.bincount(where, held["counts"])
            yield _pairs({"seed": seeds[n > 1], "n_docs": n[n > 1]})

    dealt = docs.mapInArrow(sample, "part long, seeds binary, counts binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "seed long, n_docs long")


_FIELDS = {"seeds": "<u8", "hashes": "<u8", "docs": "<i8", "places": "<i4", "before": "u1", "behind": "u1"}


def _first_key(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Stands for a context in the smallest document that holds it."""
    return mix(hashes ^ mix(docs.astype(np.int64).view(np.uint64) * _TAGS[2]))


_STRETCHES = {"docs": "<i8", "starts": "<i4", "sizes": "<u2"}
_PACKED = "part long, docs binary, starts binary, sizes binary"
LARGEST = 1 << 15


def _packed(found: np.ndarray, parts: int) -> pa.RecordBatch:
    """Stretches (document, start, stop), packed by the part of their document."""
    docs = found[:, 0].astype("<i8")
    return _dealt(np.mod(docs, parts), docs=docs, starts=found[:, 1].astype("<i4"), sizes=(found[:, 2] - found[:, 1]).astype("<u2"))


def parts_for(docs: DataFrame, settings: Repeats) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(settings.least_parts, -(-total // settings.part_bytes)) | 1


def run_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(window, doc_id, first, stop): one row per run and rotation; the strings of ``length`` bytes with hash ``window`` that lie in it, as the range they cover."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                if len(text) < length:
                    continue
                for first, stop, period in runs(text, length):
                    for start in range(first, min(first + period, stop - length + 1)):
                        window = int.from_bytes(hashlib.blake2b(text[start : start + length], digest_size=8).digest(), "little", signed=True)
                        found.append((window, doc, start, start + (stop - length - start) // period * period + length))
            if found:
                yield record_batch({n: pa.array(v, pa.int64()) for n, v in zip(("window", "doc_id", "first", "stop"), zip(*found))})

    return docs.mapInArrow(ranges, "window long, doc_id long, first long, stop long")


def covered_runs(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """The ranges of runs that also lie in a smaller document, packed."""
    held = durable(run_ranges(docs, length))
    least = held.groupBy("window").agg(F.min("doc_id").alias("least"))
    more = held.join(least, "window").filter("doc_id > least").select("doc_id", "first", "stop")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(n).to_numpy() for n in ("doc_id", "first", "stop")])
            # A packed stretch has a size of two bytes; those that touch become one again.
            n = np.maximum(-(-(rows[:, 2] - rows[:, 1]) // LARGEST), 1)
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            rows = np.repeat(rows, n, axis=0)
            starts = rows[:, 1] + nth * LARGEST
            yield _packed(np.column_stack([rows[:, 0], starts, np.minimum(rows[:, 2], starts + LARGEST)]), parts)

    return more.mapInArrow(pack, _PACKED)


def covered(docs: DataFrame, settings: Repeats, parts: int) -> DataFrame:
    """Stretches that also stand in a smaller document, packed by their document's remainder by ``parts``; they may overlap."""
    spark, length = docs.sparkSession, settings.length
    reach, width = length - SEED, 2 * length - SEED
    shared = durable(shared_seeds(docs, settings, parts))
    bits = settings.bits
    marks = spark.sparkContext.broadcast(bit_filter(shared, "seed", bits))
    hot_marks = spark.sparkContext.broadcast(bit_filter(shared.filter(F.col("n_docs") > settings.hot), "seed", 1 << 24))

    def split(s: Sampled) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(has_bit(marks.value, s.seeds.view(np.int64), bits))
        hot = has_bit(hot_marks.value, s.seeds[rows].view(np.int64), 1 << 24)
        return rows[~hot], rows[hot]

    schema = "part long, " + ", ".join(f"{n} binary" for n in _FIELDS)

    def recorded(s: Sampled, doc: int, rows: np.ndarray) -> dict[str, np.ndarray]:
        before, behind, hashes = s.contexts(rows)
        values = (s.seeds[rows], hashes, np.full(len(rows), doc, "<i8"), s.places[rows].astype("<i4"), before.astype("u1"), behind.astype("u1"))
        return dict(zip(_FIELDS, values))

    def together(records: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if records:
            joined = {n: np.concatenate([r[n] for r in records]) for n in records[0]}
            yield _dealt(joined["seeds"] % np.uint64(parts), **joined)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from together([recorded(s, doc, split(s)[0]) for doc, _, s in _rows(batch, settings)])

    def equal_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, _FIELDS):
            yield from _by_contexts(held, parts)

    met = docs.mapInArrow(occurrences, schema).repartition("part").sortWithinPartitions("part")
    met = durable(met.mapInArrow(equal_contexts, _PACKED + ", open long"))
    open_marks = spark.sparkContext.broadcast(bit_filter(met.filter("open IS NOT NULL"), "open", bits))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for doc, text, s in _rows(batch, settings):
                record = recorded(s, doc, split(s)[0])
                fine = has_bit(open_marks.value, _first_key(record["hashes"], record["docs"]).view(np.int64), bits)
                if fine.any():
                    record = {n: v[fine] for n, v in record.items()}
                    data = np.pad(np.frombuffer(text, np.uint8), (reach, length))
                    records.append(record | {"context": data[record["places"][:, None] + np.arange(width)[None, :]]})
            yield from together(records)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, _FIELDS | {"context": "u1"}):
            yield _packed(_by_repeats(held, settings), parts)

    differing = docs.mapInArrow(contexts, schema + ", context binary").repartition("part").sortWithinPartitions("part")
    found = met.filter("open IS NULL").drop("open").unionByName(differing.mapInArrow(repeats, _PACKED))
    found = found.unionByName(covered_runs(docs, length, parts))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, _, s in _rows(batch, settings):
                rows = split(s)[1]
                if len(rows):
                    starts, hashes = s.windows(rows)
                    yield _pairs({"window": hashes, "doc_id": np.full(len(starts), doc), "start": starts})

    if shared.filter(F.col("n_docs") > settings.hot).isEmpty():
        return found
    held = durable(docs.mapInArrow(windows, "window long, doc_id long, start long"))
    least = durable(held.groupBy("window").agg(F.min("doc_id").alias("least")))
    more = held.join(least, "window").filter("doc_id > least").select("doc_id", "start")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = (batch.column(n).to_numpy() for n in ("doc_id", "start"))
            yield _packed(np.column_stack([doc, start, start + length]), parts)

    return found.unionByName(more.mapInArrow(pack, _PACKED))


def _ordered(held: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Occurrences by seed, context, document, place; and where new seeds and new contexts begin."""
    order = np.lexsort((held["places"], held["docs"], held["hashes"], held["seeds"]))
    seeds, hashes = held["seeds"][order], held["hashes"][order]
    new_seed = np.concatenate([[True], seeds[1:] != seeds[:-1]])[: len(order)]
    new_context = new_seed | np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)]
    return order, new_seed, new_context


def _by_contexts(held: dict[str, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Whole contexts that a smaller document holds too; and, as ``open``, first contexts of seeds that have several."""
    order, new_seed, new_context = _ordered(held)
    docs, hashes = held["docs"][order], held["hashes"][order]
    places, before, behind = (held[n][order].astype(np.int64) for n in ("places", "before", "behind"))
    first = np.flatnonzero(new_context)
    later = docs > docs[first][np.cumsum(new_context) - 1]
    found = _outermost(docs[later], (places - before)[later], (places + behind)[later])
    packed = _packed(found, parts)
    yield record_batch({n: packed.column(n) for n in ("part", *_STRETCHES)} | {"open": pa.nulls(packed.num_rows, pa.int64())})
    group = (np.cumsum(new_seed) - 1)[first]
    several = first[np.bincount(group)[group] > 1] if len(first) else first
    keys = np.unique(_first_key(hashes[several], docs[several])).view(np.int64)
    none = pa.nulls(len(keys), pa.binary())
    yield record_batch({"part": pa.nulls(len(keys), pa.int64())} | {n: none for n in _STRETCHES} | {"open": pa.array(keys, pa.int64())})


def _by_repeats(held: dict[str, np.ndarray], settings: Repeats) -> np.ndarray:
    """What the maximal repeats among the different contexts of a part's seeds cover."""
    length, reach = settings.length, settings.length - SEED
    order, new_seed, new_context = _ordered(held)
    docs = held["docs"][order]
    places, before, behind = (held[n][order].astype(np.int64) for n in ("places", "before", "behind"))
    context = held["context"].reshape(-1, 2 * length - SEED)[order]
    first = np.flatnonzero(new_context)
    group, owner = (np.cumsum(new_seed) - 1)[first], docs[first]
    left, right = np.ascontiguousarray(context[first][:, reach - 1 :: -1]), np.ascontiguousarray(context[first][:, reach:])
    suffixes, reaches, depths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, f, members in maximal_repeats(group, left, before[first], right, behind[first], length):
        owners = owner[members]
        later = members[owners > owners.min()]
        if len(later):
            suffixes.append(later)
            reaches.append(np.full(len(later), a))
            depths.append(np.full(len(later), f))
    suffix, a, f = (np.concatenate(x).astype(np.int64) for x in (suffixes, reaches, depths))
    # The places of a suffix in the document that owns it; elsewhere its whole context is covered already.
    own = docs == owner[np.cumsum(new_context) - 1] if len(first) else np.zeros(0, bool)
    count = np.add.reduceat(own, first, dtype=np.int64) if len(first) else first
    n = count[suffix]
    row = np.repeat(np.arange(len(suffix)), n)
    at = first[suffix][row] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return _outermost(docs[at], places[at] - a[row], places[at] + f[row])


def _outermost(docs: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """(document, start, stop) without the stretches that lie within another one of their document."""
    found = np.column_stack([docs, starts, stops])
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    if not len(found):
        return found
    fresh = np.concatenate([[True], found[1:, 0] != found[:-1, 0]])
    stop = found[:, 2] + (np.cumsum(fresh) - 1) * (int(found[:, 2].max()) + 1)
    furthest = np.maximum.accumulate(stop)
    return found[np.concatenate([[True], stop[1:] > furthest[:-1]])]


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching stretches."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[fresh], stops[np.append(np.flatnonzero(fresh)[1:] - 1, len(stops) - 1)]


def without_repeats(docs: DataFrame, settings: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): per row, the maximal removed runs as (start, stop) in bytes and the remaining bytes.

    A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input and never cross documents.  NULL counts as empty; shorter texts
    lose nothing.  Rows with equal ids are one document, each answered.  Rows with a NULL id lose nothing and
    take nothing from others.  No rows give none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    parts = parts_for(known, settings)
    pieces = covered(known, settings, parts).select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("binary")
    own = F.coalesce(F.pmod("doc_id", F.lit(parts)), F.lit(0)).cast("long")
    whole = rows.select(own.alias("part"), none.alias("docs"), none.alias("starts"), none.alias("sizes"), "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packed = None, []
        docs_, starts, stops = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "spans", "kept")}
            columns = [batch.column(n) for n in ("part", "docs", "starts", "sizes", "doc_id", "text")]
            for p, docs_of, starts_of, sizes_of, doc, text_ in zip(*columns):
                if p.as_py() != part:
                    part, packed = p.as_py(), []
                    docs_, starts, stops = (np.zeros(0, np.int64) for _ in range(3))
                if docs_of.is_valid:
                    packed.append([np.frombuffer(v.as_py(), t) for v, t in zip((docs_of, starts_of, sizes_of), _STRETCHES.values())])
                    continue
                if packed:  # the part's stretches came first
                    docs_, starts, sizes = (np.concatenate(x).astype(np.int64) for x in zip(*packed))
                    order, packed = np.argsort(docs_, kind="stable"), []
                    docs_, starts, stops = docs_[order], starts[order], (starts + sizes)[order]
                raw, doc_ = text_.as_py().encode(), doc.as_py()
                low, high = (0, 0) if doc_ is None else np.searchsorted(docs_, [doc_, doc_ + 1])
                runs = list(zip(*(r.tolist() for r in merged(starts[low:high], stops[low:high]))))
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                for name, value in zip(out, (doc_, len(raw), len(raw) - len(left), [{"start": s, "stop": e} for s, e in runs], left)):
                    out[name].append(value)
            yield record_batch(
                {n: pa.array(out[n], pa.int64()) for n in ("doc_id", "n_bytes", "n_removed")}
                | {"spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept": pa.array(out["kept"], pa.binary())}
            )

    both = pieces.unionByName(whole).repartition("part").sortWithinPartitions("part", F.col("docs").isNull())
    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")


_AROUND = {"seeds": "<u8", "docs": "<i8", "places": "<i8", "before": "<i8", "behind": "<i8", "context": "u1"}
_OCCURRENCE = "group string, kind string, length long, doc_id long, start long, stop long"


def _occurrences(kind: str, found: list[tuple[str, int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    group, *rest = (pa.array(c, t) for c, t in zip(columns, types))
    return record_batch(dict(zip(("group", "kind", "length", "doc_id", "start", "stop"), (group, pa.array([kind] * len(found), pa.string()), *rest))))


def _name(string: bytes) -> str:
    return hashlib.blake2b(string, digest_size=16).hexdigest()


def _has_period(string: bytes, longest: int) -> bool:
    return any(string[period:] == string[:-period] for period in range(1, longest + 1))


def _groups(held: dict[str, np.ndarray], length: int, seed: int, longest: int, hot: bytes | None) -> Iterator[list[tuple[str, int, int, int, int]]]:
    """Occurrences of the maximal repeats of ``length`` to 2 * ``length`` - 1 bytes around the seeds of a part.

    Strings all of whose own seeds are ``hot`` are left to the windows: only some of their places are known here.
    """
    reach, places, docs = 2 * length - seed, held["places"].astype(np.int64), held["docs"]
    context = held["context"].reshape(-1, reach + 2 * length)
    seeds = np.unique(held["seeds"], return_inverse=True)[1]
    left, right = np.ascontiguousarray(context[:, reach - 1 :: -1]), np.ascontiguousarray(context[:, reach:])
    before, behind = held["before"].astype(np.int64), held["behind"].astype(np.int64)
    out: list[tuple[str, int, int, int, int]] = []
    for a, f, members in maximal_repeats(seeds, left, before, right, behind, length, seed):
        size = a + f
        if size >= 2 * length:  # seen whole at the next level
            continue
        string = context[members[0], reach - a : reach + f].tobytes()
        if _has_period(string, longest):  # has its ranges
            continue
        if hot and has_bit(hot, Sampled(string, length, seed, longest).seeds.view(np.int64), 1 << 24).all():
            continue
        name = _name(string)
        out.extend((name, size, doc, start, start + size) for doc, start in zip(docs[members].tolist(), (places[members] - a).tolist()))
        if len(out) >= 1 << 15:
            yield out
            out = []
    yield out


def _level(docs: DataFrame, settings: Repeats, length: int, parts: int) -> DataFrame | None:
    """Occurrences of the maximal repeats of ``length`` to 2 * ``length`` - 1 bytes; None where no seed is there twice."""
    spark, bits = docs.sparkSession, settings.bits
    seed, reach = SEED * length // settings.length, 2 * length - SEED * length // settings.length
    longest = periods(settings.length)
    sampled = lambda batch: ((doc, text, Sampled(text, length, seed, longest)) for doc, text in _long(batch, length))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.seeds for _, _, s in sampled(batch)]
            if own:
                seeds, counts = np.unique(np.concatenate(own), return_counts=True)
                yield _dealt(seeds % np.uint64(parts), seeds=seeds, counts=counts.astype("<u4"))

    dealt = docs.mapInArrow(sample, "part long, seeds binary, counts binary")
    shared = durable(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_twice, "seed long, n long"))
    if shared.isEmpty():
        return None
    marks = spark.sparkContext.broadcast(bit_filter(shared, "seed", bits))
    hot = shared.filter(F.col("n") > settings.hot)
    any_hot = not hot.isEmpty()
    hot_marks = spark.sparkContext.broadcast(bit_filter(hot, "seed", 1 << 24))

    def split(s: Sampled) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(has_bit(marks.value, s.seeds.view(np.int64), bits))
        often = has_bit(hot_marks.value, s.seeds[rows].view(np.int64), 1 << 24)
        return rows[~often], rows[often]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, s in sampled(batch):
                rows = split(s)[0]
                if not len(rows):
                    continue
                at = s.places[rows]
                data = np.pad(np.frombuffer(text, np.uint8), (reach, 2 * length))
                yield _dealt(
                    s.seeds[rows] % np.uint64(parts), seeds=s.seeds[rows], docs=np.full(len(rows), doc, "<i8"), places=at.astype("<i8"),
                    before=np.minimum(at, reach).astype("<i8"), behind=np.minimum(s.n - at, 2 * length).astype("<i8"),
                    context=data[at[:, None] + np.arange(reach + 2 * length)[None, :]],
                )

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, _AROUND):
            for found in _groups(held, length, seed, longest, hot_marks.value if any_hot else None):
                yield _occurrences("maximal", found)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, s in sampled(batch):
                rows = split(s)[1]
                starts = s.windows(rows)[0].tolist() if len(rows) else []
                for i in range(0, len(starts), 1 << 13):
                    yield _occurrences("window", [(_name(text[p : p + length]), length, doc, p, p + length) for p in starts[i : i + (1 << 13)]])

    schema = "part long, " + ", ".join(f"{n} binary" for n in _AROUND)
    met = docs.mapInArrow(contexts, schema).repartition(parts, "part").sortWithinPartitions("part")
    found = met.mapInArrow(grouped, _OCCURRENCE)
    return found.unionByName(docs.mapInArrow(windows, _OCCURRENCE)) if any_hot else found


def _long(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, bytes]]:
    for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
        if len(text) >= length:
            yield doc, text


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _gathered(batches, {"seeds": "<u8", "counts": "<u4"}):
        seeds, where = np.unique(held["seeds"], return_inverse=True)
        n = np.bincount(where, held["counts"])
        yield _pairs({"seed": seeds[n > 1], "n": n[n > 1]})


def repeat_groups(docs: DataFrame, settings: Repeats = Repeats(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, kind, length, doc_id, start, stop): one row per occurrence of each maximal repeat of ``length`` bytes or more.

    A maximal repeat is a string that stands in two places or more, not all of them with the same byte before
    it nor all with the same byte behind it (a text's border is like no other byte); within a document or across
    documents, and with all its places, overlapping ones too.  ``group`` is a digest of the string, places count in
    bytes.  Repeats are found level by level, of ``length`` to 2 * ``length`` - 1 bytes first, then twice as long ones
    from seeds twice as long and half as many, until no seed is there twice; at each level the contexts show a byte
    more than the repeats to be found, hence none is cut off.

    Kinds: ``maximal``; ``run`` for strings within runs of a short period, whose group is a string of ``length``
    bytes and whose rows are the ranges that its places cover; ``window`` for strings of a level's length around
    seeds that stand in more than ``hot`` places, which are not extended, so that no task holds an unbounded group.
    NULL counts as empty.  Rows with a NULL id take no part; rows with equal ids are one document, and equal places
    count once.  No rows give none.  The output is as large as the repeats are: m copies of a line behind one
    another have m * m / 2 places.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("doc_id IS NOT NULL")
    # A context is about eight times as long as the text between two seeds.
    parts, length = 4 * parts_for(rows, settings) | 1, settings.length
    run = run_ranges(rows, length).select(
        F.concat(F.lit("run:"), F.hex("window")).alias("group"), F.lit("run").alias("kind"), F.lit(length).cast("long").alias("length"),
        "doc_id", F.col("first").alias("start"), "stop",
    )
    levels = [durable(run)]
    while (found := _level(rows, settings, length, parts)) is not None:
        levels.append(durable(found))
        length *= 2
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = durable(every.dropDuplicates(["group", "kind", "doc_id", "start"]))
    place = F.struct("doc_id", "start")
    several = every.groupBy("group", "kind").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max(F.col("stop") - F.col("start") - F.col("length")).alias("more"))
    return every.join(several.filter("a != b OR more > 0").select("group", "kind"), ["group", "kind"], "left_semi").select("group", "kind", "length", "doc_id", "start", "stop")
