"""MinHash near-dedup with sequential Bayesian verification.

1. Every text gets its shingle set's size, a 128-bit print of the set, a signature and band keys.
   Texts of equal sets are one class; only its first document goes on.
2. Classes that share a band key are candidates.  In each bucket all are paired with one leader, not
   with each other; what stays unconnected after that is compared further, so that no link is lost.
3. A candidate pair's signatures are compared batch by batch.  After each batch, the posterior of
   the similarity being at least the threshold is known from a table; pairs below the miss
   probability are dropped, the survivors are confirmed on their full shingle sets.
4. Confirmed links give components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import bit_filter, durable, has_bit, record_batch, same, texts
from caseflow.llm.components import components
from caseflow.llm.shingles import WIDTH, common, mix, shingle_sets


@dataclass(frozen=True)
class Near:
    """A pair is linked where 100 * common >= percent * union.

    ``bands`` x ``rows`` hashes: at similarity 0.85 the chance to share no band is below 1e-6.
    ``batch`` signature places are compared at a time, pairs whose posterior falls under ``miss`` are dropped.
    ``share`` members at most are compared with one copy of a leader; ``block`` members of a bucket at a time.
    """

    percent: int = 85
    width: int = WIDTH
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-6
    share: int = 256
    block: int = 512
    filter_bits: int = 1 << 25


_random = np.random.Generator(np.random.PCG64(77))
_FACTORS = _random.integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_AT_ONCE = 256


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima of the set, each under another multiplication; their upper halves are used."""
    least = np.full(size, 2**64 - 1, np.uint64)
    factors = _FACTORS[None, :size]
    for at in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (hashes[at : at + _AT_ONCE, None] * factors).min(axis=0), out=least)
    return least >> np.uint64(32)


def _print(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def sketches(docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """(doc_id, print, n_shingles, p0, p1, places, keys) of every row; ``print`` tells the texts of one id apart."""
    size = near.bands * near.rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _FACTORS[512 : 512 + near.rows]
        for batch in batches:
            counts, p0, p1, places, keys = [], [], [], [], []
            for found in shingle_sets(texts(batch, "text"), near.width):
                counts.append(len(found))
                p0.append(int(np.sum(mix(found)).view(np.int64)) if len(found) else 0)
                p1.append(int(np.sum(mix(found ^ _FACTORS[600])).view(np.int64)) if len(found) else 0)
                if not len(found):
                    places.append(None)
                    keys.append(None)
                    continue
                least = signature(found, size)
                places.append((mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                bands = mix((least.reshape(near.bands, near.rows) * weights).sum(axis=1, dtype=np.uint64) + np.arange(near.bands, dtype=np.uint64) * _FACTORS[700])
                keys.append(bands.view(np.int64))
            yield record_batch(
                {"doc_id": batch.column("doc_id"), "print": batch.column("print"), "n_shingles": pa.array(counts, pa.int64()), "p0": pa.array(p0, pa.int64()), "p1": pa.array(p1, pa.int64()),
                 "places": pa.array(places, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _print(doc_id, text).alias("print"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, print long, n_shingles long, p0 long, p1 long, places binary, keys array<long>")


def least_matches(near: Near) -> np.ndarray:
    """For each number of compared places, the fewest matches with which a pair may still be similar.

    Two places match with probability s + (1 - s) / 256 at similarity s.  Under a uniform prior on s, the
    posterior mass at or above the threshold is compared with the miss probability.
    """
    s = (np.arange(4000) + 0.5) / 4000
    hit, above = s + (1 - s) / 256, s * 100 >= near.percent
    out = []
    for n in range(near.batch, near.bands * near.rows + 1, near.batch):
        m = np.arange(n + 1)[:, None]
        weight = m * np.log(hit)[None, :] + (n - m) * np.log1p(-hit)[None, :]
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        mass = weight[:, above].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(mass >= near.miss)))
    return np.array(out)


def plausible(a: np.ndarray, b: np.ndarray, needed: np.ndarray, batch: int) -> np.ndarray:
    """Which rows of two signature matrices survive batch after batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, least in enumerate(needed):
        part = slice(i * batch, (i + 1) * batch)
        matches = matches + np.count_nonzero(a[alive, part] == b[alive, part], axis=1)
        fine = matches >= least
        alive, matches = alive[fine], matches[fine]
    return alive


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def surviving(pairs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave plausible."""
    size, needed = near.bands * near.rows, least_matches(near)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = plausible(_matrix(batch.column("places_a"), size), _matrix(batch.column("places_b"), size), needed, near.batch)
            yield record_batch({n: batch.column(n).take(pa.array(keep, pa.int64())) for n in ("a", "b")})

    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("places").alias(f"places_{s}"))
    both = durable(pairs.join(side("a"), "a")).join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * near.percent)
    return both.select("a", "b", "places_a", "places_b").mapInArrow(prune, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Each leader ``a`` meets its members in parts of about ``share``; a task holds one leader's set and
    streams the members past it.  A bounded bit filter keeps the texts of other documents off the network.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / near.share).cast("int").alias("parts"))
    sizes = durable(sizes)
    parted = durable(pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part"))
    wanted = parted.select("a", "part", F.col("b").alias("id")).unionByName(parted.select("a", "part", F.col("a").alias("id")).distinct())
    wanted = durable(wanted)
    marks = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "id", near.filter_bits))
    bits = near.filter_bits

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(marks.value, batch.column("id").to_numpy(zero_copy_only=False), bits)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, before = None, None, None
        for batch in batches:
            out = []
            ids = zip(*(batch.column(n).to_pylist() for n in ("a", "part", "id")))
            for (a, part, b), found in zip(ids, shingle_sets(texts(batch, "text"), near.width)):
                if (a, part) != key:
                    key, leader, before = (a, part), found, b  # the leader comes first
                elif b != before:  # else the same row once more
                    both = common(leader, found)
                    if 100 * both >= near.percent * (len(leader) + len(found) - both):
                        out.append((a, b))
                    before = b
            yield record_batch({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL")
    rows = rows.mapInArrow(marked, "id long, text string")
    met = wanted.join(rows, "id").select("a", "part", "id", "text").repartition("a", "part")
    return met.sortWithinPartitions("a", "part", F.col("id") != F.col("a"), "id").mapInArrow(check, "a long, b long")


def stars(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(within, buckets, pairs): members of buckets of at least two, every bucket's leader, and its members paired with it.

    The leader is the member that meets most others over all its buckets: among copies of one original, that
    is mostly the original, to which all are closer than to each other.
    """
    sizes = durable(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    within = durable(members.join(sizes, "key"))
    degrees = durable(within.groupBy("rep").agg(F.sum("size").alias("degree")))
    weighed = durable(within.join(degrees, "rep"))
    order = F.struct("degree", F.xxhash64("rep").alias("o"), "rep")
    buckets = durable(weighed.groupBy("key").agg(F.max(order).alias("first"), F.first("size").alias("size")).select("key", F.col("first.rep").alias("leader"), "size"))
    paired = within.join(buckets.select("key", "leader"), "key").filter("rep <> leader")
    return within, buckets, paired.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()


def further_links(members: DataFrame, buckets: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket that the leaders left in different components.

    A bucket's members outside its leader's component are compared with all members of other components:
    ``block`` of the former meet ``block`` of the latter at a time, in memory.  A pair counts in the first
    band that it shares, and only while its components are apart; nothing but confirmed links leaves.
    """
    size, needed, bits = near.bands * near.rows, least_matches(near), near.filter_bits
    labelled = members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    leads = buckets.filter("size > 2").join(labels, buckets["leader"] == labels["node"], "left")
    leads = durable(leads.select("key", "size", F.coalesce("label", "leader").alias("own")))
    inside = durable(labelled.join(leads, "key"))
    outer = durable(inside.filter("label <> own").groupBy("key").agg(F.count(F.lit(1)).alias("n_outer")))
    work = inside.join(outer, "key").withColumns(
        {"rows_of": F.ceil(F.col("n_outer") / near.block).cast("int"), "columns_of": F.ceil(F.col("size") / near.block).cast("int"), "place": F.xxhash64("rep", "key")}
    )
    work = durable(work)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod("place", F.col(n)).cast("int")
    first = work.filter("label <> own").select("key", "rep", "label", F.lit(True).alias("outer"), part("rows_of").alias("i"), upto("columns_of").alias("j"))
    second = work.select("key", "rep", "label", F.lit(False).alias("outer"), upto("rows_of").alias("i"), part("columns_of").alias("j"))
    met = work.select(F.col("rep").alias("id")).distinct()
    marks = docs.sparkSession.sparkContext.broadcast(bit_filter(met, "id", bits))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(marks.value, batch.column("rep").to_numpy(zero_copy_only=False), bits)))

    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text")).filter("rep IS NOT NULL")
    rows = rows.mapInArrow(marked, "rep long, text string").groupBy("rep").agg(F.min("text").alias("text"))
    known = durable(rows.join(classes.select("rep", "n_shingles", "places", "keys"), "rep"))
    full = durable(first.unionByName(second)).join(known, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, columns = None, [], []

        def block() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            if rows and columns:
                found = _links_between(key[0], rows, columns, size, needed, near)
            return record_batch({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate("ab")})

        for batch in batches:
            named = [batch.column(n).to_pylist() for n in ("key", "i", "j", "outer", "rep", "label", "n_shingles", "places", "keys", "text")]
            for k, i, j, outside, *member in zip(*named):
                if (k, i, j) != key:
                    yield block()
                    key, rows, columns = (k, i, j), [], []
                (rows if outside else columns).append(member)
        yield block()

    blocks = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return blocks.mapInArrow(compare, "a long, b long").distinct()


def _links_between(key: int, rows: list[list], columns: list[list], size: int, needed: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links of a block that join components, each confirmed on full sets; rows are (rep, label, n, places, keys, text)."""
    reps, labels, counts = (np.array([c[i] for c in columns], np.int64) for i in range(3))
    signs = np.frombuffer(b"".join(c[3] for c in columns), np.uint8).reshape(-1, size)
    bands = np.array([c[4] for c in columns], np.int64)
    sets: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}

    def set_of(rep: int, value: str) -> np.ndarray:
        if rep not in sets:
            sets[rep] = next(shingle_sets(iter([value.encode()]), near.width))
        return sets[rep]

    def find(label: int) -> int:
        while (up := root.get(label, label)) != label:
            label = up
        return label

    out = []
    for rep, label, n, places, keys, value in rows:
        others = np.flatnonzero((labels != label) & (np.minimum(counts, n) * 100 >= np.maximum(counts, n) * near.percent))
        shared = bands[others] == np.array(keys, np.int64)[None, :]
        others = others[shared.any(axis=1) & (bands[others, np.argmax(shared, axis=1)] == key)]
        if not len(others):
            continue
        own = np.broadcast_to(np.frombuffer(places, np.uint8), (len(others), size))
        for c in others[plausible(own, signs[others], needed, near.batch)].tolist():
            here, there = find(label), find(int(labels[c]))
            if here != there:
                a, b = set_of(rep, value), set_of(int(reps[c]), columns[c][5])
                both = common(a, b)
                if 100 * both >= near.percent * (len(a) + len(b) - both):
                    out.append((rep, int(reps[c])))
                    root[max(here, there)] = min(here, there)
    return out


def _decided(docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, print, n_shingles, component_id and, where the row's set is not empty and its id not NULL, first_print.

    (component_id, first_print) is the one row of the component that stays.  Nodes of the links are the
    smallest ids of the classes; where an id has several sets, the prints take their place.
    """
    marks = durable(sketches(docs, near, doc_id, text))
    own = ["p0", "p1", "n_shingles"]
    sets = marks.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64(*own).alias("set"))
    twofold = sets.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a <> b")
    one = twofold.isEmpty()
    filled = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy(*own).agg(F.min(F.struct("doc_id", "print", "places", "keys")).alias("first"))
    rep = F.col("first.doc_id" if one else "first.print").alias("rep")
    classes = durable(classes.select(*own, rep, "first.doc_id", "first.print", "first.places", "first.keys"))
    node = F.col(doc_id).cast("long") if one else F.when(F.col(doc_id).cast("long").isNotNull(), _print(doc_id, text))
    nodes = docs.select(node.alias("node_id"), F.col(text).cast("string").alias("text"))
    members = classes.select("rep", F.explode("keys").alias("key"))
    within, buckets, pairs = stars(members)
    pairs = durable(pairs)
    links = durable(confirmed(durable(surviving(pairs, classes, near)), nodes, near, "node_id", "text"))
    labels = components(links)
    more = durable(further_links(within.select("rep", "key"), buckets, classes, labels, nodes, near, "node_id", "text"))
    if not more.isEmpty():
        labels = components(durable(links.unionByName(more)))
    places = classes.select(*own, "rep", F.struct("doc_id", "print").alias("self"))
    firsts = places.join(labels, places["rep"] == labels["node"]).groupBy("label").agg(F.min("self").alias("least"))
    labels = durable(labels.join(firsts, "label").select("node", "least"))
    named = places.join(labels, places["rep"] == labels["node"], "left").select(*own, F.coalesce("least", "self").alias("least"))
    named = durable(named.select(*own, F.col("least.doc_id").alias("component"), F.col("least.print").alias("first_print")))
    joined = marks.join(named, same(marks, named, own), "left")
    linked = (marks["n_shingles"] > 0) & marks["doc_id"].isNotNull()
    component = F.when(linked, F.col("component")).otherwise(marks["doc_id"])
    return joined.select(
        marks["doc_id"], marks["print"], marks["n_shingles"], component.alias("component_id"), F.when(linked, F.col("first_print")).alias("first_print")
    )


def near_classes(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, a document's own included; kept where they are
    equal.  A text without words, NULL too, has an empty set and is linked with nothing.  Rows with equal
    texts link; a row that is there twice is answered twice; a NULL id is its own component.  Rows with one
    id and different sets are linked by their sets only.  No rows give none.
    """
    found = _decided(docs, near, doc_id, text)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns kept.

    Rows with a NULL id and texts without words all stay, each (id, text) once.  Of rows with one id, those
    stay whose own text is the first of its component.
    """
    found = _decided(docs, near, doc_id, text)
    first = F.col("first_print").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("print") == F.col("first_print")))
    stays = found.filter(first).select(F.col("doc_id").alias("keep_id"), F.col("print").alias("keep_print")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), _print(doc_id, text).alias("print"))
    left = rows.join(stays, rows["id"].eqNullSafe(stays["keep_id"]) & (rows["print"] == stays["keep_print"]), "left_semi")
    return left.dropDuplicates(["id", "print"]).select("row.*")
