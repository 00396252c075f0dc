"""Ordered operations per key (position, neighbours, running totals, quantiles) that survive hot keys.

A plain window sorts every key inside one task.  That is the right plan until one key holds a large
share of the rows.  The functions here therefore look for such keys first:

* the ordinary keys go through a plain window: one exchange, one sort;
* the rows of hot keys are range-partitioned by (key, order), so that a key is cut into many
  segments of even size; each segment is handled by itself and small per-segment totals carry the
  state across segment borders.

Both paths give the same rows.  ``order`` must identify a row within its key (add an id), otherwise
the answer would depend on arrival order.

Hot keys are found by counting rows per key; a plan never depends on an estimate.  Who builds several
operators on one source counts once and declares the result (``known_hot``); every operator whose
keys hold the declared column uses it.  ``spark.caseflow.hotRows`` is the number of rows one task may
sort for one key; below ``SEGMENT_ROWS`` it says which keys are hot, and segments stay that large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import durable

HOT_ROWS = 2_000_000
#: Segments are not cut below this many rows only because the limit of a hot key is lower.
SEGMENT_ROWS = 100_000
_SEGMENT = "__segment"
_POSITION = "__position"


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.caseflow.{name}", str(default)))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"__k_{k}" for k in keys]
    return df.withColumnsRenamed(dict(zip(keys, names))), names


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where a NULL key equals a NULL key; the right side's keys are dropped."""
    renamed, names = _renamed(right, keys)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[n]) for k, n in zip(keys, names)])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names)


Found = tuple[DataFrame, int] | None
_KNOWN: ContextVar[dict[str, Callable[[], Found]]] = ContextVar("known hot keys", default={})
_LIMIT: ContextVar[int | None] = ContextVar("rows of a hot key", default=None)


def _limit(df: DataFrame) -> int:
    return _LIMIT.get() or _setting(df, "hotRows", HOT_ROWS)


@contextmanager
def hot_rows(limit: int) -> Iterator[None]:
    """Within it, keys with more than ``limit`` rows are hot."""
    token = _LIMIT.set(limit)
    try:
        yield
    finally:
        _LIMIT.reset(token)


@contextmanager
def known_hot(**sources: Callable[[], DataFrame]) -> Iterator[None]:
    """Declare where the hot values of a column are to be counted: ``column = function that gives the source rows``.

    Each source is counted once, when an operator first asks.  It must hold the heavy values of whatever
    is derived from it; an operator that makes a few rows of one has the same hot keys.
    """
    kept: dict[str, Found] = {}

    def once(column: str, source: Callable[[], DataFrame]) -> Callable[[], Found]:
        def find() -> Found:
            if column not in kept:
                kept[column] = _count_hot(source(), [column])
            return kept[column]

        return find

    token = _KNOWN.set({column: once(column, source) for column, source in sources.items()})
    try:
        yield
    finally:
        _KNOWN.reset(token)


def _count_hot(df: DataFrame, keys: list[str]) -> Found:
    """Keys above the limit, written down, and how many rows they hold.  Only that number reaches the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    found = durable(counts.filter(F.col("__rows") > _limit(df)))
    n_rows = found.agg(F.sum("__rows")).first()[0]
    return (found.drop("__rows"), n_rows) if n_rows else None


def hot_keys(df: DataFrame, keys: list[str]) -> tuple[list[str], Found]:
    """The columns to look at, and the hot keys in them: declared ones, or counted here with map-side combine."""
    for column, find in _KNOWN.get().items():
        if column in keys:
            return [column], find()
    return keys, _count_hot(df, keys)


def split_hot(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary rows, rows of hot keys or None, number of hot rows)."""
    columns, found = hot_keys(df, keys)
    if found is None:
        return df, None, 0
    table, n_rows = found
    written = durable(df)  # it is read on two ways
    return attach(written, table, columns, "left_anti"), attach(written, table, columns, "left_semi"), n_rows


def _n_segments(hot: DataFrame, n_rows: int) -> int:
    """Segments of as many rows as the limit allows.  A low limit gives one segment per exchange partition, and more
    only where they would hold over ``SEGMENT_ROWS`` rows: a segment is a task in every exchange that follows."""
    most = max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SEGMENT_ROWS))
    return max(2, min(most, -(-n_rows // _limit(hot))))


def _segments(hot: DataFrame, n_rows: int, keys: list[str], order: list[str]) -> DataFrame:
    """Cut hot keys into even, ordered segments.  The partition number is written down by a reliable
    checkpoint, so a re-run task cannot shift a border."""
    parts = hot.repartitionByRange(_n_segments(hot, n_rows), *keys, *order).withColumn(_SEGMENT, F.spark_partition_id())
    return durable(parts)


_COMBINE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda before, here: F.coalesce(before + here, here, before)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
}


def _running_plain(df, keys, order, running):
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({out: _COMBINE[kind][0](value).over(window) for out, (kind, value) in running.items()})


def _running_segmented(parts, keys, order, running):
    local = _running_plain(parts, [*keys, _SEGMENT], order, running)
    totals = parts.groupBy(*keys, _SEGMENT).agg(
        *[_COMBINE[kind][0](value).alias(f"__t_{out}") for out, (kind, value) in running.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        _SEGMENT,
        *[_COMBINE[kind][0](f"__t_{out}").over(earlier).alias(f"__b_{out}") for out, (kind, _) in running.items()],
    )
    joined = attach(local, before, [*keys, _SEGMENT])
    combined = {out: _COMBINE[kind][1](F.col(f"__b_{out}"), F.col(out)) for out, (kind, _) in running.items()}
    return joined.withColumns(combined).drop(*[f"__b_{out}" for out in running])


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates, this row included: ``values = {name: ("sum" | "max", column)}``."""
    cold, hot, n_rows = split_hot(df, keys)
    plain = _running_plain(cold, keys, order, values)
    if hot is None:
        return plain
    parts = _segments(hot, n_rows, keys, order)
    return plain.unionByName(_running_segmented(parts, keys, order, values).drop(_SEGMENT))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Add the 1-based position of every row within its key."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))})


def _shifted_plain(df, keys, order, values):
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({out: F.lead(value, step).over(window) for out, (value, step) in values.items()})


def _shifted_segmented(parts, keys, order, values):
    """Neighbours by position: an equi-join on (key, position), which spreads evenly."""
    one = {_POSITION: ("sum", F.lit(1).cast("bigint"))}
    numbered = _running_segmented(parts, keys, order, one)
    result = numbered
    for step in sorted({step for _, step in values.values()}):
        moved = numbered.select(
            *keys,
            (F.col(_POSITION) - step).alias(_POSITION),
            *[value.alias(out) for out, (value, s) in values.items() if s == step],
        )
        result = attach(result, moved, [*keys, _POSITION])
    return result.drop(_POSITION)


def shifted(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add values of neighbouring rows: offset +1 is the next row, -1 the one before."""
    cold, hot, n_rows = split_hot(df, keys)
    plain = _shifted_plain(cold, keys, order, values)
    if hot is None:
        return plain
    parts = _segments(hot, n_rows, keys, order)
    return plain.unionByName(_shifted_segmented(parts, keys, order, values).drop(_SEGMENT))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "island") -> DataFrame:
    """Number the runs of equal ``value`` within each key; a NULL value is a run of its own."""
    before = {"__before": (F.col(value), -1)}
    # NULL = anything is NULL, so a NULL on either side (also at the first row) opens a new run.
    opens = {out: ("sum", F.when(F.col(value) == F.col("__before"), 0).otherwise(1).cast("bigint"))}
    cold, hot, n_rows = split_hot(df, keys)
    plain = _running_plain(_shifted_plain(cold, keys, order, before), keys, order, opens)
    if hot is not None:
        marked = _shifted_segmented(_segments(hot, n_rows, keys, order), keys, order, before)
        plain = plain.unionByName(_running_segmented(marked, keys, order, opens).drop(_SEGMENT))
    return plain.drop("__before")


def group_values(df: DataFrame, keys: list[str], values: dict[str, Column], hot: bool = False) -> DataFrame:
    """Add aggregates of the whole group to each of its rows.

    Ordinary groups use a window, which needs no exchange where the rows already lie together.  For
    ``hot`` rows (from ``split_hot``) the aggregates are computed first, map-side combined, and joined.
    """
    if not hot:
        return df.withColumns({out: value.over(Window.partitionBy(*keys)) for out, value in values.items()})
    table = df.groupBy(*keys).agg(*[value.alias(out) for out, value in values.items()])
    return attach(df, table, keys)


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """Exact interpolated quantile per key, from counts of distinct values instead of value lists."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, keys, [value], {"__upto": ("sum", F.col("__n"))})
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    rank = (F.col("__total") - 1) * F.lit(q)
    holds = lambda i: (F.col("__upto") > i) & (F.col("__upto") - F.col("__n") <= i)
    return (
        attach(upto, total, keys, "inner")
        .filter(holds(F.floor(rank)) | holds(F.ceil(rank)))
        .groupBy(*keys)
        .agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.first("__total").alias("__total"))
        .withColumn(out, F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (rank - F.floor(rank)))
        .drop("__lo", "__hi", "__total")
    )
