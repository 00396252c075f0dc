"""Quality rules: robust multivariate outliers among the statistics of documents.

Each document has a vector of transformed statistics.  Per language and source, a minimum covariance
determinant estimate gives place and shape of the bulk of these vectors, and a document whose
Mahalanobis distance is beyond a chi-square quantile is rejected.

The estimate is found by concentration steps from fixed starts (median and quartiles; mean and
covariance): take the ``share`` of rows nearest by the last estimate, estimate again, and keep the start with the
smallest determinant; then rows inside a wider quantile give the final estimate.  A variance floor on every statistic
(as in the regularised form of the estimate) bears with statistics that are constant in most rows.

A step is one aggregation: moments per (group, start, bin of the distance), added up from the nearest bin
on until enough rows are in.  Statistics are whole numbers, so that sums do not depend on the order of
rows and reruns agree.  What is exchanged is bounded by groups and bins.  Everything is built from
Spark's own functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import durable

_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Steps of a statistic per unit, and distance bins per doubling.
STEP, BINS = 256, 16
#: Estimates that may be broadcast; more of them are joined by exchange.
MAX_SENT = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _share(part: Column, whole: Column) -> Column:
    return F.log1p(100.0 * part / F.greatest(whole, F.lit(1)))


#: The transformed statistics, and the least deviation each is taken to have.
STATISTICS: dict[str, tuple[Callable[[], Column], float]] = {
    "length": (lambda: F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")), 0.25),
    "word_length": (lambda: F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), 0.03),
    "symbols": (lambda: _share(F.col("n_symbols"), F.col("n_words")), 0.5),
    "dup_lines": (lambda: _share(F.col("n_dup_lines"), F.col("n_lines")), 1.0),
    "repeats": (lambda: _share(F.col("n_repeat_words"), F.col("n_words")), 1.0),
}


@dataclass(frozen=True)
class Rules:
    """``least``: rows a group must have for an estimate of its own; ``share``: of these, how many the estimate is
    made from; ``inner``, ``outer``: chi-square quantiles of the final estimate and of the verdict."""

    least: int = 50
    share: float = 0.75
    steps: int = 4
    inner: float = 0.975
    outer: float = 0.99999
    least_words: int = 10
    repeat_percent: int = 20


def chi_square(x: float, k: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1.0
    n = k / 2
    while term > 1e-16 * total:
        n += 1
        term *= x / 2 / n
        total += term
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))


def chi_square_at(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        low, high = (low, (low + high) / 2) if chi_square((low + high) / 2, k) > q else ((low + high) / 2, high)
    return low


def _consistent(share: float, k: int) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied by."""
    return share / chi_square(chi_square_at(share, k), k + 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _equal_neighbour(rows: Column, field: str) -> Column:
    """Entries of a sorted array that agree in ``field`` with the one before or after."""
    before = lambda x, i: (i > 0) & (rows[F.greatest(i - 1, F.lit(0))][field] == x[field])
    after = lambda x, i: (i < F.size(rows) - 1) & (rows[F.least(i + 1, F.size(rows) - 1)][field] == x[field])
    return F.filter(rows, lambda x, i: before(x, i) | after(x, i))


def _repeated_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that is there twice or more.

    Windows are told apart by hashes first; those with an equal hash are compared as text.
    """
    window = lambda i: [words[i + k] for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*window(i)))

    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, i: F.when(i < F.size(places) - 1, F.least(F.lit(WINDOW), places[F.least(i + 1, F.size(places) - 1)] - p)).otherwise(WINDOW))
        return F.aggregate(gap, F.lit(0), lambda a, g: a + g)

    def exact(candidates: Column) -> Column:
        texts = F.sort_array(F.transform(candidates, lambda c: F.struct(F.concat_ws(" ", *window(c["i"])).alias("t"), c["i"].alias("i"))))
        return _let(texts, lambda t: _let(F.sort_array(F.transform(_equal_neighbour(t, "t"), lambda x: x["i"])), covered))

    def among(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(sorted_, lambda s: exact(_equal_neighbour(s, "h"))))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(hashes, among))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of every whole text (NULL: empty)."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select(
        *keep, "t", F.array_remove(F.split("t", _SPACE + "+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        *keep, long(F.size("w"), "n_words"), long(F.length(F.translate("t", " \t\n\x0b\x0c\r", "")), "word_chars"),
        long(F.length("t") - F.length(F.translate("t", _SYMBOLS, "")), "n_symbols"), long(F.size("l"), "n_lines"),
        long(F.size("l") - F.size(F.array_distinct("l")), "n_dup_lines"), long(_let(F.col("w"), _repeated_words), "n_repeat_words"),
    )


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


# --- the estimate -----------------------------------------------------------------------------------------

_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_FLOOR = [(least * STEP) ** 2 for _, least in STATISTICS.values()]
_MOMENTS = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS]]


def _moments() -> list[Column]:
    """Number, sums and sums of products: whole numbers, hence exact in any order."""
    z = lambda i: F.col(f"z{i}").cast("long")
    return [F.count(F.lit(1)).alias("n"), *[F.sum(z(i)).alias(f"s{i}") for i in range(_P)], *[F.sum(z(i) * z(j)).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _estimate(moments: DataFrame, factor: float, keys: list[str]) -> DataFrame:
    """(keys, m0.., w00.., log_det): mean, inverse of the Cholesky factor, log-determinant from moments."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(_P)}
    with_mean = moments.withColumns(mean)
    cov = {f"c{i}{j}": factor * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (_FLOOR[i] if i == j else 0.0) for i, j in _PAIRS}
    return _inverted(with_mean.withColumns(cov), keys)


def _inverted(rows: DataFrame, keys: list[str]) -> DataFrame:
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(_P):
        for i in range(j, _P):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            rows = rows.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(_P)), F.lit(0.0))
    return rows.select(*keys, *[f"m{i}" for i in range(_P)], *[f"w{i}{j}" for i, j in _PAIRS], log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's statistics by the estimate beside them."""
    total = F.lit(0.0)
    for i in range(_P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}"))
        total = total + y * y
    return total


def _beside(rows: DataFrame, table: DataFrame, size: int, key: str, how: str = "inner") -> DataFrame:
    """Rows with what a table of ``size`` rows says about their key; a large table, or a hot key in it, goes by exchange and is split there."""
    return rows.join(F.broadcast(table) if size <= MAX_SENT else table, key, how)


def _grouped(rows: DataFrame, rules: Rules) -> tuple[DataFrame, int]:
    """Rows with ``grp``: language and source; where these have too few rows, the small sources of the language; else all that is left.

    ``grp`` is NULL where even that is too little.  ``fit`` tells which rows count."""
    counts = durable(rows.filter("fit").groupBy("key", "lang_key").agg(F.count(F.lit(1)).alias("n")))
    small = counts.filter(F.col("n") < rules.least).groupBy("lang_key").agg(F.sum("n").alias("n_small"))
    levels = counts.join(small, "lang_key", "left").select(
        "key", "n", F.when(F.col("n") >= rules.least, F.concat(F.lit("source:"), "key")).when(F.col("n_small") >= rules.least, F.concat(F.lit("lang:"), "lang_key")).otherwise("rest").alias("grp")
    )
    levels = durable(levels)
    rest = levels.filter("grp = 'rest'").agg(F.sum("n")).first()[0] or 0
    named = levels.select("key", "grp" if rest >= rules.least else F.nullif("grp", F.lit("rest")).alias("grp"))
    size = named.count()
    return _beside(rows, named, size, "key", "left"), size


def _starts(fit: DataFrame) -> DataFrame:
    """Two estimates a group: medians with quartile ranges, and mean with covariance.

    The medians are exact; their buffers hold a counter per distinct whole number, which the step bounds."""
    quartiles = [F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(_P)]
    found = durable(fit.groupBy("grp").agg(*_moments(), *quartiles))
    plain = _estimate(found, 1.0, ["grp"])
    spread = lambda i: F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(2.0))
    middle = {f"m{i}": F.col(f"p{i}")[1] for i in range(_P)} | {f"c{i}{j}": spread(i) + _FLOOR[i] if i == j else F.lit(0.0) for i, j in _PAIRS}
    robust = _inverted(found.withColumns(middle), ["grp"])
    return robust.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1)))


def _concentrated(fit: DataFrame, state: DataFrame, size: int, rules: Rules) -> DataFrame:
    """One step: the moments of the nearest ``share`` of each group's rows, by whole bins of the distance."""
    near = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-10))) * BINS).alias("bin")
    rows = _beside(fit, state, 2 * size, "grp").select("grp", "start", near, *[f"z{i}" for i in range(_P)])
    bins = rows.groupBy("grp", "start", "bin").agg(*_moments())
    upto = Window.partitionBy("grp", "start").orderBy("bin")
    every = Window.partitionBy("grp", "start")
    inside = bins.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "all": F.sum("n").over(every)}).filter(F.col("before") < rules.share * F.col("all"))
    chosen = inside.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
    return _estimate(chosen, _consistent(rules.share, _P), ["grp", "start"])


def judged(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of ``statistics`` with base_failed, ``distance`` (squared, NULL without an estimate) and kept.

    Rows that fail the base rules are rejected and take no part in the estimates.  Language and source
    may be NULL, which is a value like any other.  A group of fewer than ``least`` rows joins the other
    small sources of its language, then everything small; if that is not enough either, its rows are kept.
    Repeated rows count as often as they are there.  An empty table gives none.
    """
    whole = {f"z{i}": F.round(value() * STEP).cast("int") for i, (value, _) in enumerate(STATISTICS.values())}
    keys = {"key": F.to_json(F.struct("lang", "source")), "lang_key": F.to_json(F.struct("lang")), "base_failed": base_failed(rules)}
    rows = durable(stats.withColumns(whole | keys).withColumn("fit", ~F.col("base_failed")))
    grouped, size = _grouped(rows, rules)
    grouped = durable(grouped)
    fit = grouped.filter("fit AND grp IS NOT NULL").select("grp", *[f"z{i}" for i in range(_P)])
    state = durable(_starts(fit))
    for _ in range(rules.steps):
        state = durable(_concentrated(fit, state, size, rules))
    best = durable(state.groupBy("grp").agg(F.min_by(F.struct(*[c for c in state.columns if c not in ("grp", "start")]), F.struct("log_det", "start")).alias("e")).select("grp", "e.*"))
    inside = _beside(fit, best, size, "grp").filter(_distance() <= chi_square_at(rules.inner, _P))
    final = durable(_estimate(inside.groupBy("grp").agg(*_moments()), _consistent(rules.inner, _P), ["grp"]).drop("log_det"))
    told = _beside(grouped, final, size, "grp", "left").withColumn("distance", F.when(F.col("m0").isNotNull(), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square_at(rules.outer, _P))
    return told.select(*stats.columns, "base_failed", "distance", kept.alias("kept"))


def without_outliers(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, columns as given.  Rows of one id are decided each by its own text; repeated rows alike."""
    numbered = durable(docs.withColumn("__row", F.monotonically_increasing_id()))
    good = judged(statistics(numbered, ("__row", "lang", "source")), rules).filter("kept").select("__row")
    return numbered.join(good, "__row", "left_semi").drop("__row")
