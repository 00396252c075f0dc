"""Encodings of a case prefix: padded token sequences and n-gram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.locations import ACTIVITY_IDS, by_unit
from caseflow.operators.events import ORDER, prefix
from caseflow.operators.ordered import shifted

MAX_LEN = 30
MAX_NGRAM = 3
MIN_DF = 2


def unknown_activities(log: DataFrame, vocabulary: dict[str, int] = ACTIVITY_IDS) -> DataFrame:
    """Activities outside the vocabulary with their counts; must be empty before encoding."""
    return log.filter(~F.col("activity").isin(*vocabulary)).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def left_pad(tokens: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(tokens))), tokens)


def right_pad(tokens: Column, length: int) -> Column:
    """Move the padding of a padded sequence to the end."""
    kept = F.filter(tokens, lambda t: t != 0)
    return F.concat(kept, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(kept))))


def token_count(tokens: Column) -> Column:
    """Number of real tokens of a padded sequence, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(tokens, lambda t: t != 0)))


def encode_sequences(
    log: DataFrame, points: DataFrame, vocabulary: dict[str, int] = ACTIVITY_IDS, max_len: int = MAX_LEN, by: list[str] = []
) -> DataFrame:
    """(hadm_id, seq): the last ``max_len`` token ids before the point, left-padded with 0.

    Cases without an event before their point are absent; an activity the vocabulary lacks is an error
    (``unknown_activities`` lists them).  Only ``max_len`` rows per case are ever
    gathered: the rank limit is applied before and after the exchange.
    """
    unknown = F.raise_error(F.concat(F.lit("activity without a token: "), F.coalesce("activity", F.lit("NULL")))).cast("int")
    token = F.coalesce(by_unit("activity", vocabulary), unknown)
    before = prefix(log, points).select(*by, "case_id", *ORDER, token.alias("token"))
    latest = Window.partitionBy("case_id", *by).orderBy(*[F.col(c).desc() for c in ORDER])
    last = before.withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= max_len)
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), "token")))
    tokens = last.groupBy("case_id", *by).agg(F.transform(in_order, lambda t: t["token"]).alias("seq"))
    return tokens.select(*by, F.col("case_id").alias("hadm_id"), left_pad(F.col("seq"), max_len).alias("seq"))


def sequence_profile(log: DataFrame, points: DataFrame, max_len: int = MAX_LEN, by: list[str] = []) -> DataFrame:
    """Lengths of the prefixes, how many are cut, how many cases have none."""
    lengths = prefix(log, points).groupBy("case_id", *by).agg(F.count(F.lit(1)).alias("n"))
    joined = points.select(*by, F.col("hadm_id").alias("case_id")).join(lengths, ["case_id", *by], "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count("n").alias("encoded"),
        F.count_if(F.col("n").isNull()).alias("dropped"),
        F.min("n").alias("min_len"),
        F.avg("n").alias("mean_len"),
        F.max("n").alias("max_len"),
        # The buffer holds one counter per distinct length, not one entry per case.
        F.percentile("n", F.lit(0.95)).alias("p95_len"),
        F.count_if(F.col("n") > max_len).alias("truncated"),
    )


def ngrams(
    log: DataFrame, points: DataFrame, longest: int = MAX_NGRAM, inclusive: bool = False, by: list[str] = []
) -> DataFrame:
    """(hadm_id, ngram, n): counts of 1..longest consecutive activities of the prefix, in long form.

    Tokens are lower-cased with spaces as underscores; the words of an n-gram are joined by a space.
    Followers come from neighbouring rows, so no case is ever gathered into one list.
    """
    keys = ["hadm_id", *by]
    word = F.lower(F.replace("activity", F.lit(" "), F.lit("_")))
    tokens = prefix(log, points, inclusive).select(F.col("case_id").alias("hadm_id"), *by, *ORDER, word.alias("w0"))
    followers = {f"w{i}": (F.col("w0"), i) for i in range(1, longest)}
    linked = shifted(tokens, keys, ORDER, followers) if followers else tokens
    # concat is NULL as soon as one word is missing, which removes n-grams beyond the end.
    grams = [F.concat(*_spaced([F.col(f"w{i}") for i in range(n)])) for n in range(1, longest + 1)]
    return (
        linked.select(*keys, F.explode(F.array_compact(F.array(*grams))).alias("ngram"))
        .groupBy(*keys, "ngram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _spaced(words: list[Column]) -> list[Column]:
    return [part for i, w in enumerate(words) for part in ((F.lit(" "), w) if i else (w,))]


def fit_vocabulary(counts: DataFrame, fit_ids: DataFrame | None, min_df: int = MIN_DF, by: list[str] = []) -> DataFrame:
    """(ngram, df): n-grams found in at least ``min_df`` of the cases to fit on (all cases for None)."""
    rows = counts if fit_ids is None else counts.join(fit_ids.select("hadm_id", *by), ["hadm_id", *by], "left_semi")
    return rows.groupBy(*by, "ngram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)


def bag_of_ngrams(counts: DataFrame, vocabulary: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts of the fitted n-grams for every case, long form."""
    return counts.join(vocabulary.select(*by, "ngram"), [*by, "ngram"], "left_semi")


#: The boundaries of the leak audit and the counts they are made from.
#: A: prefix including the point, fitted on all cases; B: strict prefix, all cases; C: strict prefix, training cases.
BOUNDARIES = {"A": "n_upto", "B": "n_before", "C": "n_before"}


def flagged_ngrams(log: DataFrame, points: DataFrame, longest: int = MAX_NGRAM, by: list[str] = []) -> DataFrame:
    """(hadm_id, ngram, n_upto, n_before): counts up to and strictly before the point, from one pass over the events.

    Events before the point come first in their case, so an n-gram lies before it if its last event does.
    """
    keys = ["hadm_id", *by]
    word = F.lower(F.replace("activity", F.lit(" "), F.lit("_")))
    upto = prefix(log, points, inclusive=True)
    tokens = upto.select(F.col("case_id").alias("hadm_id"), *by, *ORDER, word.alias("w0"), (F.col("event_time") < F.col("prediction_point")).alias("b0"))
    followers = {f"{c}{i}": (F.col(f"{c}0"), i) for i in range(1, longest) for c in "wb"}
    linked = shifted(tokens, keys, ORDER, followers) if followers else tokens
    grams = [F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(F.concat(*_spaced([F.col(f"w{i}") for i in range(n)])).alias("ngram"), F.col(f"b{n - 1}").alias("before"))) for n in range(1, longest + 1)]
    exploded = linked.select(*keys, F.explode(F.array_compact(F.array(*grams))).alias("g"))
    return exploded.groupBy(*keys, F.col("g.ngram").alias("ngram")).agg(F.count(F.lit(1)).alias("n_upto"), F.count_if("g.before").alias("n_before"))


def boundary_vocabularies(counts: DataFrame, train_ids: DataFrame, min_df: int = MIN_DF, by: list[str] = []) -> DataFrame:
    """(ngram, A, B, C): which boundaries have the n-gram in their vocabulary, from one aggregation of ``flagged_ngrams``."""
    trained = train_ids.select("hadm_id", *by).distinct().withColumn("__train", F.lit(True))
    rows = counts.join(trained, ["hadm_id", *by], "left")
    before = F.col("n_before") > 0
    return rows.groupBy(*by, "ngram").agg(
        (F.count(F.lit(1)) >= min_df).alias("A"), (F.count_if(before) >= min_df).alias("B"), (F.count_if(before & F.col("__train").isNotNull()) >= min_df).alias("C")
    )


def leak_audit(log: DataFrame, points: DataFrame, train_ids: DataFrame, min_df: int = MIN_DF, by: list[str] = []) -> DataFrame:
    """Vocabulary sizes under three boundaries, and how many n-grams each leaky one has on top.

    A: prefix including the point, fitted on all cases; B: strict prefix, all cases; C: strict, train only.
    """
    leaky, strict = ngrams(log, points, inclusive=True, by=by), ngrams(log, points, by=by)
    fits = {"A": (leaky, None), "B": (strict, None), "C": (strict, train_ids)}
    merged = None
    for name, (counts, ids) in fits.items():
        one = fit_vocabulary(counts, ids, min_df, by).select(*by, "ngram", F.lit(name).alias("setting"))
        merged = one if merged is None else merged.unionByName(one)
    presence = merged.groupBy(*by, "ngram").agg(*[F.bool_or(F.col("setting") == s).alias(s) for s in fits])
    in_c = F.coalesce(F.col("C"), F.lit(False))
    rows = [
        F.struct(
            F.lit(s).alias("setting"),
            F.count_if(F.col(s)).alias("n_ngrams"),
            F.count_if(F.col(s) & ~in_c).alias("n_leaked"),
        )
        for s in fits
    ]
    return presence.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.inline("rows"))
