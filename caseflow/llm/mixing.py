"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Built-in functions only.  Every source's documents are dealt into blocks by a hash of their id.  A
source's target is a number of whole passes over its blocks and a part of one more pass.  The
resulting block quotas of all sources are split down a binary tree: at every node the left half of
the output shards draws its blocks without replacement from the node's quotas, so each source's
count is hypergeometric given the others.  The leaves say how many blocks of each source a shard
holds; it gets them from that source's permuted block list, disjoint from all other shards, and
orders its documents by a hash.

The tree sees (source, quota) only: ``blocks`` x passes items a source, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import durable, same

# A word, the repeating weights, and the share of all words the mix is to hold.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Mix:
    """``share`` of all words; at most ``repeats`` passes over a source; ``blocks`` a source; 2**``depth`` shards."""

    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    repeats: int = 2
    blocks: int = 1024
    depth: int = 6
    seed: int = 17


#: What tells one row from another: rows that agree in it have the same text.
UNIT = ["doc_id", "source", "size", "hash"]


def _draw(mix: Mix, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), *parts), 11) / float(1 << 53)


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target): one row a source.

    Sources in code point order, NULL last, weigh ``weights`` in turn.  Where ``repeats`` times a source
    is less than its share, the rest is shared anew by weight.  The water level of that rule: sources
    fill up in the order of size per weight, and the last one that fills fixes what the others get.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_turn) - 1, F.lit(len(mix.weights))) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), turn))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(mix.repeats))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (mix.share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", level)
    # Up to the first source that does not fill, each one fills; from there on the level stays.
    first_open = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source", "level"))).over(everything)
    return leveled.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(first_open["level"] * F.col("weight"), F.col("cap"))).alias("target")
    )


def leaves(quotas: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, shard, first, last): which of its drawn blocks, numbered from 1, a shard gets.

    ``quotas`` holds (source, quota).  One row a node travels down the tree; its left half takes
    ``ceil(items / 2)`` of the node's items.  Item after item goes left with the chance
    (left places open) / (items left), which draws every source's left count without replacement.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("held"))
    node = node.select(F.lit(1).alias("node"), "held")
    for _ in range(mix.depth):
        total = F.aggregate("held", F.lit(0), lambda n, s: n + s["quota"])
        node = node.select("node", "held", total.alias("total"))

        def one(state: Column, item: Column, source: Column) -> Column:
            left = _draw(mix, F.col("node"), source, item) * state["rest"] < state["open"]
            return F.struct(
                (state["rest"] - 1).alias("rest"), (state["open"] - left.cast("int")).alias("open"), (state["took"] + left.cast("int")).alias("took")
            )

        def each(state: Column, s: Column) -> Column:
            start = F.struct(state["rest"].alias("rest"), state["open"].alias("open"), F.lit(0).alias("took"))
            items = F.when(s["quota"] > 0, F.sequence(F.lit(1), s["quota"])).otherwise(F.array().cast("array<int>"))
            end = F.aggregate(items, start, lambda st, i: one(st, i, s["source"]))
            return F.struct(end["rest"].alias("rest"), end["open"].alias("open"), F.concat(state["took"], F.array(end["took"])).alias("took"))

        start = F.struct(F.col("total").alias("rest"), F.ceil(F.col("total") / 2).cast("int").alias("open"), F.array().cast("array<int>").alias("took"))
        node = node.select("node", "held", F.aggregate("held", start, each, lambda st: st["took"]).alias("took"))
        half = lambda sign: F.zip_with(
            "held", "took",
            lambda s, k: F.struct(s["none"].alias("none"), s["source"].alias("source"), (k if sign else s["quota"] - k).alias("quota")),
        )
        node = node.select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), half(True).alias("held")), F.struct((F.col("node") * 2 + 1).alias("node"), half(False).alias("held")))).alias("c")
        ).select("c.node", "c.held")
    rows = node.select((F.col("node") - (1 << mix.depth)).alias("shard"), F.explode("held").alias("s")).select("s.source", "shard", "s.quota")
    upto = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    return rows.select("source", "shard", (upto - F.col("quota") + 1).alias("first"), upto.alias("last")).filter("last >= first")


def mixed(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: one row per input row with doc_id, size, source_size, target, taken.
    pieces: one row per use of a document with doc_id, source, size, hash (of its text), pass, words (how many of its leading
    words are used), shard, place (order within the shard).

    A source with target t and size s gives t // s whole passes and, of one more pass, permuted blocks
    until t is met; of the block in which it is met, documents in hash order; of the last document as
    many leading words as are still missing, so that a source's words are its target, rounded.  A
    document is thus used at most ``repeats`` times.  NULL text has no words and is in no piece; NULL
    is a source of its own.  Rows with equal ids are told apart by their text's hash; rows that agree in that
    too are drawn together.  No rows, or no words at all, give no pieces.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(text).cast("string")).alias("hash"),
    )
    # Equal rows may be several; the number of their copies keeps them one unit of the draw.
    rows = durable(rows)
    aims = durable(targets(rows, mix))
    keys = ["source"]
    units = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("copies"))
    key = F.xxhash64(F.lit(mix.seed), F.lit("block"), "doc_id", "size")
    units = units.withColumns({"block": F.pmod(key, F.lit(mix.blocks)).cast("int"), "order": F.xxhash64(F.lit(mix.seed), F.lit("order"), "doc_id", "size")})
    units = durable(units.filter("size > 0"))
    blocks = units.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    blocks = blocks.join(aims, same(blocks, aims, keys)).select(
        blocks["source"], "block", "words", F.floor(F.col("target") / F.col("source_size")).cast("int").alias("whole"),
        F.round("target").cast("long").alias("aim"), "source_size",
    )
    blocks = blocks.withColumn("missing", F.col("aim") - F.col("whole") * F.col("source_size"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(mix.seed), F.lit("permute"), "source", "block"), "block")
    blocks = blocks.withColumns({"rank": F.row_number().over(permuted), "before": F.sum("words").over(permuted) - F.col("words")})
    blocks = durable(blocks.withColumn("budget", F.least("words", F.greatest(F.col("missing") - F.col("before"), F.lit(0)))))

    # Blocks as items of the draw: pass by pass, and within a pass in permuted order.
    n_blocks = F.count(F.lit(1)).over(Window.partitionBy("source"))
    items = blocks.withColumn("n", n_blocks).select(
        "source", "block", "words", "budget", "n", "rank", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("pass"), "whole"
    )
    items = items.filter("pass < whole OR budget > 0").withColumn("item", F.col("pass") * F.col("n") + F.col("rank"))
    quotas = items.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("quota"))
    shares = durable(leaves(quotas, mix))
    spread = durable(shares.select(F.col("source"), "shard", F.explode(F.sequence("first", "last")).alias("item")))
    placed = durable(
        items.join(spread, same(items, spread, ["source", "item"])).select(
            items["source"], "block", "pass", "shard", F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.col("budget")).alias("budget")
        )
    )
    used = units.join(placed, same(units, placed, ["source", "block"])).select(units["*"], "pass", "shard", "budget")
    within = Window.partitionBy("source", "block", "pass").orderBy("order", "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    used = used.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    used = used.select("*", copy.alias("copy"))
    words = F.least("size", F.greatest(F.col("budget") - F.col("before") - (F.col("copy") - 1) * F.col("size"), F.lit(0)))
    pieces = used.withColumn("words", words).filter("words > 0").select(
        *UNIT, "copy", "pass", "words", "shard",
        F.xxhash64(F.lit(mix.seed), F.lit("place"), "shard", "doc_id", "copy", "pass").alias("place"),
    )
    pieces = durable(pieces)
    taken = pieces.groupBy(*UNIT, "copy").agg(F.sum("words").alias("taken"))
    # Rows that agree in everything are numbered; which of them has which number is all one.
    numbered = durable(rows.withColumn("copy", F.row_number().over(Window.partitionBy(*UNIT).orderBy("doc_id"))))
    with_taken = numbered.join(taken, same(numbered, taken, [*UNIT, "copy"]), "left").select(numbered["*"], "taken")
    documents = with_taken.join(aims, same(with_taken, aims, keys)).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, pieces


def mixture(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per use of a document, by shard and in its order.

    A document of which only leading words are used ends behind the last of them.
    """
    pieces = mixed(docs, mix, doc_id, text, source)[1]
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*UNIT).orderBy("doc_id")))
    joined = rows.join(pieces, same(rows, pieces, [*UNIT, "copy"])).select("row", rows["size"], "words", "shard", "place")
    whole = F.col(f"row.{text}")
    # Possessive, so that many words need no deep stack.
    pattern = F.concat(F.lit("^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){"), F.col("words").cast("string"), F.lit("}+"))
    leading = F.call_function("regexp_extract", whole, pattern, F.lit(0))
    cut = joined.withColumn("__text", F.when(F.col("words") < F.col("size"), leading).otherwise(whole))
    placed = cut.repartition("shard").sortWithinPartitions("shard", "place")
    return placed.select(*[F.col("__text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
