"""Train / validation / test partitions and the checks that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.ordered import positions

SEED, TEST_FOLDS, VAL_FOLDS = 42, 5, 9
PARTS = ("train", "val", "test")


def _dealt(position: str, test_folds: int, val_folds: int) -> Column:
    """Deal 1-based positions into parts: every test_folds-th is test, of the rest every val_folds-th is val."""
    at = F.col(position) - 1
    rest = at - F.floor(at / test_folds) - 1
    return F.when(at % test_folds == 0, "test").when(rest % val_folds == 0, "val").otherwise("train")


def grouped_split(
    labels: DataFrame, label: str, seed: int = SEED, test_folds: int = TEST_FOLDS, val_folds: int = VAL_FOLDS, by: list[str] = []
) -> DataFrame:
    """(hadm_id, subject_id, label, part) such that no subject is in two parts.

    Subjects are stratified by whether they have a positive case, ordered by a hash of id and seed,
    and dealt in turn.  Strata are only two, so their positions come from the hot-key path at scale.
    ``by`` names columns (such as a cohort) whose values are split independently.
    """
    subjects = labels.groupBy(*by, "subject_id").agg(F.max(label).alias("stratum"))
    hashed = subjects.withColumn("m", F.md5(F.concat_ws(":", F.col("subject_id").cast("string"), F.lit(str(seed)))))
    dealt = positions(hashed, [*by, "stratum"], ["m", "subject_id"]).select(
        *by, "subject_id", _dealt("pos", test_folds, val_folds).alias("part")
    )
    cases = labels.select(*by, "hadm_id", "subject_id", label)
    return cases.join(dealt, [*by, "subject_id"]).select(*by, "hadm_id", "subject_id", label, "part")


def stratified_split(
    labels: DataFrame, label: str, seed: int = SEED, test_folds: int = 5, val_folds: int = 10, by: list[str] = []
) -> DataFrame:
    """As ``grouped_split`` but case by case: subjects may end up in several parts."""
    hashed = labels.select(*by, "hadm_id", "subject_id", label).withColumn(
        "m", F.md5(F.concat_ws(":", F.col("hadm_id").cast("string"), F.lit(str(seed))))
    )
    dealt = positions(hashed, [*by, label], ["m", "hadm_id"])
    return dealt.withColumn("part", _dealt("pos", test_folds, val_folds)).drop("m", "pos")


def split_checks(split: DataFrame, cohort: DataFrame, by: list[str] = []) -> DataFrame:
    """(check, n_bad): overlap of cases, overlap of subjects, cases missing from or foreign to the split."""

    def in_two(key: str) -> DataFrame:
        parts = split.groupBy(*by, key).agg(F.count_distinct("part").alias("n"))
        return parts.groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("n_bad"))

    keys = [*by, "hadm_id"]
    ids = cohort.select(*keys).distinct().withColumn("c", F.lit(1))
    both = split.select(*keys).distinct().withColumn("s", F.lit(1)).join(ids, keys, "full").groupBy(*by)
    unknown = ~F.coalesce(F.col("part").isin(*PARTS), F.lit(False))
    named = {
        "case_in_two_parts": in_two("hadm_id"),
        "subject_in_two_parts": in_two("subject_id"),
        "not_covered": both.agg(F.count_if(F.col("s").isNull()).alias("n_bad")),
        "not_in_cohort": both.agg(F.count_if(F.col("c").isNull()).alias("n_bad")),
        "unknown_part": split.groupBy(*by).agg(F.count_if(unknown).alias("n_bad")),
    }
    return reduce(
        lambda a, b: a.unionByName(b),
        [df.select(*by, F.lit(name).alias("check"), "n_bad") for name, df in named.items()],
    )


def split_profile(split: DataFrame, label: str, by: list[str] = []) -> DataFrame:
    counts = split.groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.sum(label).alias("n_pos"),
        F.round(F.avg(label), 4).alias("pos_rate"),
    )
    every = Window.partitionBy(*(by or [F.lit(0)]))  # three rows per value of ``by``
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(every), 4))


def digest_parts(split: DataFrame, by: list[str] = []) -> DataFrame:
    """(part, n, digest): an order-free fingerprint of the ids of each part.

    Each id is hashed and the hashes are combined by XOR, so the digest is one small aggregate at any
    size; no id list is gathered.  Equal ids give an equal digest whatever the order.
    """
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "part", F.col("hadm_id").cast("string"))), 1, 15), 16, 10)
    return split.groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(hashed.cast("bigint")).alias("digest")
    )


def split_digest(split: DataFrame, by: list[str] = []) -> DataFrame:
    """16 hex digits over the three part digests; an empty part counts as 0."""
    part = lambda p: F.concat_ws(
        ":",
        F.lit(p),
        F.coalesce(F.max(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).cast("string"),
        F.coalesce(F.max(F.when(F.col("part") == p, F.col("digest"))), F.lit(0)).cast("string"),
    )
    return digest_parts(split, by).groupBy(*by).agg(
        F.sum("n").alias("n_common"),
        F.substring(F.sha2(F.concat_ws("|", *[part(p) for p in PARTS]), 256), 1, 16).alias("split_id"),
    )


NODE_BITS = 10


def digest_tree(ids: DataFrame, by: list[str] = [], key: str = "hadm_id", bits: int = NODE_BITS, levels: int | None = None) -> DataFrame:
    """(by, level, node, n, digest): a hash tree over a set of ids, so that a difference can be traced to a range of ids.

    A leaf is the range of ``2**bits`` ids that share their upper bits; its digest is sha256 over ``id:count`` in
    ascending order, so a repeated id changes it.  A node above is sha256 over ``node=digest`` of its children.
    The last level, node 0, is the root.  No list is longer than ``2**bits`` entries, however many ids there are;
    an id more or less changes one leaf only.
    """
    counts = ids.groupBy(*by, F.col(key).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    if levels is None:
        widest = counts.agg(F.max(F.greatest(F.abs("id"), F.lit(1)))).first()[0] or 1
        levels = max(1, -(-int(widest).bit_length() // bits))
    entry = F.concat_ws(":", F.col("id").cast("string"), F.col("c").cast("string"))
    rows = counts.select(*by, F.shiftright("id", bits).alias("node"), F.col("id").alias("child"), entry.alias("entry"), F.col("c").alias("n"))
    tree = None
    for level in range(levels + 1):
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "entry"))), lambda x: x["entry"]), ",")
        nodes = rows.groupBy(*by, "node").agg(F.sum("n").alias("n"), F.sha2(listed, 256).alias("digest"))
        found = nodes.select(*by, F.lit(level).alias("level"), "node", "n", "digest")
        tree = found if tree is None else tree.unionByName(found)
        # Above the top level everything left is one root.
        above = F.shiftright("node", bits) if level < levels - 1 else F.lit(0).cast("bigint")
        rows = nodes.select(*by, above.alias("node"), F.col("node").alias("child"), F.concat_ws("=", F.col("node").cast("string"), "digest").alias("entry"), "n")
    return tree


def differing_ranges(left: DataFrame, right: DataFrame, by: list[str] = [], bits: int = NODE_BITS) -> DataFrame:
    """(by, first_id, last_id, n_left, n_right) of the leaves in which two trees differ; only digests are compared."""
    keys = [*by, "node"]
    leaves = lambda df, side: df.filter("level = 0").select(*keys, F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"d_{side}"))
    both = leaves(left, "left").join(leaves(right, "right"), keys, "full").filter(~F.col("d_left").eqNullSafe(F.col("d_right")))
    first = F.shiftleft("node", bits)
    return both.select(*by, first.alias("first_id"), (first + F.lit(2**bits - 1)).alias("last_id"), *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("left", "right")])


def manifest(split: DataFrame, cohort: str, variant: str, stratified_on: str, seed: int = SEED) -> DataFrame:
    """The one-row description stored next to the (id, part) table."""
    return split_digest(split).select(
        F.lit(cohort).alias("cohort"),
        F.lit(variant).alias("variant"),
        F.lit("subject_id").alias("grouped_on"),
        F.lit(stratified_on).alias("stratified_on"),
        F.lit(seed).alias("seed"),
        "n_common",
        "split_id",
    )


def write_split(split: DataFrame, described: DataFrame, folder: str) -> None:
    """The parts, the hash tree of their ids, and the manifest last."""
    split.select("hadm_id", "subject_id", "part").write.mode("errorifexists").parquet(f"{folder}/parts")
    digest_tree(split, ["part"]).write.mode("errorifexists").parquet(f"{folder}/tree")
    described.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def read_split(spark, folder: str, stratified_on: str = "lat") -> DataFrame:
    """Read a stored split; refuse it unless grouping, stratification, digest and hash tree are as expected.

    A refusal names (at most 20 of) the id ranges that differ from what was written."""
    parts = spark.read.parquet(f"{folder}/parts")
    said = spark.read.json(f"{folder}/manifest").first()
    found = split_digest(parts).first()
    wrong = [
        name
        for name, bad in {
            "grouped_on": said["grouped_on"] != "subject_id",
            "stratified_on": said["stratified_on"] != stratified_on,
            "split_id": said["split_id"] != found["split_id"],
            "n_common": said["n_common"] != found["n_common"],
        }.items()
        if bad
    ]
    for r in split_differences(spark, folder).limit(20).collect():
        wrong.append(f"ids {r['first_id']} to {r['last_id']} of part {r['part']}: {r['n_left']} written, {r['n_right']} found")
    if wrong:
        raise ValueError(f"split in {folder} fails verification: {', '.join(wrong)}")
    return parts


def split_differences(spark, folder: str) -> DataFrame:
    """The id ranges in which the rows of a stored split differ from the tree stored with them."""
    return differing_ranges(spark.read.parquet(f"{folder}/tree"), digest_tree(spark.read.parquet(f"{folder}/parts"), ["part"]), ["part"])


def set_overlap(left: DataFrame, right: DataFrame, by: list[str] = [], key: str = "hadm_id") -> DataFrame:
    """Sizes, shared and one-sided counts and Jaccard of two id sets."""
    a = left.select(*by, key).distinct().withColumn("a", F.lit(1))
    b = right.select(*by, key).distinct().withColumn("b", F.lit(1))
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = F.count_if(has_a & has_b)
    return a.join(b, [*by, key], "full").groupBy(*by).agg(
        F.count_if(has_a).alias("n_left"),
        F.count_if(has_b).alias("n_right"),
        both.alias("n_shared"),
        F.count_if(has_a & ~has_b).alias("only_left"),
        F.count_if(~has_a & has_b).alias("only_right"),
        F.round(both / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("jaccard"),
    )


def of_part(df: DataFrame, split: DataFrame, part: str) -> DataFrame:
    return df.join(split.filter(F.col("part") == part).select("hadm_id"), "hadm_id", "left_semi")


def provenance(results: DataFrame) -> DataFrame:
    """Per cohort and variant: how many split ids, rows without one, and whether merging is allowed."""
    blank = F.coalesce(F.trim("split_id") == "", F.lit(True))
    return results.groupBy("Cohort", "Variant").agg(
        F.count_distinct(F.when(~blank, F.col("split_id"))).alias("n_split_ids"),
        F.count_if(blank).alias("n_missing"),
        (F.count_distinct(F.when(~blank, F.col("split_id"))) <= 1).alias("ok"),
    )


def require_one_split(results: DataFrame) -> DataFrame:
    """The results unchanged, or an error naming (at most 20 of) the mixed cells."""
    mixed = provenance(results).filter("NOT ok").limit(20).collect()
    if mixed:
        cells = ", ".join(f"{r['Cohort']}/{r['Variant']} ({r['n_split_ids']} split ids)" for r in mixed)
        raise ValueError(f"refusing to merge results of different partitions: {cells}")
    return results
