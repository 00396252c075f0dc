"""URL filter: explicit rules first, then a logistic regression on hashed character n-grams.

Built-in functions and Spark ML only.  The small labelled table is what the rules say about a bounded
number of urls: their verdicts are the labels, and the model carries them over to urls that no rule
fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    """``labelled``: urls the model is fitted on at most (those with the smallest hash of their host and path)."""

    least: int = 2
    most: int = 4
    buckets: int = 1 << 14
    labelled: int = 20_000
    penalty: float = 1e-3
    rounds: int = 50


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path`` beside all columns; both are empty where the url is NULL or has no ``://``."""
    found = lambda group: F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return pages.withColumns({"host": F.translate(found(1), UPPER, LOWER), "path": found(2)})


def rule_of(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or NULL.  The rules are a short list, tested longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        fits = host & F.startswith(F.col("path"), F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(settings: Settings) -> Column:
    """The distinct character n-grams of host and path; the sign before each tells the two apart."""

    def of(text: Column, mark: str) -> Column:
        n_grams = [
            F.when(
                F.length(text) >= n,
                F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n)))),
            ).otherwise(F.array().cast("array<string>"))
            for n in range(settings.least, settings.most + 1)
        ]
        return F.concat(*n_grams)

    host, path = F.concat(F.lit("^"), "host", F.lit("$")), F.concat(F.lit("^"), "path", F.lit("$"))
    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


def fit(judged: DataFrame, settings: Settings) -> PipelineModel | None:
    """The model fitted on urls that a rule has judged; None where the rules gave fewer than two verdicts."""
    known = judged.filter("rule IS NOT NULL").select("host", "path", (F.col("ruled") == "allow").cast("double").alias("label"))
    # Distinct urls in hash order: a bounded sample that does not hang on the order of rows.
    table = known.distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(settings.labelled)
    table = table.select(grams(settings).alias("grams"), "label").cache()
    try:
        if table.select("label").distinct().count() < 2:
            return None
        hashing = HashingTF(numFeatures=settings.buckets, binary=True, inputCol="grams", outputCol="features")
        learner = LogisticRegression(maxIter=settings.rounds, regParam=settings.penalty, tol=1e-8, standardization=False, probabilityCol="chance")
        return Pipeline(stages=[hashing, learner]).fit(table)
    finally:
        table.unpersist()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, allow_chance (the model's, NULL where a rule decides).

    A url without host and path (NULL, or no ``://``) is judged by the model like any other that no rule
    fits.  Where the rules judge no two urls differently there is nothing to learn: the one verdict seen,
    or ``allow``, holds for the rest.  Repeated rows are answered each; no rows give none.
    """
    name, verdict = rule_of(rules)
    rows = parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")))
    judged = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    model = fit(judged, settings)
    if model is None:
        seen = judged.filter("ruled IS NOT NULL").select("ruled").first()
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(seen["ruled"] if seen else "allow")).alias("verdict"), F.lit(None).cast("double").alias("allow_chance"))
    open_ones = judged.filter("rule IS NULL").withColumn("grams", grams(settings))
    scored = model.transform(open_ones).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("prediction") == 1.0, "allow").otherwise("block").alias("verdict"),
        F.element_at(vector_to_array("chance"), 2).alias("allow_chance"),
    )
    ruled = judged.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("allow_chance"))
    return ruled.unionByName(scored)
