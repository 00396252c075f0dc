"""Queries that write data down, read it back and check it, and narrow forms of operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.functions import locations as loc
from caseflow.operators import analysis as an
from caseflow.operators import encode as en
from caseflow.operators import events as ev
from caseflow.operators import features as ft
from caseflow.operators import gate
from caseflow.operators import models as mo
from caseflow.operators import split as sp
from caseflow.plans import oracle
from caseflow.plans import pipeline as pl
from caseflow.plans.queries import BY, QUERIES, keeping_query, query
from caseflow.session import durable, shared_folder
from caseflow.sources import mapping as m
from caseflow.sources import tables as tb

__all__ = ["QUERIES", "ORACLE"]
ORACLE = oracle.ORACLE


def _new_folder(t) -> str:
    return f"{shared_folder(t.spark)}/written-{uuid.uuid4().hex}"


# --- rejected rows ------------------------------------------------------------------------------------------------

_RAW = tb.schema_of("event_id BIGINT, event_type STRING, event_time STRING")


def _damaged_export(t, **options) -> str:
    """Events as text, some with a word for a number, without a time, or with something else for a time."""
    key = F.col("event_id")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = m.table(*t.at, "events").select(
        F.when(key % 19 == 0, F.concat(F.lit("no"), key.cast("string"))).otherwise(key.cast("string")).alias("event_id"),
        "event_type",
        F.when(key % 17 == 0, "").when(key % 13 == 0, "next day").when(key % 11 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).otherwise(text).alias("event_time"),
    )
    folder = _new_folder(t)
    rows.write.option("header", True).options(**options).csv(folder)
    return folder


@query
def rejected_rows(t):
    """How many rows of a damaged export are good, in two time formats, and how many are rejected for which reason."""
    read = tb.read_csv_checked(t.spark, _damaged_export(t), _RAW, ("event_time",), (tb.TIMESTAMP_FORMAT, "dd.MM.yyyy HH:mm"))
    good = read.good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n"), F.min("event_time").cast("string").alias("first_time"), F.max("event_id").alias("last_id"))
    bad = read.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad, allowMissingColumns=True).withColumns({"first_time": F.coalesce("first_time", F.lit("")), "last_id": F.coalesce("last_id", F.lit(0))})


_REASON = """CASE WHEN event_id % 19 = 0 THEN 'malformed' WHEN event_id % 17 = 0 THEN 'missing event_time' WHEN event_id % 13 = 0 THEN 'bad event_time' ELSE 'good' END"""
ORACLE["rejected_rows"] = f"""SELECT reason, count(*) AS n, CASE WHEN reason = 'good' THEN strftime(min(CASE WHEN event_id % 11 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END), '%Y-%m-%d %H:%M:%S')
    ELSE '' END AS first_time, CASE WHEN reason = 'good' THEN max(event_id) ELSE 0 END AS last_id FROM (SELECT *, {_REASON} AS reason FROM events) GROUP BY reason"""


@query
def coerced_log(t):
    """The cleaning report of a log whose times are text."""
    log = tb.read_csv(t.spark, f"{_damaged_export(t)}/*.csv", tb.schema_of("event_id STRING, event_type STRING, event_time STRING"))
    rows = log.select(F.col("event_id").alias("case_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("activity"), "event_time")
    # The export's second format is no time to the cleaning rule.
    return ev.cleaning_report(rows).join(ev.clean_log(rows).agg(F.count(F.lit(1)).alias("cleaned")))


ORACLE["coerced_log"] = """SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS unnamed, count(*) FILTER (event_type <> 'error' AND NOT fine) AS bad_time,
    count(*) FILTER (event_type <> 'error' AND fine) AS kept, count(*) FILTER (event_type <> 'error' AND fine) AS cleaned
    FROM (SELECT *, event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 11 <> 0 AS fine FROM events)"""


@query
def gzip_folder(t):
    """Compressed files of a folder, read with a typed time and spread over tasks."""
    folder = _new_folder(t)
    rows = m.table(*t.at, "events").select("event_id", "event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    rows.repartition(3).write.option("header", True).option("timestampNTZFormat", tb.TIMESTAMP_FORMAT).option("compression", "gzip").csv(folder)
    read = tb.read_gzip_folder(t.spark, folder, tb.schema_of("event_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ"), 4)
    return read.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))


ORACLE["gzip_folder"] = """SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, date_trunc('second', min(ts))::TIMESTAMP AS first_time,
    date_trunc('second', max(ts))::TIMESTAMP AS last_time FROM events GROUP BY event_type"""


# --- stores -------------------------------------------------------------------------------------------------------


@keeping_query
def sequence_store(t):
    """Encoded sequences written and read back, decoded by the stored vocabulary to the last activity."""
    folder = _new_folder(t)
    own = pl.points(t).filter("cohort = 'SW'").drop("cohort")
    tb.write_sequences(en.encode_sequences(pl.log(t), own), f"{folder}/sequences")
    tb.write_vocabulary(t.spark, loc.ACTIVITY_IDS, f"{folder}/vocabulary")
    rows = tb.read_parquet(t.spark, f"{folder}/sequences").select("hadm_id", F.col("seq")[en.MAX_LEN - 1].alias("activity_id"), en.token_count(F.col("seq")).alias("n_tokens"))
    return rows.join(tb.read_vocabulary(t.spark, f"{folder}/vocabulary"), "activity_id").select("hadm_id", "n_tokens", F.col("activity").alias("last_activity"))


ORACLE["sequence_store"] = oracle.sql("""SELECT case_id AS hadm_id, least(count(*), 30)::INTEGER AS n_tokens, arg_max(activity, (event_time, tie)) AS last_activity
    FROM prefix WHERE cohort = 'SW' GROUP BY case_id""")


@query
def split_tree(t):
    """Hash tree over the ids of every part: leaves of 1 024 ids, one level above, and the root."""
    return sp.digest_tree(pl.split(t), [*BY, "part"], levels=2)


_LEVEL = "SELECT cohort, part, {level} AS level, {node} AS node, sum(n)::BIGINT AS n, sha256(string_agg({entry}, ',' ORDER BY {by})) AS digest FROM {source} GROUP BY cohort, part, {node}"
oracle.add_cte("tree_ids", "SELECT cohort, part, hadm_id AS id, count(*) AS n FROM split GROUP BY ALL")
oracle.add_cte("tree_leaves", _LEVEL.format(level=0, node="id >> 10", entry="id || ':' || n", by="id", source="tree_ids"))
oracle.add_cte("tree_nodes", _LEVEL.format(level=1, node="node >> 10", entry="node || '=' || digest", by="node", source="tree_leaves"))
oracle.add_cte("tree_root", _LEVEL.format(level=2, node="0::BIGINT", entry="node || '=' || digest", by="node", source="tree_nodes").replace("GROUP BY cohort, part, 0::BIGINT", "GROUP BY cohort, part"))
ORACLE["split_tree"] = oracle.sql("SELECT * FROM tree_leaves UNION ALL SELECT * FROM tree_nodes UNION ALL SELECT * FROM tree_root")


@query
def split_tampered(t):
    """A stored split whose rows are changed afterwards: which ranges of ids of which part no longer hold."""
    rows = durable(pl.split(t).filter("cohort = 'SW'").drop("cohort"))
    folder = _new_folder(t)
    sp.write_split(rows, sp.manifest(rows, "SW", "lat", "lat"), folder)
    kept = sp.read_split(t.spark, folder).count() - rows.count()  # what is as written passes
    # One id in 31 is lost, one in 23 is there twice.
    changed = rows.filter("hadm_id % 31 <> 0").unionByName(rows.filter("hadm_id % 23 = 0 AND hadm_id % 31 <> 0"))
    found = sp.differing_ranges(t.spark.read.parquet(f"{folder}/tree"), sp.digest_tree(changed, ["part"]), ["part"])
    return found.withColumn("lost_when_read", F.lit(kept))


ORACLE["split_tampered"] = oracle.sql("""SELECT part, (hadm_id >> 10) * 1024 AS first_id, (hadm_id >> 10) * 1024 + 1023 AS last_id, count(*) AS n_left,
    (count(*) - count(*) FILTER (hadm_id % 31 = 0) + count(*) FILTER (hadm_id % 23 = 0 AND hadm_id % 31 <> 0))::BIGINT AS n_right, 0 AS lost_when_read
    FROM split WHERE cohort = 'SW' GROUP BY part, hadm_id >> 10 HAVING count(*) FILTER (hadm_id % 31 = 0 OR hadm_id % 23 = 0) > 0""")


@keeping_query
def matrix_gate(t):
    """What the gate says to a matrix with NULL scores, repeated ids, a column too many and one too few."""
    wide = pl.matrix(t)
    numeric = [f for f in ft.FEATURES if f not in ft.CATEGORICAL]
    filled = ft.fill_unknown(wide, list(ft.CATEGORICAL)).fillna(0, subset=numeric)
    faulty = filled.withColumn("charlson_score", F.when(F.col("hadm_id") % 7 != 0, F.col("charlson_score"))).withColumn("left_over", F.lit(1)).drop("gender")
    faulty = faulty.unionByName(faulty.filter("hadm_id % 5 = 0"))
    folder = _new_folder(t)
    problems = gate.write_checked(faulty, folder, pl.LABEL, ["cohort", ft.KEY], extra=("cohort",))
    try:
        gate.read_checked(t.spark, folder)
        refused = False
    except gate.Refused:
        refused = True
    rows = t.spark.createDataFrame([(p,) for p in problems], "problem STRING")
    return rows.withColumn("refused", F.lit(refused))


ORACLE["matrix_gate"] = oracle.sql("""SELECT problem, true AS refused FROM (SELECT 'missing: gender' AS problem UNION ALL SELECT 'unexpected: left_over'
    UNION ALL SELECT 'NULL in charlson_score: ' || (count(*) FILTER (hadm_id % 7 = 0) + count(*) FILTER (hadm_id % 35 = 0)) FROM matrix
    UNION ALL SELECT 'repeated ids: ' || count(*) FILTER (hadm_id % 5 = 0) FROM matrix)""")


# --- narrow forms ---------------------------------------------------------------------------------------------------


@keeping_query
def matrix_no_process(t):
    """The feature matrix as a run without process features sees it."""
    wide = pl.matrix(t)
    return wide.select("cohort", "hadm_id", pl.LABEL, *ft.condition_columns(wide.drop("cohort"), "No Process", pl.LABEL))


ORACLE["matrix_no_process"] = oracle.sql(f"SELECT cohort, hadm_id, left_shift, {', '.join(mo.CONDITIONS['No Process'])} FROM matrix")


@query
def one_case_trace(t):
    """The events of some cases in order: those of one admission block of every fourth subject."""
    return ev.case_trace(pl.log(t), F.col("case_id") % 40 == 1).select("case_id", "pos", "activity", "event_time")


ORACLE["one_case_trace"] = oracle.sql("SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY event_time, tie) AS pos, activity, event_time FROM log WHERE case_id % 40 = 1")


@query
def fn_vs_tp_top(t):
    """The four largest differences between missed and found positives."""
    features = ["n_events", "mean_value", "max_value"]
    return an.largest_first(an.fn_vs_tp(pl.tagged(t), features, BY), 4)


ORACLE["fn_vs_tp_top"] = f"SELECT * FROM ({ORACLE['fn_vs_tp']}) ORDER BY abs(abs_diff) DESC, feature LIMIT 4"


@query
def union_layouts(t):
    """Results of two layouts put together: what one of them lacks is NULL."""
    rows = m.result_rows(*t.at)
    deep = rows.filter(F.col("Model").isin(*an.DEEP)).withColumn("Epochs", F.col("Seed") + 3).drop("AUPRC")
    both = an.union_results([rows.filter(~F.col("Model").isin(*an.DEEP)), deep])
    return both.groupBy("Model").agg(F.count(F.lit(1)).alias("n"), F.count("Epochs").alias("with_epochs"), F.count("AUPRC").alias("with_auprc"), F.coalesce(F.sum("Epochs"), F.lit(0)).alias("epochs"))


ORACLE["union_layouts"] = oracle.sql("""SELECT Model, count(*) AS n, count(*) FILTER (Model IN ('LSTM', 'CNN')) AS with_epochs, count(*) FILTER (Model NOT IN ('LSTM', 'CNN')) AS with_auprc,
    coalesce(sum(Seed + 3) FILTER (Model IN ('LSTM', 'CNN')), 0)::BIGINT AS epochs FROM results GROUP BY Model""")
