"""Maps the generic test tables (orders, events, ...) onto the source schemas of this package.

A case is one user in one 5-day block of ``events``; ``orders`` are the second, wider set of
admissions with diagnoses, laboratory rows and prescriptions.  Unit names are event types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseflow.functions.locations import (
    AREA_ICU, AREA_MEDICAL, AREA_STEPDOWN, AREA_SURGERY, Rung, Tiers,
)
from caseflow.operators.ordered import shifted

TIER_A = ("purchase",)
TIER_B = ("click",)
COHORTS = {"ICU": TIER_A, "SW": TIER_B}
TIERS = Tiers(critical=TIER_A, intermediate=("signup",), pacu=("view",))
AREAS = {AREA_ICU: TIER_A, AREA_SURGERY: TIER_B, AREA_STEPDOWN: ("signup", "view"), AREA_MEDICAL: ("error",)}
LADDER = (
    Rung(TIER_A, 3),
    Rung(("signup",), 1, alt_level=2, contestable=True),
    Rung(("view",), 1, alt_level=2, contestable=True, procedural=True),
    Rung(TIER_B, 0),
)
EMERGENCY_TYPES = ("1-URGENT", "2-HIGH")
INSURANCE_KEPT = ("AUTOMOBILE", "BUILDING", "MACHINERY")
ETHNICITY_PATTERNS = {
    "WHITE": ("nation_1", "nation_20"),
    "BLACK": ("nation_2",),
    "HISPANIC/LATINO": ("nation_3", "nation_4"),
    "ASIAN": ("nation_5",),
    "NATIVE": ("nation_6",),
    "MULTIPLE": ("nation_7",),
    "UNKNOWN": ("nation_8",),
}
# (version, prefix, condition, weight) and (version, code): small stand-ins for the full lookups.
CHARLSON_ROWS = (
    (9, "41", "mi", 1),
    (9, "410", "mi", 1),
    (9, "25", "dm", 1),
    (10, "E1", "dm", 1),
    (10, "C", "cancer", 2),
    (10, "C7", "mets", 3),
    (9, "V", "misc", 2),
)
CHRONIC_ROWS = ((9, "250"), (9, "420"), (9, "V01"), (10, "A01"), (10, "K05"), (10, "E03"))
MODELS = {"1-URGENT": "GB", "2-HIGH": "RF", "3-MEDIUM": "MLP", "4-NOT SPECIFIED": "LSTM", "5-LOW": "CNN"}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table.  Its schema is inferred once per process; each inference is a small Spark job."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def case_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The case of every event: where hot cases are counted."""
    return table(spark, folder, "events").select((F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 5)).alias("hadm_id"))


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 5)).alias("hadm_id"),
        F.col("user_id").alias("subject_id"),
        "event_id",
        F.col("event_type").alias("careunit"),
        F.col("ts").alias("intime"),
    )
    linked = shifted(
        events,
        ["hadm_id"],
        ["intime", "event_id"],
        {"outtime": (F.col("intime"), 1), "previous": (F.col("event_id"), -1)},
    )
    kind = (
        F.when(F.col("previous").isNull(), "admit").when(F.col("event_id") % 17 == 0, "discharge").otherwise("transfer")
    )
    return linked.withColumn("eventtype", kind).drop("previous")


def stays(moves: DataFrame) -> DataFrame:
    return moves.groupBy("hadm_id").agg(
        F.min("subject_id").alias("subject_id"),
        F.min("intime").alias("admittime"),
        F.max("intime").alias("dischtime"),
    )


def stays_of(spark: SparkSession, folder: str) -> DataFrame:
    """``stays`` straight from the events, without the neighbour lookup."""
    events = table(spark, folder, "events").select(
        (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 5)).alias("hadm_id"),
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("intime"),
    )
    return stays(events)


def icustays(moves: DataFrame) -> DataFrame:
    return moves.filter(F.col("careunit").isin(*TIER_A)).select(
        "hadm_id", F.col("event_id").alias("stay_id"), "intime", "outtime"
    )


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderdate").alias("admittime"),
            (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))).alias("dischtime"),
            F.col("o_orderpriority").alias("admission_type"),
            F.nullif("o_orderstatus", F.lit("P")).alias("admission_location"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("c_mktsegment")).alias("insurance"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("n_name")).alias("race"),
            F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("marital_status"),
        )
    )


def order_admissions(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of ``admissions`` that come from orders alone."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 10).cast("int"))).alias("dischtime"),
        F.col("o_orderpriority").alias("admission_type"),
        F.nullif("o_orderstatus", F.lit("P")).alias("admission_location"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        (18 + F.col("c_custkey") % 80).cast("int").alias("anchor_age"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def labevents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.when(F.col("l_returnflag") == "R", "abnormal").alias("flag")
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    two = F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")
    code = (
        F.when(F.col("l_linestatus") == "O", F.concat(F.char((65 + F.col("l_partkey") % 26).cast("int")), two))
        .when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("V"), two))
        .otherwise(F.lpad((F.col("l_partkey") * 7 % 1000).cast("string"), 3, "0"))
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        F.when(F.col("l_linestatus") == "O", 10).otherwise(9).alias("icd_version"),
        code.alias("icd_code"),
    )


def prescriptions(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("hadm_id"), F.col("p_name").alias("drug")
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"),
        "event_id",
        F.col("ts").cast("date").alias("chartdate"),
        F.when(F.col("event_type").isin("view", "click"), "BMI (kg/m2)").otherwise("Weight (Lbs)").alias("result_name"),
        F.when(F.col("event_id") % 11 == 0, "n/a")
        .otherwise((F.floor("value").cast("int") % 60).cast("string"))
        .alias("result_value"),
    )


def charlson_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHARLSON_ROWS), "icd_version INT, icd_code STRING, condition STRING, weight INT")


def chronic_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHRONIC_ROWS), "icd_version INT, icd_code STRING")


def order_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Order-based admissions of the cohort: orders with a returned line."""
    return table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("hadm_id"))


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows (model x cohort x condition x variant x seed) aggregated from orders."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    model = F.element_at(F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv]), F.col("o_orderpriority"))
    deep = model.isin("LSTM", "CNN")
    plain, process = F.when(deep, "Sequence Only").otherwise("No Process"), F.when(deep, "Sequence + Tabular").otherwise("With Process")
    rows = table(spark, folder, "orders").select(
        model.alias("Model"),
        F.when(F.col("o_orderstatus") == "O", "ICU").otherwise("SW").alias("Cohort"),
        F.when(F.col("o_custkey") % 2 == 0, plain).otherwise(process).alias("Condition"),
        F.when(F.year(date) % 2 == 0, "lat").otherwise("old").alias("Variant"),
        (key % 5).cast("int").alias("Seed"),
        "o_totalprice",
    )
    return rows.groupBy("Model", "Cohort", "Condition", "Variant", "Seed").agg(
        F.round(F.avg("o_totalprice") / 600000, 4).alias("AUROC"),
        F.round(F.max("o_totalprice") / 1000000, 4).alias("AUPRC"),
        F.round(F.min("o_totalprice") / 1000000, 4).alias("F1"),
        F.round(F.count(F.lit(1)) / 8, 3).alias("Train_Time_s"),
    )


def case_values(spark: SparkSession, folder: str) -> DataFrame:
    """Per case: a two-decimal score (so ties occur), numeric and categorical descriptors."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, folder, "events")
        .withColumn("hadm_id", F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 5))
        .groupBy("hadm_id")
        .agg(
            F.round(F.least(F.lit(1.0), F.avg("value") / 60), 2).alias("score"),
            F.count(F.lit(1)).alias("n_events"),
            F.avg("value").alias("mean_value"),
            F.max("value").alias("max_value"),
            F.min_by("event_type", at).alias("first_unit"),
            F.max_by("event_type", at).alias("last_unit"),
        )
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as (id, vec, label, part): a hash of the id deals rows to test (1 in 5) or train."""
    deal = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("int") % 5
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.when(deal == 0, "test").otherwise("train").alias("part"),
    )
