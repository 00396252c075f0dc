"""Readers and writers: typed CSV, gzip folders, Parquet, many-file result scans, stores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
FILE = "__file"


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(),
    "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def schema_of(columns: str) -> T.StructType:
    """'name TYPE, name TYPE' as a schema; needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The source tables by name; only the columns the operators read.
SCHEMAS = {
    "admissions": schema_of(
        "hadm_id BIGINT, subject_id BIGINT, admittime TIMESTAMP_NTZ, dischtime TIMESTAMP_NTZ, admission_type STRING, "
        "admission_location STRING, insurance STRING, race STRING, marital_status STRING"
    ),
    "patients": schema_of("subject_id BIGINT, anchor_age INT, gender STRING"),
    "transfers": schema_of(
        "hadm_id BIGINT, subject_id BIGINT, event_id BIGINT, careunit STRING, eventtype STRING, "
        "intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ"
    ),
    "labevents": schema_of("hadm_id BIGINT, flag STRING"),
    "diagnoses_icd": schema_of("hadm_id BIGINT, seq_num INT, icd_version INT, icd_code STRING"),
    "prescriptions": schema_of("hadm_id BIGINT, drug STRING"),
    "omr": schema_of(
        "subject_id BIGINT, event_id BIGINT, chartdate DATE, result_name STRING, result_value STRING"
    ),
    "icustays": schema_of("hadm_id BIGINT, stay_id BIGINT, intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ"),
    "event_log": schema_of("case_id BIGINT, event_time TIMESTAMP_NTZ, activity STRING, tie BIGINT"),
    "charlson_map": schema_of("condition STRING, weight INT, icd_version INT, icd_code STRING"),
    "chronic_codes": schema_of("icd_version INT, icd_code STRING"),
}


def file_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files behind paths and patterns, in order of name; their contents are not read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    return sorted(r["path"] for r in found)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, columns: list[str] | None = None, allow_missing: bool = False
) -> DataFrame:
    """CSV with header rows, explicit types and optional column pruning.

    Columns are found by each file's own header, so neither their order nor further columns matter;
    files of one header are read together.  A column a header lacks is an error, or NULL where
    ``allow_missing``.  ``.csv.gz`` files are read as they are; one gzip file is one task, see
    ``read_gzip_folder``.
    """
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    reader = spark.read.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).option("enforceSchema", False)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for name in file_names(spark, path):
        layouts.setdefault(tuple(header_columns(spark, name)), []).append(name)
    parts = []
    for header, names in layouts.items():
        missing = [c for c in schema.names if c not in header]
        if missing and header and not allow_missing:
            raise ValueError(f"{names[0]} lacks {', '.join(missing)}")
        in_file_order = [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header]
        table = reader.schema(T.StructType(in_file_order)).csv(names).withColumn(FILE, F.col("_metadata.file_path"))
        parts.append(table.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in missing}).select(*schema.names, FILE))
    if not parts:
        return spark.createDataFrame([], schema).withColumn(FILE, F.lit(None).cast("string")) if allow_missing else spark.createDataFrame([], schema)
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows if allow_missing else rows.drop(FILE)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, read from its first line only."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


@dataclass(frozen=True)
class Checked:
    """``good``: typed rows with their times parsed; ``rejects``: (source_file, reason, line) of every other row."""

    good: DataFrame
    rejects: DataFrame


_BROKEN = "__broken"


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: T.StructType, times: tuple[str, ...], formats: tuple[str, ...] = (TIMESTAMP_FORMAT,)) -> Checked:
    """CSV with text times, split into rows that can be used and rows that cannot, with the reason.

    Rows the reader cannot bring into ``schema`` (a wrong number of fields, a word for a number) are ``malformed``; then a time that is not
    there is ``missing <column>``, and one that fits none of ``formats`` ``bad <column>``.  The first reason counts.  The
    columns in ``times`` are TIMESTAMP_NTZ in the result.  All files have the columns of ``schema`` in its order, under a header.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema] + [T.StructField(_BROKEN, T.StringType())])
    rows = spark.read.schema(as_text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).csv(path)
    rows = rows.withColumn(FILE, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    # Formats are tried in turn; the strict parser returns NULL instead of guessing.
    parsed = {c: F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats]).cast("timestamp_ntz") for c in times}
    line = F.coalesce(F.col(_BROKEN), F.concat_ws(",", *[F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in schema]))
    # The reader only notices what is wrong in the columns it is asked for: the length asks for all of them.
    reason = F.when(F.col(_BROKEN).isNotNull() | (F.length(line) < 0), "malformed")
    for c in times:
        reason = reason.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing {c}").when(parsed[c].isNull(), f"bad {c}")
    told = rows.withColumn("reason", reason)
    good = told.filter("reason IS NULL").withColumns(parsed).select(*schema.names)
    return Checked(good, told.filter("reason IS NOT NULL").select(F.col(FILE).alias("source_file"), "reason", line.alias("line")))


def read_gzip_folder(spark: SparkSession, folder: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """All ``*.csv.gz`` files of a folder.  gzip cannot be split, so the rows are spread afterwards."""
    rows = read_csv(spark, f"{folder}/*.csv.gz", schema)
    return rows.repartition(partitions) if partitions else rows.repartition()


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if columns is None else table.select(*columns)


def read_database(spark: SparkSession, table: str, url: str | None = None, split_on: str | None = None, bounds: tuple[int, int] = (0, 0), slices: int = 1) -> DataFrame:
    """A catalog table, or a table of a live database read in ``slices`` parallel ranges of ``split_on``."""
    if url is None:
        return spark.table(table)
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on is not None:
        reader = (
            reader.option("partitionColumn", split_on)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", slices)
        )
    return reader.load()


def read_result_files(spark: SparkSession, pattern: str, schema: T.StructType, variants: tuple[str, ...], default_seed: int = 42) -> DataFrame:
    """Results in files (or written folders) ``<model>_results_<variant>[_s<seed>].csv``, each read by its own header.

    Facts missing in the rows come from the name.  Files whose name does not follow the pattern
    contribute no rows.
    """
    name = rf"([^/]*?)_results_({'|'.join(variants)})(?:_s(\d+))?\.csv(?:/part-[^/]*)?$"
    rows = read_csv(spark, pattern, schema, allow_missing=True).filter(F.col(FILE).rlike(name))
    facts = {
        "Model": F.regexp_extract(FILE, name, 1),
        "Variant": F.regexp_extract(FILE, name, 2),
        "Seed": F.coalesce(F.nullif(F.regexp_extract(FILE, name, 3), F.lit("")).cast("int"), F.lit(default_seed)),
    }
    for column, fact in facts.items():
        rows = rows.withColumn(column, F.coalesce(F.col(column), fact) if column in rows.columns else fact)
    return rows.withColumn("source_file", F.regexp_extract(FILE, r"([^/]+\.csv)(?:/part-[^/]*)?$", 1)).drop(FILE)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part per partition, each with a header."""
    df.write.mode("errorifexists").option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Padded sequences stay keyed by case id; no separate order file is needed."""
    write_parquet(sequences.select("hadm_id", "seq"), path)


def write_vocabulary(spark: SparkSession, vocabulary: dict[str, int], path: str) -> None:
    rows = spark.createDataFrame(list(vocabulary.items()), "activity STRING, activity_id INT")
    rows.coalesce(1).write.mode("errorifexists").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("activity STRING, activity_id INT").json(path)
