import gzip

from caseflow.sources import tables as tb
from tests.conftest import at, rows


def test_typed_csv_and_pruning(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("careunit,hadm_id,intime,outtime,eventtype,extra\nMed,1,2024-01-01 00:00:00,,admit,x\n,2,2024-01-01 02:00:00,2024-01-01 03:00:00,ED,y\n")
    schema = tb.SCHEMAS["transfers"]
    df = tb.read_csv(spark, str(path), schema, ["hadm_id", "careunit", "intime", "outtime"])
    assert rows(df, "hadm_id", "careunit", "intime", "outtime") == [(1, "Med", at(0), None), (2, None, at(2), at(3))]
    assert tb.header_columns(spark, str(path)) == ["careunit", "hadm_id", "intime", "outtime", "eventtype", "extra"]


def test_gzip_folder(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"part{i}.csv.gz", "wt") as f:
            f.write(f"hadm_id,drug\n{i},a\n{i},b\n")
    df = tb.read_gzip_folder(spark, str(tmp_path), tb.SCHEMAS["prescriptions"], 2)
    assert df.count() == 6 and df.rdd.getNumPartitions() == 2


def test_csv_and_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "flag, with comma"), (2, None)], "hadm_id BIGINT, flag STRING")
    tb.write_csv(df, str(tmp_path / "c"))
    assert rows(tb.read_csv(spark, str(tmp_path / "c"), tb.SCHEMAS["labevents"]), "hadm_id") == [(1,), (2,)]
    tb.write_parquet(df.withColumn("cohort", df.hadm_id % 2), str(tmp_path / "p"), ["cohort"])
    assert tb.read_parquet(spark, str(tmp_path / "p"), ["hadm_id"]).count() == 2
    df.createOrReplaceTempView("some_labs")
    assert tb.read_database(spark, "some_labs").count() == 2


def test_sequence_and_vocabulary_stores(spark, tmp_path):
    seq = spark.createDataFrame([(7, [0, 0, 3])], "hadm_id BIGINT, seq ARRAY<INT>")
    tb.write_sequences(seq, str(tmp_path / "s"))
    assert tb.read_parquet(spark, str(tmp_path / "s")).collect() == seq.collect()
    tb.write_vocabulary(spark, {"A": 1, "B": 2}, str(tmp_path / "v"))
    assert rows(tb.read_vocabulary(spark, str(tmp_path / "v"))) == [("A", 1), ("B", 2)]


def test_result_files(spark, tmp_path):
    head = "Cohort,AUROC\nICU,0.8\n"
    for name in ("lstm_results_lat_s3.csv", "mlp_results_corrpacu.csv", "lstm_notes.csv", "cnn_results_other.csv"):
        (tmp_path / name).write_text(head)
    schema = tb.schema_of("Cohort STRING, AUROC DOUBLE")
    df = tb.read_result_files(spark, f"{tmp_path}/*.csv", schema, ("old", "corr", "corrpacu", "lat"))
    assert rows(df, "Model", "Variant", "Seed", "AUROC") == [("lstm", "lat", 3, 0.8), ("mlp", "corrpacu", 42, 0.8)]
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "ml_results_lat_s1.csv").write_text("Model,Seed,AUROC\nGB,7,0.9\nRF,,0.7\n")
    df = tb.read_result_files(spark, f"{tmp_path}/own/*.csv", tb.schema_of("Model STRING, Seed INT, AUROC DOUBLE"), ("lat",))
    assert rows(df, "Model", "Seed") == [("GB", 7), ("RF", 1)]


def test_result_files_of_two_layouts(spark, tmp_path):
    (tmp_path / "ml_results_lat_s1.csv").write_text("Model,AUROC,F1,Train_Time_s,split_id\nGB,0.9,0.5,14.2,x\n")
    (tmp_path / "rnn_results_lat_s1.csv").write_text("Model,F1,Epochs,AUROC,Train_Time_s,split_id\nRNN,0.4,17,0.8,24.6,x\n")
    schema = tb.schema_of("Model STRING, AUROC DOUBLE, F1 DOUBLE, Epochs INT, Train_Time_s DOUBLE, split_id STRING")
    df = tb.read_result_files(spark, f"{tmp_path}/*.csv", schema, ("lat",))
    assert rows(df, "Model", "AUROC", "F1", "Train_Time_s") == [("GB", 0.9, 0.5, 14.2), ("RNN", 0.8, 0.4, 24.6)]
    assert sorted(r["Epochs"] or 0 for r in df.collect()) == [0, 17]


def test_files_in_another_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hadm_id,drug\n1,x\n")
    (tmp_path / "b.csv").write_text("drug,extra,hadm_id\ny,z,2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert rows(tb.read_csv(spark, paths, tb.SCHEMAS["prescriptions"]), "hadm_id", "drug") == [(1, "x"), (2, "y")]


def test_collecting_refuses_mixed_partitions(spark):
    import pytest

    from caseflow.operators import analysis as an

    schema = "Model STRING, Cohort STRING, Condition STRING, Variant STRING, Seed INT, AUROC DOUBLE, AUPRC DOUBLE, F1 DOUBLE, split_id STRING"
    one = spark.createDataFrame([("GB", "SW", "x", "lat", 1, 0.9, 0.5, 0.4, "p")], schema)
    assert an.collect_results([one, one.drop("F1")]).first()["AUROC_count"] == 2
    with pytest.raises(ValueError):
        an.collect_results([one, one.withColumn("split_id", one.Model)])


def test_rejected_rows(spark, tmp_path):
    """Every line ends up in one of the two tables, with its first reason and its file."""
    (tmp_path / "a.csv").write_text("id,at,n\n1,2024-01-01 10:00:00,5\nx,2024-01-01 10:00:00,5\n2,,5\n3,tomorrow,5\n4,2024-13-01 10:00:00,5\n")
    (tmp_path / "b.csv").write_text("id,at,n\n5,01.02.2024 11:30,6\n6,2024-01-01 10:00:00\n7,2024-01-01 10:00:00,5,9\n8, ,many\n")
    schema = tb.schema_of("id BIGINT, at TIMESTAMP_NTZ, n INT")
    read = tb.read_csv_checked(spark, str(tmp_path / "*.csv"), schema, ("at",), (tb.TIMESTAMP_FORMAT, "dd.MM.yyyy HH:mm"))
    assert sorted((r["id"], str(r["at"]), r["n"]) for r in read.good.collect()) == [(1, "2024-01-01 10:00:00", 5), (5, "2024-02-01 11:30:00", 6)]
    want = [("a.csv", "bad at"), ("a.csv", "bad at"), ("a.csv", "malformed"), ("a.csv", "missing at"), ("b.csv", "malformed"), ("b.csv", "malformed"), ("b.csv", "malformed")]
    assert sorted((r["source_file"], r["reason"]) for r in read.rejects.collect()) == want
    assert {r["reason"]: r["count"] for r in read.rejects.groupBy("reason").count().collect()} == {"bad at": 2, "malformed": 4, "missing at": 1}
    assert "x,2024-01-01 10:00:00,5" in {r["line"] for r in read.rejects.collect()}
