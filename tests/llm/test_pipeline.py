"""The pipeline on planted documents: what each stage must drop and keep."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    words = ["the", "of", "weather", "reading", "garden", "slow", "river", "and", "light", "stone", "over", "again"]
    prose = lambda n: " ".join(r.choices(words, k=n)).capitalize() + "."
    rows = [(i, prose(r.randrange(40, 90)), "en", f"src{i % 3}", 0) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "src0", 0) for i in range(20)]
    rows += [(300 + i, rows[30 + i][1] + " tail", "en", None, 0) for i in range(20)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in r.choices(words, k=30)), "en", "src1", 0) for i in range(60)]
    rows += [(500, None, None, None, None), (501, "", "en", "src9", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(not 400 <= i < 460), 0) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    good, distinct, dissimilar, mixed, packed = kept
    assert not good & set(range(400, 460)) and good >= set(range(150))
    assert not distinct & set(range(1, 20, 2)) and distinct >= set(range(200, 220)) and len(distinct & set(range(150))) >= 130
    assert not dissimilar & set(range(300, 320)) and dissimilar >= set(range(30, 50))
    assert mixed <= dissimilar and packed == mixed
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(packed)


def test_near_copies_from_four_fifths_on(spark):
    r = random.Random(4)
    rows, changes = [], {}
    for i in range(24):
        base = r.choices([f"w{k}" for k in range(5000)], k=304)  # 300 shingles
        changes[i] = (5, 6, 8)[i % 3]  # 275 / 325, 270 / 330 and 260 / 340 in common
        other = list(base)
        for k in range(changes[i]):
            other[20 + 30 * k] = f"new{i}x{k}"
        rows += [(i, " ".join(base), "en", "s", 0), (100 + i, " ".join(other), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id for x in corpus_pipeline.dissimilar_documents(spark, docs, "").collect()}
    assert left == set(range(24)) | {100 + i for i, n in changes.items() if n == 8}
