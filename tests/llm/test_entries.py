import importlib.util

import __spark_entry__ as entry
import pytest


def test_all_operators_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    assert p.run(spark, sf_dir).count() == counts[4]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_over_nulls_and_no_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, "plain words that nobody minds at all", "en", "a", 5), (2, None, None, None, None), (None, "plain words that nobody minds at all", None, "a", 5), (4, "", "en", None, 0), (1, "plain words that nobody minds at all", "en", "a", 5)]
    labels = "doc_id long, quality int, toxic int"
    for name, data in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{folder}/labels.parquet")
        found = p.run(spark, folder).collect()
        assert {r.doc_id for r in found} <= {1, 2, 4} and (len(found) > 0) == (name == "some")
