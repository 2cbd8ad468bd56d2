"""Whole texts reach the workers in small batches while near copies are sought; the session's setting is as before afterwards."""

from foliospark.llm import near_dup as N
from foliospark.session import text_batches

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    before, seen, write = spark.conf.get(NAME), {}, N.materialize

    def written(df, purpose):
        seen[purpose] = int(spark.conf.get(NAME))
        return write(df, purpose)

    monkeypatch.setattr(N, "materialize", written)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert all(seen[step] <= 1000 for step in ("sketches", "links", "family-rows", "bridges"))
    assert spark.conf.get(NAME) == before


def test_a_smaller_setting_stays(spark):
    spark.conf.set(NAME, "7")
    try:
        with text_batches(spark):
            assert spark.conf.get(NAME) == "7"
        assert spark.conf.get(NAME) == "7"
        spark.conf.set(NAME, "0")
        with text_batches(spark, 5):
            assert spark.conf.get(NAME) == "5"
        assert spark.conf.get(NAME) == "0"
    finally:
        spark.conf.unset(NAME)
