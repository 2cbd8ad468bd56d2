"""Counting words: by any white space, and no further than asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import extraction as X

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
TEXTS = [None, "", " ", "a", " a", "a ", " a b ", "​", "x" * 3000, *[f"{s}a{s}{s}b{s}c" for s in SPACES], SPACES, SPACES.join("abcdefghij"),
         " ".join("abcdefghi"), " ".join("abcdefghij"), "\n".join(["wort"] * 20_000), "a­b \U0001f600 \U0001f600"]


def test_words_are_what_stands_between_white_space(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want = {i: len("".join(" " if c in SPACES else c for c in t or "").split(" ")) - "".join(" " if c in SPACES else c for c in t or "").split(" ").count("")
            for i, t in enumerate(TEXTS)}
    limits = [0, 1, 2, 3, 9, 10, 11, T.SHORT_WORDS, T.SHORT_WORDS + 1]
    rows = df.select("id", T.word_count(F.col("text")).alias("n"), *[T.is_short(F.col("text"), m).alias(f"s{m}") for m in limits]).collect()
    assert {r["id"]: r["n"] for r in rows} == want
    assert all(r[f"s{m}"] == (want[r["id"]] < m) for r in rows for m in limits)


def test_a_short_text_is_told_without_listing_its_words(spark):
    plan = spark.createDataFrame([("a b",)], "text string").filter(T.is_short(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "RLIKE" in plan


def test_a_stripped_text_is_measured_without_stripping_it(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is not None], "id int, text string")
    limits = [-1, 0, 1, 2, 3, 4, 19, 20, 50, 3000, 3001]
    rows = df.select("id", "text", *[T.spans(F.col("text"), m).alias(f"s{m}") for m in limits], F.length(T.strip(F.col("text"))).alias("n")).collect()
    assert all(r[f"s{m}"] == (r["n"] >= m) for r in rows for m in limits)
    plan = df.select(X.extractable_error(F.col("text")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "RLIKE" in plan
