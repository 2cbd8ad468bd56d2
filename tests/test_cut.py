"""Texts that are cut into tokens in the task: the same tokens as the patterns give, and no message moves in a replay."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import BLANK, INK, SPACE, normalize_text, tokenize
from foliospark.operators import features as X
from foliospark.operators import terms as K
from foliospark.operators.extraction import Ledger, build_requests

LETTERS = "aB1_ .,\n\tßéİΣ一漢𝒜😀٣²½‍  ́\x1c\x85" + chr(0x10FFFF)


@pytest.fixture
def texts(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice(LETTERS) for _ in range(draw.randrange(12)))) for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, ""), (402, "x"), (403, "x yy"), (404, "zz")], "id int, text string").repartition(3)


def test_a_task_cuts_the_tokens_that_the_pattern_finds(spark, texts):
    source, cut = K.cut_of(texts)

    def listed(batches):
        for part, row, tokens in cut(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), K.listed(row, tokens, part.num_rows)], ["id", "tokens"])

    got = {r["id"]: r["tokens"] for r in texts.select("id", source.alias("c")).mapInArrow(listed, "id int, tokens array<string>").collect()}
    assert got == {r["id"]: r["t"] or [] for r in texts.select("id", tokenize(F.col("text")).alias("t")).collect()}


def test_slices_of_texts_end_between_rows():
    texts = ["aa bb", None, "cc " * 9, "", "d", "é", "ee"]
    word = K.np.array([chr(i).isalnum() for i in range(0x110000)])
    batch = pa.record_batch([pa.array(texts)], ["text"])
    for most in (1, 5, 30, 1000):
        parts = list(K.text_slices(iter([batch.slice(0, 3), batch.slice(3)]), 0, word, most))
        assert [t for _, _, tokens in parts for t in tokens.to_pylist()] == ["aa", "bb", *["cc"] * 9, "ee"]
        assert sum(p.num_rows for p, _, _ in parts) == 7 and all(len(row) == len(tokens) for _, row, tokens in parts)


def test_sums_of_texts_are_those_of_their_tokens(spark, texts):
    def sums(df):
        return {tuple(r) for r in X.term_sums(df).groupBy("term", "n").agg(F.sum("docs"), F.sum("tf")).collect()}
    assert sums(texts.select("text")) == sums(X.with_tokens(texts.select("text")))


def test_white_space_classes_are_the_list(spark, texts):
    assert texts.filter(normalize_text(F.col("text")) != F.trim(F.regexp_replace("text", f"[{SPACE}]+", " "))).count() == 0
    c = F.col("c")
    each = spark.createDataFrame([(x,) for x in LETTERS + "~!\x7f　"], "c string")
    assert each.filter((c.rlike(f"^{BLANK}$") != c.rlike(f"^[{SPACE}]$")) | (c.rlike(f"^{INK}$") == c.rlike(f"^[{SPACE}]$"))).count() == 0


def test_a_replay_moves_keys_and_no_message(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    known = set(folder.glob("unpaid-requests-*"))
    docs = spark.createDataFrame([(str(i), "invoice", "net " * 30) for i in range(6)], "document_id string, doc_type string, text string")
    ledger, calls = Ledger(str(tmp_path / "ledger"), 1), lambda: lambda request: ("{}", 1, 1)
    ledger.run(build_requests(docs.filter("document_id < '4'"), "m"), calls, 1, None)

    def only_new():
        def client(request):
            assert "net" in request["user_message"] and request["document_id"] >= "4"
            return "{}", 1, 1
        return client

    done = ledger.run(build_requests(docs, "m"), only_new, 1, None)
    assert done.filter("ok").count() == 6
    written = [pq.read_schema(file).names for new in set(folder.glob("unpaid-requests-*")) - known for file in new.glob("*.parquet")]
    assert written and all(names == ["document_id", "part"] for names in written)
