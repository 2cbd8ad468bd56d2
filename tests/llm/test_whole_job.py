"""Inputs on which an operator once did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import pii, vafile


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 16))
    whole = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(int).tolist()
    whole[7] = [v * 2 for v in whole[20]]  # the best candidate of query 20 stands 25 times
    table = [(i, v) for i, v in enumerate(whole)]
    repeated = spark.createDataFrame(table * 2 + [(7, whole[7])] * 23, "vec_id bigint, vec array<bigint>")
    want = []
    for q in range(0, 90, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in table if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    got = vafile.top_k(repeated, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_terms_far_from_the_span_and_all_their_places(spark):
    far = " ".join(["common"] * 300)
    rows = [(i, f"Zanzibar heading {far} write{'abcde'[i]} to bob@x.org today {far}\n(zanzibar)") for i in range(5)]
    rows += [(10 + i, f"common words here and there, {far} heading write today") for i in range(40)]
    copies = [(100 + i, f"quetzal {far} mail ann@x.org and ann@x.org now") for i in range(6)]
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows + copies], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    texts = dict(rows + copies)
    got = {r["id"]: [texts[r["id"]][s["start"]:s["end"]] for s in r["terms"]] for r in pii.find_spans(table).collect()}
    assert all(got[i] == ["Zanzibar", "(zanzibar)"] for i in range(5)) and not any(got[i] for i in got if i >= 5)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "anzibar" not in "".join(clean[i] for i in range(5)) and clean[10] == rows[5][1] and "quetzal" in clean[100]
