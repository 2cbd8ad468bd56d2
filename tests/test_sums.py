"""Sums that do not fit are findings, not zeros; the whole vocabulary curve."""

from pyspark.sql import functions as F

from foliospark.operators import derivations as D
from foliospark.operators import quality as Q

LINES = [("huge", 1e30), ("fits", 1.25), ("fits", 2.5), ("huge-negative", -1e30), ("huge-negative", 1.0), ("unset", None)]


def test_sums_out_of_range(spark):
    lines = spark.createDataFrame(LINES, "document_id string, amount double")
    heads = spark.createDataFrame([(k, 0.1, 0.0, 0.0, 0.0) for k in ("huge", "fits", "huge-negative", "unset", "none")],
                                  "document_id string, tax_rate double, shipping double, discount_pct double, discount double")
    for totals in (D.invoice_totals(heads.drop("discount"), lines), D.receipt_totals(heads, lines)):
        got = {r["document_id"]: (r["subtotal"], r["total"]) for r in totals.collect()}
        assert got["huge"] == got["huge-negative"] == (None, None)
        assert got["fits"][0] == 3.75 and got["unset"] == got["none"] == (0.0, 0.0)
    stated = spark.createDataFrame([("huge", 0.0), ("fits", 3.75), ("huge-negative", None), ("unset", 0.0), ("none", 1.0)], "document_id string, subtotal double")
    assert {(r["document_id"], r["line_sum"]) for r in Q.totals_add_up(stated, lines).collect()} == {("huge", None), ("huge-negative", None), ("none", 0.0)}


def test_vocabulary_curve(spark):
    rows = [(i, "ab"[i % 2], f"word{chr(97 + i % 7)} same{i // 4}x long") for i in range(60)] + [(900, "a", None), (901, "c", "")]
    got = {}
    for r in Q.vocabulary_curve(spark.createDataFrame(rows, "id int, label string, text string").repartition(3)).collect():
        got.setdefault(r["label"], {})[r["size"]] = r["vocabulary"]
    for label in "abc":
        seen, want = set(), {}
        for n, (_, _, text) in enumerate(sorted(r for r in rows if r[1] == label), 1):
            seen |= {w for w in (text or "").split() if len(w) > 2}
            want[n] = len(seen)
        assert got[label] == want
    assert Q.vocabulary_curve(spark.createDataFrame(rows[:0], "id int, label string, text string")).count() == 0
