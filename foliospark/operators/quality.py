"""Corpus quality measures over ``(id, label, text)`` and over extracted records."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.dates import parse_date
from foliospark.functions.numbers import exact_sum
from foliospark.functions.ordering import first_ranks, global_rank, hash_rank, running_sums, seeded_order
from foliospark.functions.rows import explode_rows
from foliospark.session import materialize

# Thresholds of the quality checks.
NEAR_DUPLICATE = 0.85
SAMPLE_PAIRS = 200
NON_PRINTABLE_SHARE = 0.05
#: Ranks of one block of a curve's running sum.
CURVE_BLOCK = 65_536
CASH_LIKE = ["Cash", "Apple Pay", "Google Pay"]


def first_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` samples of every class, by the same plan for any ``n``.

    Only keys are ranked, in buckets between quantiles of their class; the texts are then picked by a semi join.
    """
    return df.join(first_ranks(df.select("label", order), ["label"], order, n), ["label", order], "left_semi")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Total and distinct texts, compared by digest."""
    copies = df.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_texts"),
                      F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("texts_with_copies"))


def near_duplicate_rate(df: DataFrame, pairs: int = SAMPLE_PAIRS, threshold: float = NEAR_DUPLICATE,
                        seed: int = 42) -> DataFrame:
    """Share of seeded same-class pairs whose token sets overlap by more than ``threshold``.

    A class's samples are put in a seeded order. Pair k takes position 2k and, counted on from it, a later one:
    the neighbour in the first round through the class, one further each round. No sample meets itself, and only
    the sampled texts are read and tokenised. A pair with an empty token set is skipped.
    """
    keyed = df.select("label", "id").withColumn("_order", seeded_order(F.col("id"), seed))
    ranked = hash_rank(keyed, ["label"], "_order", ["id"], "_rank", at_most=F.lit(2 * pairs))
    m = F.least(F.col("_n"), F.lit(2 * pairs))
    sizes = ranked.groupBy("label").agg(F.first("_n").alias("_n")).filter("_n > 1")
    drawn = (sizes.select("label", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("pair"))
             .withColumn("a", (2 * F.col("pair")) % F.col("m"))
             .withColumn("b", (F.col("a") + 1 + F.floor(2 * F.col("pair") / F.col("m")) % (F.col("m") - 1)) % F.col("m")))
    members = drawn.select("label", "pair", F.explode(F.array("a", "b")).alias("_pos"))
    chosen = members.join(ranked.select("label", (F.col("_rank") - 1).alias("_pos"), "id"), ["label", "_pos"])
    sets = (df.join(chosen.select("id").distinct(), "id", "left_semi")
            .select("id", T.token_set(F.col("text")).alias("tokens")))
    both = (chosen.join(sets, "id").groupBy("label", "pair")
            .agg(F.min_by("tokens", "_pos").alias("s"), F.max_by("tokens", "_pos").alias("t")))
    scored = both.select("label", T.jaccard(F.col("s"), F.col("t")).alias("j"))
    return scored.groupBy("label").agg(
        F.count("j").alias("pairs_checked"), F.count_if(F.col("j") > threshold).alias("near_duplicates"),
        (F.count_if(F.col("j") > threshold) * 100.0 / F.greatest(F.count("j"), F.lit(1))).alias("percent"))


def _class_tokens(df: DataFrame) -> DataFrame:
    return explode_rows(df, T.token_set(F.col("text")), "token", "label")


def vocabulary_size(df: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct tokens per class, over all samples or the first ``n``."""
    tokens = _class_tokens(first_n(df, n) if n else df).distinct()
    return tokens.groupBy("label").agg(F.count(F.lit(1)).alias("vocabulary"))


def vocabulary_growth(df: DataFrame, small: int = 100, large: int = 500) -> DataFrame:
    """How much the vocabulary of a class grows from its first ``small`` to its first ``large`` samples."""
    few = first_n(df, small).select("id", F.lit(True).alias("early"))
    sample = first_n(df, large).join(F.broadcast(few), "id", "left")
    tokens = (explode_rows(sample, T.token_set(F.col("text")), "token", "label",
                           F.coalesce("early", F.lit(False)).alias("early"))
              .groupBy("label", "token").agg(F.bool_or("early").alias("early")))
    counts = tokens.groupBy("label").agg(F.count_if("early").alias("small_vocabulary"),
                                         F.count(F.lit(1)).alias("large_vocabulary"))
    return counts.withColumn("growth", F.col("large_vocabulary") / F.greatest("small_vocabulary", F.lit(1)))


def vocabulary_curve(df: DataFrame) -> DataFrame:
    """The vocabulary of the first 1, 2, ... samples of each class by ``id``, up to the whole class: ``(label, size, vocabulary)``.

    A token counts from the first sample that has it, so the curve is a running sum of first occurrences: samples are ranked by key alone,
    each token keeps its lowest rank, and ranks are summed up in blocks. Samples of one id share a rank's place in any order.
    """
    keys = materialize(global_rank(df.select("label", "id"), ["label"], "id"), "sample-ranks")
    tokens = explode_rows(df, T.token_set(F.col("text")), "token", "label", "id")
    # The rank of a sample is the same for all its tokens, so the lowest id decides before any join.
    first = tokens.groupBy("label", "token").agg(F.min("id").alias("id"))
    fresh = first.groupBy("label", "id").agg(F.count(F.lit(1)).alias("fresh"))
    points = keys.join(fresh, ["label", "id"], "left").select("label", F.col("rank").alias("size"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    points = points.withColumn("block", F.floor(F.col("size") / CURVE_BLOCK))
    return running_sums(points, ["label"], "block", [F.col("size")], {"fresh": "vocabulary"}).select("label", "size", "vocabulary")


def class_overlap(df: DataFrame, classes: list[str], n: int | None = None) -> DataFrame:
    """Similarity of class vocabularies: one flag per class and token, then counts; no self join."""
    flags = [F.bool_or(F.col("label") == c).alias(f"_{i}") for i, c in enumerate(classes)]
    tokens = _class_tokens(first_n(df, n) if n else df).groupBy("token").agg(*flags)
    pairs = list(combinations(range(len(classes)), 2))
    counts = tokens.agg(*[e for i, j in pairs for e in (
        F.count_if(F.col(f"_{i}") & F.col(f"_{j}")).alias(f"both_{i}_{j}"),
        F.count_if(F.col(f"_{i}") | F.col(f"_{j}")).alias(f"any_{i}_{j}"))])
    rows = [F.struct(F.lit(classes[i]).alias("class_a"), F.lit(classes[j]).alias("class_b"),
                     F.col(f"both_{i}_{j}").alias("common"), F.col(f"any_{i}_{j}").alias("combined")) for i, j in pairs]
    return (counts.select(F.inline(F.array(*rows)))
            .withColumn("jaccard", F.col("common") / F.greatest("combined", F.lit(1))))


def date_order_violations(df: DataFrame, issued: str = "invoice_date", due: str = "due_date") -> DataFrame:
    """Records checked and records whose due date comes first; texts that are no dates do not count as either."""
    a, b = parse_date(F.col(issued)), parse_date(F.col(due))
    return (df.select(a.alias("issued"), b.alias("due"))
            .agg(F.count_if(F.col("issued").isNotNull() & F.col("due").isNotNull()).alias("checked"),
                 F.count_if(F.col("due") < F.col("issued")).alias("violations")))


def length_dispersion(df: DataFrame) -> DataFrame:
    """Population deviation of the word count over its mean, per class.

    Counts and sums of squares are exact integers, so the result does not depend on the order of addition.
    """
    w = T.word_count(F.col("text"))
    sums = df.select("label", w.alias("w")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"),
        F.sum((F.col("w") * F.col("w")).cast("decimal(38,0)")).alias("q"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q").cast("double") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.select("label", "n", mean.alias("mean_words"),
                       (F.sqrt(variance) / F.greatest(mean, F.lit(1.0))).alias("dispersion"))


def short_documents(df: DataFrame, min_words: int = 10) -> DataFrame:
    return df.groupBy("label").agg(F.count_if(T.is_short(F.col("text"), min_words)).alias("short"),
                                   F.count(F.lit(1)).alias("n"))


def last_amounts(df: DataFrame) -> DataFrame:
    """Per document: number of dollar amounts and the last one as a number, usually the total."""
    found = df.select("id", T.dollar_amounts(F.col("text")).alias("amounts"))
    return found.select("id", F.size("amounts").cast("bigint").alias("n_amounts"),
                        T.amount_value(F.try_element_at("amounts", F.lit(-1))).alias("last_amount"))


def amount_spread(df: DataFrame) -> DataFrame:
    amounts = last_amounts(df).filter(F.col("last_amount").isNotNull())
    low, high = F.min("last_amount"), F.max("last_amount")
    return amounts.agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"),
                       (high / F.greatest(low, F.lit(0.01))).alias("spread"))


def garbled_text(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(T.is_garbled(F.col("text"))).alias("garbled"), F.count(F.lit(1)).alias("n"))


def non_printable(df: DataFrame, share: float = NON_PRINTABLE_SHARE) -> DataFrame:
    """Documents with more than ``share`` of their characters outside printable ASCII, per class."""
    bad = T.non_printable_count(F.col("text")) > F.length("text") * share
    return df.groupBy("label").agg(F.count_if(bad).alias("flagged"), F.count(F.lit(1)).alias("n"))


def totals_add_up(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Records whose line amounts do not add up to the subtotal within a cent; without lines the sum is 0.

    A sum out of range is NULL, and the record is among them whatever its subtotal says.
    """
    sums = lines.groupBy("document_id").agg(exact_sum(F.col("amount")).alias("line_sum"), F.count("amount").alias("_amounts"))
    line_sum = F.when(F.coalesce("_amounts", F.lit(0)) == 0, 0.0).otherwise(F.col("line_sum"))
    return (headers.join(sums, "document_id", "left")
            .select("document_id", "subtotal", line_sum.alias("line_sum"))
            .filter(F.col("line_sum").isNull() | ~(F.abs(F.col("line_sum") - F.col("subtotal")) < 0.01)))


def required_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many records miss each field, and how many miss any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(columns)],
                    F.count_if(_any_null(columns)).alias("n_any"))
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("missing")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*rows, F.struct(F.lit("any").alias("field"), F.col("n_any").alias("missing")))))


def _any_null(columns: list[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).isNull()
    return hit


def term_hits(df: DataFrame, terms: list[str] | None = None) -> DataFrame:
    return df.select("id", T.term_hits(F.col("text"), terms).alias("hits"))


def thousands_commas(df: DataFrame) -> DataFrame:
    """Documents with amounts of 1,000 or more, and whether any of those is written with a comma."""
    big = F.filter(T.dollar_amounts(F.col("text")), lambda a: T.amount_value(a) >= 1000)
    return (df.select("id", big.alias("big")).filter(F.size("big") > 0)
            .select("id", F.size("big").cast("bigint").alias("big_amounts"),
                    F.exists("big", lambda a: a.contains(",")).alias("has_comma")))


def category_variety(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("variety"))


def payment_consistency(df: DataFrame) -> DataFrame:
    """Receipts whose payment fields contradict the method: a card needs a four-digit suffix, cash needs change."""
    method = F.col("payment_method")
    card_bad = ~method.isin(CASH_LIKE) & (F.coalesce(F.length("card_last_four"), F.lit(0)) != 4)
    cash_bad = (method == "Cash") & ~(F.coalesce(F.col("change_due"), F.lit(0.0)) > 0)
    return (df.withColumn("problem", F.when(card_bad, "card without four digits").when(cash_bad, "cash without change"))
            .filter(F.col("problem").isNotNull()))


def _filled(field: str):
    return lambda x: F.size(x[field]) >= 1


def _above_zero(field: str):
    return lambda x: F.coalesce(x[field] > 0, F.lit(False))


def nested_structure(df: DataFrame, minimum: dict[str, int], inner: dict[str, str] | None = None,
                     positive: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``well_formed``: arrays have their least size, inner arrays are not empty, listed item numbers are positive.

    ``minimum`` maps an array column to its least size; ``inner`` maps an array column to the array field that each
    of its elements must fill; ``positive`` maps an array column to number fields that must be above 0 in every item.
    """
    ok = F.lit(True)
    for column, size in minimum.items():
        ok = ok & (F.coalesce(F.size(column), F.lit(0)) >= size)
    for column, field in (inner or {}).items():
        ok = ok & F.coalesce(F.forall(column, _filled(field)), F.lit(True))
    for column, fields in (positive or {}).items():
        for field in fields:
            ok = ok & F.coalesce(F.forall(column, _above_zero(field)), F.lit(True))
    return df.withColumn("well_formed", ok)
