"""Disclosing terms against a plain count over the same texts; which words can be terms; what stands in for them."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import packing, pii

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("token,term", [
    ("O'Brien,", "o'brien"), ("(Jean-Luc)", "jean-luc"), ("Smith's", "smith"), ("Smith’s.", "smith"), ("Ann", "ann"), ("IBM", "ibm"), ("A320", "a320"), ("word", "word"),
    ("the", None), ("an", None), ("A", None), ("2024", None), ("12-34", None), ("a.b.cd", None), ("--", None), ("", None), ("b2", "b2"), ("Ærø", "ærø"), ("x_y_z_w", None), ("a--bcd", None)])
def test_words_that_can_be_terms(token, term):
    assert pii.term_of(token) == term


def test_general_forms():
    text = "Ann met IBM on A320 with (zanzibar) Smith's"
    terms = [(0, 3, False), (8, 11, False), (15, 19, False), (25, 35, False), (36, 43, True)]
    assert pii.redact(text, [], terms) == "[NAME] met [ACRONYM] on [CODE] with [TERM] "


def plain_terms(texts: dict[int, str], alpha: float, min_docs: int, window: int) -> dict:
    """Pairs counted text by text, then every place of a flagged term."""
    held, marks, docs_of = {}, defaultdict(set), defaultdict(set)
    for d, text in texts.items():
        spans = pii.base_spans(text)
        near = defaultdict(list)
        for span in spans:
            words = text[max(0, span[0] - 24 * window):span[0]].split()[-window:] + text[span[2]:span[2] + 24 * window].split()[:window]
            near[pii.entity_of(text, span)].append(" ".join(words).lower())
        held[d] = {e: "\n".join(w) for e, w in near.items()}
        for t in text.split():
            docs_of[pii.term_of(t)].add(d)
    n_entity, both = defaultdict(int), defaultdict(int)
    for d, text in texts.items():
        free = {t for t, _, _ in pii.places(text, pii.base_spans(text))}
        for e, mark in held[d].items():
            n_entity[e] += 1
            for t in free:
                both[e, t] += 1
                marks[e, t].add(mark)
    ratio = {}
    for (e, t), n in both.items():
        if n >= min_docs and len(marks[e, t]) > 1 and n_entity[e] < len(texts):
            r = 1 + math.log(min(1, n / len(docs_of[t]))) / math.log(len(texts) / n_entity[e])
            if r >= alpha - 1e-12:
                ratio[e, t] = r
    out = {}
    for d, text in texts.items():
        for t, a, b in pii.places(text, pii.base_spans(text)):
            found = [ratio[e, t] for e in held[d] if (e, t) in ratio]
            if found:
                out[d, a, b] = round(max(found), 9)
    return out


def test_same_terms_as_a_plain_count(spark):
    rng = random.Random(8)
    people = {f"p{i}@mail.org": [f"Name{'abcdefgh'[i]}", f"K{i}7", f"D'Arc-{'xyzuvwst'[i]}"] for i in range(8)}
    filler = ["report", "meeting", "The", "today", "IBM", "sent", "zone-4", "über", "東京都", "and"]
    texts = {}
    for d in range(160):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 40))]
        if d % 3 == 0:
            mail = rng.choice(list(people))
            words += [mail, *rng.sample(people[mail], 2), rng.choice([*people, "report"])]
            rng.shuffle(words)
        elif d % 31 == 0:
            words += [rng.choice(people["p1@mail.org"])]
        texts[d] = " ".join(words)
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts.items()], SCHEMA)
    got = {(r["id"], s["start"], s["end"]): round(s["ratio"], 9) for r in pii.find_spans(table).collect() for s in r["terms"]}
    want = plain_terms(texts, 0.8, 3, 8)
    assert got == want and len(want) > 40
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert any("[NAME]" in t for t in clean.values()) and all(clean[d] == t for d, t in texts.items() if "@" not in t)


def test_words_longer_than_the_reach_still_tell_surroundings_apart(spark):
    rows = [(i, f"{'字' * 300}{i} bob@x.org {i}{'漢' * 300} Zanzibar") for i in range(5)] + [(10 + i, "common words here") for i in range(20)]
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    assert all(("Zanzibar" in [rows[r["id"]][1][s["start"]:s["end"]] for s in r["terms"]]) == (r["id"] < 5) for r in pii.find_spans(table).collect() if r["id"] < 5)


def test_texts_without_content_share_a_bin(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "", "en", f"s{i}", 0) for i in range(8)] + [(20 + i, "same", "en", f"t{i}", 0) for i in range(3)], SCHEMA)
    packed = packing.pack(rows, F.octet_length("text"), 100, cluster=packing.copies(F.col("text")))
    bins = {r["doc_id"]: r["bin_id"] for r in packed.collect()}
    assert len({bins[20 + i] for i in range(3)}) == 3 and len({bins[i] for i in range(8)}) == 1
