"""Each registered query against DuckDB, the tokenizer libraries, or a plain version written here."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
import harness
from conftest import SF
from foliospark.llm import packing, pii
from foliospark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows(df):
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert harness.difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_token_counts_as_the_library(spark, texts):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(QUERIES["op1_token_counts"](spark, SF))
    for (doc, text), coded in zip(texts.items(), library.encode_batch(list(texts.values()), add_special_tokens=False)):
        n = len(coded.ids)
        assert tuple(got[doc]) == (doc, len(text.encode()), n, n > 512)
    assert len(got) == len(texts)


def test_encoding_as_the_library(spark, texts):
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(QUERIES["op8_byte_bpe"](spark, SF))
    for doc, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert tuple(got[doc]) == (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_license_base_part(spark, texts):
    got = rows(QUERIES["op4_license_scan"](spark, SF))
    for doc, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        at = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
              for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in m.group() if d.isdigit() and d.isascii()]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), m.end()))
    return sorted(out)


def test_pii_base_part(spark, texts):
    got = rows(QUERIES["op6_pii"](spark, SF))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 0
    for doc, text in texts.items():
        spans, r = plain_spans(text), got[doc]
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        all_spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(all_spans) and (listed or not all_spans)


def plain_best_fit(items, capacity):
    """Items ``(size, source, cluster)``; all bins are looked at for each."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - b["used"] - size, i) for i, b in enumerate(bins) if b["used"] + size <= capacity
                and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "s": set(), "c": set()})
        out.append((i, bins[i]["used"]))
        bins[i]["used"] += size
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_best_fit_is_the_tightest_bin():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(0, 120))
        items = [(int(rng.integers(0, 50)), None if rng.random() < 0.1 else f"s{rng.integers(0, 9)}", None if rng.random() < 0.3 else int(rng.integers(0, 20))) for _ in range(n)]
        assert packing.best_fit(*[list(c) for c in zip(*items)] or [[], [], []], 50) == plain_best_fit(items, 50)


def test_packing_places_everything(spark, con):
    size = dict(con.execute("SELECT doc_id, octet_length(encode(coalesce(text, ''))) FROM documents").fetchall())
    source = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    bins, seen = {}, {}
    for r in QUERIES["op7_best_fit_packing"](spark, SF).collect():
        bins.setdefault(r.bin_id, []).append(r)
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
    assert seen.keys() == size.keys()
    for doc, pieces in seen.items():
        at = 0
        for i, (piece, start, n) in enumerate(sorted(pieces)):
            assert (piece, start) == (i, at)
            at += n
        assert at == size[doc]
    for held in bins.values():
        held.sort(key=lambda r: (r.bin_offset, r.size))
        assert sum(r.size for r in held) <= 8192 and len({source[r.doc_id] for r in held}) == len(held)
        assert all(a.bin_offset + a.size == b.bin_offset for a, b in zip(held, held[1:]))


def test_language_of_held_out_rows(spark, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in QUERIES["op9_language_id"](spark, SF).collect()]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_recall_of_nearest(spark, con):
    data = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, v = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    got = {}
    for r in QUERIES["op10_nearest"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 20 == 0)
    assert got.keys() == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        score = v @ v[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:20]
        found = got[ids[q]]
        assert [r.rank for r in found] == list(range(1, len(order) + 1))
        place = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(r.score - score[place[r.vec_id]]) < 1e-12 for r in found)
        hits += len({r.vec_id for r in found} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def test_pipeline_keeps_clean_documents(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in after.values()), name
        if name == "language_id":
            assert after.keys() == {d for d, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
        elif name != "minhash_near_dedup":
            assert after.keys() == before.keys(), name
        if name == "pii":
            assert not any(plain_spans(r.text) for r in after.values())
            assert all(after[d].text == before[d].text for d in before if not plain_spans(before[d].text))
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before.keys()


def test_near_dedup_stage_against_all_pairs(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for d, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        words = (text or "").encode().lower().split()
        sets[d] = {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {d for d in ids if find(d) == d}
