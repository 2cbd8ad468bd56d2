"""Main text of pages, ranked search and spelling variants: plain versions, edge cases, and every path a size can choose."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from foliospark.llm import html_text, lexical, spelling
from foliospark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- pages ------------------------------------------------------------------------------------------------

def main_text(source):
    return html_text.article(html_text.read_page(source), [])


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("<!-- never closed <p>x", ""), ("a < b <", "a < b <"), ("<p>a<p>b <b>c<i>d</b>e</i><p>f", "a b cde f"),
    ("<title>t</title><style>p{}</style><script>var t='<p>no</p>'</script><p>yes<script>open", "yes"),
    ("<div>a<br>b&nbsp;&amp;amp; \t\n c &copy;&lt;&#65;&am</div>", "a b &amp; c ©<A&am"),
    ("<body><header><p>site</p></header><article><header><h1>Head</h1></header><p>Body</p><footer>by</footer></article><footer>f</footer>", "Head Body"),
    ("<main><form><p>mail</p></form><p>text <a href='/x'>link</a> end</p><aside>s</aside></main>", "text link end"),
    ("<div class='post'><p>long text of a post</p></div><div class='comments'><p>" + "first! " * 50 + "</p></div>", "long text of a post"),
    ("<div class='no-sidebar'><p>kept</p></div><div id=cookie-notice><p>we use</p></div>", "kept"),
    ("<div class='sidebar'><p>all there is</p></div>", "all there is"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
    ("<p title='a>b' data-x=\"<p>\">c</p><p hidden>d</p><p style='display: none'>e</p>", "c"),
    ("<head><meta charset=utf-8><p>no head end", "no head end"), ("<p>cut <div clas", "cut"),
    ("</div></p><p>stray ends</p></article>", "stray ends"),
])
def test_page_text(source, text):
    assert main_text(source) == text


def test_noise_never_fails():
    rng = np.random.default_rng(1)
    signs = ["<p>", "</p>", "<div class=\"a\">", "</div>", "<a href='x'>", "</a>", "<!--", "-->", "<", ">", "\"", "'", "=", "<li>", "<script>", "</script>", "&amp;", "&", "x ", "<td>", "<br/>", "<b", "</"]
    for _ in range(500):
        source = "".join(rng.choice(signs, rng.integers(0, 60)))
        page = html_text.read_page(source)
        assert html_text.article(page, []) == " ".join(html_text.article(page, []).split())
    deep = "<div>" * 3_000 + "<p>" + "word " * 20_000 + "</p>"
    assert len(main_text(deep)) == 5 * 20_000 - 1


def site():
    """A host whose articles are short and whose unnamed box is long on one page; and hosts of one page."""
    box, text = "<div class='box7'><p>{}</p></div>", "<div class='c1 text'><h1>T{0}</h1><p>Story {0} is told here in a few words.</p></div>"
    pages = [(i, f"https://Big.example.org/{i}", text.format(i) + box.format("box " * (200 if i == 3 else 2))) for i in range(6)]
    return pages + [(10, "http://user@other.example.org:80/x", "<p>alone</p>"), (11, None, "<p>no host</p>"), (12, "no url", None), (10, "http://user@other.example.org:80/x", "<p>alone</p>")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_hosts_agree(spark, broadcast_bytes, monkeypatch):
    real = html_text.with_paths  # the big host is hot, the others are not
    monkeypatch.setattr(html_text, "with_paths", lambda *a: real(*a, share=2, least=1))
    pages = spark.createDataFrame(site(), "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "host", "_host", "paths", "pages")})
    got = [tuple(r) for r in html_text.extract(pages, broadcast_bytes=broadcast_bytes).collect()]
    want = [(i, f"https://Big.example.org/{i}", f"T{i} Story {i} is told here in a few words.") for i in range(6)]
    want += [(10, "http://user@other.example.org:80/x", "alone")] * 2 + [(11, None, "no host"), (12, "no url", "")]
    assert sorted(got, key=lambda r: r[0]) == sorted([(*w, len(w[2])) for w in want], key=lambda r: r[0])


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    found = html_text.extract(empty)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == 0


# --- ranked search ----------------------------------------------------------------------------------------

def plain_ranking(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    counts = [(d, Counter(cut(t))) for d, t in docs if d is not None]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            scored += [(-score, d)] if score > 0 else []
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_items, block_terms", [(1024, 65_536), (2, 65_536), (100, 3)])
def test_ranking_as_plain(spark, block_items, block_terms, monkeypatch):
    monkeypatch.setattr(lexical, "TILE_DOCS", 7)
    rng = np.random.default_rng(2)
    words = ["the", "The", "é1", "É1", "x9", "中文", "rare", "tie", "a-b", "long"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 12)))) for i in rng.permutation(90)]
    docs += [(500 + i, "tie tie") for i in range(30)] + [(500, "tie tie"), (None, "rare rare"), (601, None), (602, ""), (603, "... --"), (604, "long " * 100_000)]
    items = [(1, "the é1 tie"), (2, "TIE"), (3, None), (4, ""), (5, "unknown words"), (6, "rare x9 a b long the The"), (6, "中文"), (None, "tie"), (2, "TIE"), (7, "-")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumns({c: F.lit("x") for c in ("n", "cols", "tfs", "item_id", "rank", "score")})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("x") for c in ("item", "doc_id")})
    got = lexical.top_documents(table, asked, block_items=block_items, block_terms=block_terms)
    assert sorted(tuple(r) for r in got.collect()) == plain_ranking(docs, items)
    assert lexical.top_documents(table.limit(0), asked).count() == 0 and lexical.top_documents(table, asked.limit(0)).count() == 0


def test_tiles_of_any_width_agree_and_stay_whole():
    rng = np.random.default_rng(3)
    pairs = np.unique(np.stack([rng.integers(0, 50, 400), rng.integers(0, 30, 400)], axis=1), axis=0)
    weight = rng.integers(0, 40_000, 50).astype(np.float64)
    owner, cols = np.repeat(np.arange(20), 15), np.concatenate([rng.permutation(50)[:15] for _ in range(20)])
    impacts = rng.integers(1, 1_000_000, len(cols))
    want = np.zeros((20, 30), np.int64)
    for d, c, x in zip(owner, cols, impacts):
        for item in pairs[pairs[:, 0] == c, 1]:
            want[d, item] += int(weight[c]) * int(x)
    for items, width in ((30, 1024), (7, 3), (1, 1)):
        tiles = lexical.ItemTiles(pairs, 30, weight, items, width)
        got = np.concatenate([s for _, s in tiles.scores(owner, cols, impacts, 20)], axis=1)
        assert (got == want).all()
    top = lexical.tile_width(np.array([40_000.0]))
    assert top * 40_000 * lexical.IMPACT_LIMIT < 2**53 and lexical.tile_width(np.array([2.0**50 / lexical.IMPACT_LIMIT]), 99) == 7
    with pytest.raises(ValueError):
        lexical.tile_width(np.array([2.0**60]))


# --- spelling ---------------------------------------------------------------------------------------------

def plain_variants(docs):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or "") if doc is not None else []:
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(words)))
    form, near = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + d:] for d in (0, 1) for i in range(len(w) + 1 - d) for c in letters}
        around = (edits & words.keys()) - {w}
        near[w] = len(around)
        best = min(around, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_as_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()), key=lambda r: r[0])
    assert got == plain_variants(docs)


@pytest.mark.parametrize("max_filter_bits", [spelling.MAX_FILTER_BITS, 0])
def test_variants_of_odd_words(spark, max_filter_bits):
    chain = [("colours", 5), ("colour", 25), ("colouré", 125), ("colourés", 625), ("COLOURÉS", 5), ("Colourís", 3_125)]
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(chain)]
    rows += [(20, "aaaaaa aaaaaaa " * 6), (21, "aaaaaa×÷ß " * 7), (22, "short Ünïcode9ünïcode " * 5), (23, None), (24, ""), (None, "aaaaaa " * 99), (25, ("x" * 5_000 + " ") * 6 + ("x" * 5_001 + " ") * 40)]
    rows += [(26, "表示abcdef表abcdeg " * 5)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("word", "n", "name", "form", "root", "other")})
    want = plain_variants([r for r in rows if r[0] != 25])
    got = sorted((tuple(r) for r in spelling.variants(table, max_filter_bits=max_filter_bits).collect()), key=lambda r: r[0])
    assert [r for r in got if len(r[0]) < 4_000] == want
    assert {(len(r[0]), len(r[1] or "")) for r in got if len(r[0]) >= 4_000} == {(5_000, 5_001), (5_001, 0)}
    assert spelling.variants(table.limit(0), max_filter_bits=max_filter_bits).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 30])
def test_any_alphabet_gives_the_same_pairs(spark, symbols):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(200)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    got = sorted((r["word"], r["other"]) for r in spelling.near_pairs(table, symbols=symbols).collect())
    assert got == sorted((a, b) for a in words for b in words if a != b and apart(a, b))
