"""Main text of web pages (method: consensus host paths).

Each page scores its own containers and votes for the best one; a host's votes are added up in Spark over generalised paths
(tags and classes, digits levelled); every page of the host is then extracted again by the host's winning paths.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.joins import salted_join
from foliospark.session import materialize

# Element names and words of class names, by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: Blocks of text: they belong to the container around them and are never one themselves.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption hr address "
                   "hgroup details summary center".split())
DROPPED = frozenset("nav footer aside form button dialog menu head object audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "banner sponsor sponsored promo promotion cookie cookies consent notice notices notification gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus "
    "pagination pager widget toolbar search skip".split())
NEGATIONS = frozenset("no has with without hide hidden".split())
ARTICLE_WORDS = frozenset("article post entry story".split())
HEAD_ONLY = frozenset("meta link base title style script noscript template".split())
#: An open element of the key's kind ends where one of its kind starts, up to the elements that hold it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_TOKEN = re.compile(
    r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
_HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Share of a block's weight that each container further out keeps.
DECAY = 0.8
#: A path counts for a host when it has at least this share of the host's votes, so a host has at most twenty.
MIN_SHARE = 0.05


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL; null where there is none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def _dropped_name(names: str) -> bool:
    for name in names.lower().split():
        words = re.split(r"[^a-z]+", name)
        for i, word in enumerate(words):
            if word in DROPPED_WORDS and not NEGATIONS.intersection(words[:i]) and not (word == "header" and ARTICLE_WORDS.intersection(words)):
                return True
    return False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


class Page:
    """Blocks of text with the container each belongs to.

    ``containers`` are ``(parent, path)``, the body first; ``blocks`` are ``(container, text, characters inside links)``.
    """

    def __init__(self, source: str, by_name: bool = True):
        self.containers: list[tuple[int, str]] = [(-1, "body")]
        self.blocks: list[tuple[int, str, int]] = []
        self._by_name = by_name  # class names and roles can drop an element
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # element, its container, dropped
        self._parts: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if raw and not self._stack[-1][2]:
            text = html.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _pop_to(self, depth: int) -> None:
        for name, _, _ in self._stack[depth:]:
            self._links -= name == "a"
        del self._stack[depth:]

    def _open_depth(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str] | None) -> int:
        """Where the innermost open element of ``names`` is; 0 if an element of ``stop`` (None: any but inline ones) holds it off."""
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self._stack[depth][0]
            if name in names:
                return depth
            if name in stop if stop is not None else name not in INLINE:
                return 0
        return 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if self._stack[-1][0] == "head" and name not in HEAD_ONLY:
            self._pop_to(len(self._stack) - 1)
        if name in ("html", "body"):
            return
        if name in INLINE:
            self._links += name == "a"
            self._stack.append((name, *self._stack[-1][1:]))
            return
        self._flush()
        if depth := self._open_depth({"p"}, None):
            self._pop_to(depth)
        if name in CLOSES and (depth := self._open_depth(*CLOSES[name])):
            self._pop_to(depth)
        if name in VOID:
            return
        _, container, dropped = self._stack[-1]
        if not dropped:
            known = _attributes(attributes) if self._by_name or name not in BLOCKS else {}
            inside = any(e[0] in ("article", "main") for e in self._stack)
            dropped = name in DROPPED or name == "header" and not inside or self._by_name and (
                "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower()
                or known.get("role", "").lower() in DROPPED_ROLES or name != "main" and _dropped_name(f"{known.get('class', '')} {known.get('id', '')}"))
            if not dropped and name not in BLOCKS:
                kinds = sorted(re.sub(r"\d+", "0", known.get("class", "")).split())
                self.containers.append((container, "/".join((self.containers[container][1], ".".join((name, *kinds))))))
                container = len(self.containers) - 1
        self._stack.append((name, container, dropped))

    def _end(self, name: str) -> None:
        if name in INLINE:
            if depth := self._open_depth({name}, None):
                self._links -= name == "a"
                del self._stack[depth]
        elif name not in ("html", "body", "br"):
            self._flush()
            if depth := self._open_depth({name}, frozenset()):
                self._pop_to(depth)

    def _read(self, source: str) -> None:
        at = 0
        while found := _TOKEN.search(source, at):
            self._text(source[at:found.start()])
            at = found.end()
            if name := found[2]:
                name = name.lower()
                if found[1]:
                    self._end(name)
                elif name in RAW:
                    end = _ENDS[name].search(source, at)
                    at = end.end() if end else len(source)
                else:
                    self._start(name, found[3])
        self._text(source[at:])
        self._flush()

    def best_path(self) -> str | None:
        """The container that holds most text, less what is inside links; each step outwards costs a share. Ties: the first path."""
        scores: Counter[str] = Counter()
        for container, text, linked in self.blocks:
            weight = float(max(len(text) - 2 * linked, 0))
            while container >= 0 and weight >= 1:
                parent, path = self.containers[container]
                scores[path] += weight
                container, weight = parent, weight * DECAY
        return min(scores, key=lambda path: (-scores[path], path)) if scores else None

    def text_under(self, path: str) -> str:
        inside = []
        for parent, own in self.containers:
            inside.append(own == path or parent >= 0 and inside[parent])
        return " ".join(text for container, text, _ in self.blocks if inside[container])


def read_page(source: str | None) -> Page:
    """The page without what its names mark as no article; where that leaves nothing, only element names count."""
    page = Page(source or "")
    return page if page.blocks or not source else Page(source, by_name=False)


def article(page: Page, paths: list[str]) -> str:
    """Text below the first of ``paths`` that the page has, else below its own best container."""
    for path in (*paths, page.best_path() or "body"):
        if text := page.text_under(path):
            return text
    return page.text_under("body")


def host_paths(pages: DataFrame, host_col: str = "_host") -> DataFrame:
    """``(host, paths, pages)``: paths with at least a twentieth of the host's votes, most votes first, ties by path."""
    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter((h, read_page(source).best_path()) for h, source in zip(batch["h"], batch["html"]))
            rows = [(h, path, n) for (h, path), n in counts.items() if path is not None]
            yield pd.DataFrame(rows, columns=["host", "path", "n"]).astype({"n": "int64"})

    cast = pages.filter(F.col(host_col).isNotNull()).select(F.col(host_col).alias("h"), "html").mapInPandas(votes, "host string, path string, n bigint")
    counted = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    # One row for each kind of container of a host meets here, no page.
    shares = counted.withColumn("all", F.sum("n").over(Window.partitionBy("host"))).filter(F.col("n") >= MIN_SHARE * F.col("all"))
    ranked = shares.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "path"))).alias("p"), F.max("all").alias("pages"))
    return ranked.select("host", F.col("p.path").alias("paths"), "pages")


def with_paths(rows: DataFrame, rules: DataFrame, broadcast_bytes: int, **hot: int) -> DataFrame:
    """``rows`` with the ``paths`` of their ``_host``, null where there are none: by broadcast while the rules fit, else by a salted join."""
    size = rules.agg(F.sum(F.octet_length(F.to_json(F.struct("host", "paths"))))).first()[0] or 0
    needed = rules.select(F.col("host").alias("_host"), "paths")
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(needed), "_host", "left")
    counts = rules.select(F.col("host").alias("_host"), F.col("pages").alias("n"))
    known = salted_join(rows.filter(F.col("_host").isNotNull()), needed, ["_host"], F.xxhash64("page_id", "url"), "left", counts, **hot)
    return known.unionByName(rows.filter(F.col("_host").isNull()).withColumn("paths", F.lit(None).cast("array<string>")))


def extract(pages: DataFrame, id_col: str | Column = "page_id", url_col: str | Column = "url", html_col: str | Column = "html",
            broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: the article's blocks in page order, white space (any that Unicode knows) as single spaces.

    A null or empty html, or one without text, gives the empty text. A page whose URL has no host goes by its own best container and votes for
    nobody. Repeated rows each vote and each come back; an empty table gives an empty one; other columns are not carried, so their names
    cannot clash. A page is read whole, whatever its length. Host rules are broadcast up to ``broadcast_bytes``; past that they are
    joined, with the pages of large hosts dealt over several tasks.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"), column(html_col).alias("html")).withColumn("_host", host(F.col("url")))
    rules = materialize(host_paths(rows), "host-paths")
    joined = with_paths(rows, rules, broadcast_bytes)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [article(read_page(source), [] if paths is None else list(paths)) for source, paths in zip(batch["html"], batch["paths"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found})

    schema = joined.select("page_id", "url", F.lit("").alias("text")).schema
    return joined.select("page_id", "url", "html", "paths").mapInPandas(texts, schema).withColumn("n_chars", F.length("text").cast("bigint"))
