"""Personal data: fixed kinds, and terms that give protected entities away (method: information-theoretic sanitisation)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import fresh
from foliospark.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the contract. Possessive runs and look-behinds only keep long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}<>«»“”‘’…*#%&$|/\\-–—_=+~^`@"
_WORD = re.compile(r"[^\W_](?:['’-]?[^\W_])*+")

Span = tuple[int, int, int]  # (start, kind, end)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        floor = match.end() if match else at + 1
        if match:
            yield start, floor
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed kinds in code points, by start, then kind. Kinds are searched apart and may overlap."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _core(token: str) -> str:
    core = token.strip(_EDGE)
    return core[:-2] if core[-2:] in ("'s", "’s", "'S", "’S") else core


def term_of(token: str) -> str | None:
    """The term a run of non-blank characters stands for, lowered: letters and digits, joined by single apostrophes or hyphens, without
    edge signs and a closing 's. It has a letter, and four characters or else two with a capital or a digit among them (Ann, IBM, A7)."""
    core = _core(token)
    if len(core) < 2 or not (core.isalpha() or _WORD.fullmatch(core) and any(map(str.isalpha, core))):
        return None
    return core.lower() if len(core) >= 4 or core != core.lower() or any(map(str.isdigit, core)) else None


def general_form(token: str) -> str:
    """The class that stands in for a term: a code (with digits), an acronym (capitals), a name (a capital first) or any other term."""
    core = _core(token)
    if any(map(str.isdigit, core)):
        return "[CODE]"
    if core.isupper() and len(core) > 1:
        return "[ACRONYM]"
    return "[NAME]" if core[:1].isupper() else "[TERM]"


def entity_of(text: str, span: Span) -> int:
    """The entity a span names: its kind and its value without case or separators, as a hash."""
    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else re.sub("[^0-9]", "", text[start:end])
    return xxhash.xxh3_64_intdigest(f"{KINDS[kind]}:{value}") - (1 << 63)


def surroundings(text: str, spans: list[Span], window: int) -> dict[int, int]:
    """Of every entity of a text, a hash of the ``window`` words on both sides of all its spans, as far as 24 characters a word reach:
    plain copies have the same."""
    near: dict[int, list[str]] = {}
    reach = 24 * window
    for start, kind, end in spans:
        left = _RUN.findall(text, max(0, start - reach), start)[-window:]
        right = _RUN.findall(text, end, min(len(text), end + reach))[:window]
        near.setdefault(entity_of(text, (start, kind, end)), []).append(" ".join(left + right).lower())
    return {entity: xxhash.xxh3_64_intdigest("\n".join(words)) - (1 << 63) for entity, words in near.items()}


def places(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """``(term, start, end)`` of every term of a text that overlaps no span; spans are in order."""
    taken: list[list[int]] = []
    for start, _, end in spans:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    at = 0
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        term = term_of(m.group()) if at == len(taken) or m.end() <= taken[at][0] else None
        if term:
            yield term, m.start(), m.end()


def detect(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(id, text_hash, base, held)`` of every row: its fixed spans, and its entities with their surroundings."""
    shape = "base array<struct<start: bigint, kind: int, end: bigint>>, held array<struct<entity: bigint, mark: bigint>>"

    @F.pandas_udf(shape)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.tolist():
                spans = base_spans(text or "")
                held = surroundings(text, spans, window) if spans else {}
                rows.append(([{"start": a, "kind": k, "end": b} for a, k, b in spans], [{"entity": e, "mark": m} for e, m in held.items()]))
            yield pd.DataFrame(rows, columns=["base", "held"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), found(F.col(text_col)).alias("_f"))
            .select("id", "text_hash", "_f.base", "_f.held"))


def _passes(bitmap: bytes, key: str, size: int) -> bool:
    return all(bitmap[b >> 3] >> (b & 7) & 1 for b in _bits(xxhash.xxh3_64_intdigest(key), size))


def entity_terms(docs: DataFrame, entities: DataFrame, text_col: str, window: int, filter_bits: int) -> DataFrame:
    """``(entity, term, n_both, low, high)``: in how many rows each of ``entities(entity)`` and each term stand together, over
    whole texts, and the least and largest mark of the entity's surroundings there. Tasks add up before anything is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(entities.select(F.col("entity").cast("string").alias("term")), filter_bits))

    def frame(sums: dict) -> pd.DataFrame:
        rows = [(*pair, *value) for pair, value in sums.items()]
        return pd.DataFrame(rows, columns=["entity", "term", "n", "low", "high"]).astype(
            {"entity": "int64", "term": object, "n": "int64", "low": "int64", "high": "int64"})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, sums = shared.value, {}
        for batch in batches:
            for text in batch["text"].tolist():
                spans = base_spans(text or "")
                held = {e: m for e, m in surroundings(text, spans, window).items() if _passes(bitmap, str(e), filter_bits)} if spans else {}
                if not held:
                    continue
                terms = {term for term, _, _ in places(text, spans)}
                for entity, mark in held.items():
                    for term in terms:
                        n, low, high = sums.get((entity, term), (0, mark, mark))
                        sums[entity, term] = (n + 1, min(low, mark), max(high, mark))
                    if len(sums) > 100_000:
                        yield frame(sums)
                        sums = {}
        yield frame(sums)

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(local, "entity bigint, term string, n bigint, low bigint, high bigint")
    summed = counted.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.join(entities.select("entity"), "entity", "left_semi")


def flagged_places(docs: DataFrame, flagged: DataFrame, id_col: str, text_col: str, filter_bits: int) -> DataFrame:
    """``(id, text_hash, start, end, ratio)``: every place of a flagged term in the rows that hold its entity."""
    pairs = flagged.select(F.concat_ws(":", "entity", "term").alias("term"))
    both = docs.sparkSession.sparkContext.broadcast(_filter_of(pairs, filter_bits))
    own = docs.sparkSession.sparkContext.broadcast(_filter_of(flagged.select(F.col("entity").cast("string").alias("term")), filter_bits))

    @F.pandas_udf("array<struct<entity: bigint, term: string, start: bigint, end: bigint>>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for text in batch.tolist():
                spans = base_spans(text or "")
                held = [e for e in {entity_of(text, s) for s in spans} if _passes(own.value, str(e), filter_bits)]
                rows.append([{"entity": e, "term": term, "start": a, "end": b} for term, a, b in places(text, spans)
                             for e in held if _passes(both.value, f"{e}:{term}", filter_bits)] if held else [])
            yield pd.Series(rows, dtype=object)

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), listed(F.col(text_col)).alias("found"))
    found = found.select("id", "text_hash", F.explode("found").alias("n")).select("id", "text_hash", "n.*")
    return (found.join(flagged, ["entity", "term"]).groupBy("id", "text_hash", "start", "end").agg(F.max("ratio").alias("ratio")))


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str, filter_bits: int) -> DataFrame:
    """``(term, n_term)`` for ``terms(term)``: in how many rows of ``docs`` each of them occurs, over whole texts.

    Every task counts only terms that pass a filter of fixed size; what passes it by chance falls out in the join.
    """
    kept = terms.select("term", F.lit(True).alias("wanted"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(terms, filter_bits))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        seen: dict[str, str | None] = {}
        for batch in batches:
            count: Counter[str] = Counter()
            for text in batch["text"].tolist():
                own = set()
                for token in set((text or "").split()):
                    term = seen.get(token, "")
                    if term == "":
                        if len(seen) > 200_000:
                            seen.clear()
                        term = term_of(token)
                        if term is not None:
                            h = xxhash.xxh3_64_intdigest(term)
                            if not all(bitmap[b >> 3] >> (b & 7) & 1 for b in _bits(h, filter_bits)):
                                term = None
                        seen[token] = term
                    if term is not None:
                        own.add(term)
                count.update(own)
            yield pd.DataFrame({"term": list(count), "n": list(count.values())}).astype({"term": object, "n": "int64"})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(local, "term string, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(kept, "term").drop("wanted")


def _bits(h: int, size: int) -> tuple[int, int, int]:
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return a % size, (a + b) % size, (a + 2 * b) % size


def _filter_of(terms: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the terms: tasks send the bytes they have set, the driver keeps ``bits`` bits."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for term in batch["term"]:
                for b in _bits(xxhash.xxh3_64_intdigest(term), bits):
                    own[b >> 3] |= 1 << (b & 7)
        at = np.flatnonzero(own)
        yield pd.DataFrame({"byte": at, "value": own[at].astype("int32")})

    out = np.zeros(bits // 8, np.uint8)
    merged = terms.mapInPandas(local, "byte bigint, value int").groupBy("byte").agg(F.bit_or("value").alias("value"))
    for row in merged.toLocalIterator():
        out[row["byte"]] = row["value"]
    return out.tobytes()


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, alpha: float, min_docs: int, window: int, filter_bits: int) -> DataFrame:
    """``(entity, term, ratio)``: terms whose pointwise information about an entity in the same text is at least ``alpha`` of all
    there is to know about it: PMI(entity; term) / IC(entity) = 1 + log(P(entity | term)) / -log(P(entity)). All counts are of rows."""
    total = found.count()
    supported = (F.col("n") >= min_docs) & (F.col("low") < F.col("high"))
    # A pair has no more rows and surroundings than its entity.
    entities = found.select(F.explode("held").alias("h")).groupBy("h.entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("h.mark").alias("low"), F.max("h.mark").alias("high")).filter(supported)
    entities = materialize(entities.select("entity", F.col("n").alias("n_entity")), "entities")
    both = entity_terms(docs, entities, text_col, window, filter_bits).withColumnRenamed("n_both", "n").filter(supported)
    both = materialize(both.select("entity", "term", F.col("n").alias("n_both")), "entity-terms")
    df = document_frequency(docs, both.select("term").distinct(), text_col, filter_bits)
    information = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    known = F.log(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")))
    ratio = F.when(information > 0, 1 + known / information).otherwise(F.lit(0.0))
    return (both.join(df, "term").join(entities, "entity").select("entity", "term", ratio.alias("ratio"))
            .filter(F.col("ratio") >= alpha))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.8, min_docs: int = 3,
               window: int = 8, filter_bits: int = 1 << 23) -> DataFrame:
    """``(id, text_hash, base, terms)`` of every row; spans are ``(start, kind, end)`` in code points, end exclusive.

    ``base``: emails, addresses, cards and phones. ``terms`` (with ``ratio``): all places of words (``term_of``)
    that give away an entity named in the same text: over all rows, PMI(entity; word) is at least ``alpha`` of the entity's
    information content, shared by ``min_docs`` rows and two different surroundings (``window`` words on both sides of the
    entity's spans) at least, so that a rare word or plain copies of one text prove nothing. Terms never overlap base spans, and
    a row without base spans has none. A null text counts as empty, an empty table gives no rows, other columns are not carried.
    Rows that share id and text share their terms. ``filter_bits`` bounds what is broadcast.
    """
    found = materialize(detect(docs, id_col, text_col, window), "pii-spans")
    flagged = materialize(disclosing(docs, found, text_col, alpha, min_docs, window, filter_bits), "flagged-terms")
    terms = flagged_places(docs, flagged, id_col, text_col, filter_bits).groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "ratio"))).alias("terms"))
    left, right = found.select("id", "text_hash", "base").alias("l"), terms.alias("r")
    match = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    return left.join(right, match, "left").select("l.id", "l.text_hash", "base", F.coalesce(
        F.col("terms"), F.array().cast("array<struct<start: bigint, kind: int, end: bigint, ratio: double>>")).alias("terms"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 1.0, **params) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, all other columns as they were.

    A base span becomes its kind in brackets; of overlapping ones the union takes the first one's kind. A disclosing term
    is generalised to its class (``general_form``), or removed where its ratio is ``remove_at`` or more. Texts without spans and null texts stay as they are.
    """
    spans = find_spans(docs, id_col, text_col, **params).filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["id", "text_hash"])
    own_id, own_hash, own_base, own_terms = (fresh(docs, name) for name in ("_id", "_hash", "_base", "_terms"))
    spans = spans.select(F.col("id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("base").alias(own_base), F.col("terms").alias(own_terms))

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, bases, terms in batches:
            yield pd.Series([x if b is None else redact(x, [(s["start"], s["kind"], s["end"]) for s in b], [
                (s["start"], s["end"], s["ratio"] >= remove_at) for s in t]) for x, b, t in zip(texts, bases, terms)], dtype=object)

    match = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own_hash))
    joined = docs.join(spans, match, "left").withColumn(text_col, cleaned(F.col(text_col), F.col(own_base), F.col(own_terms)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    cuts: list[list] = []
    for start, kind, end in sorted(base):
        if cuts and start < cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], end)
        else:
            cuts.append([start, end, f"[{KINDS[kind].upper()}]"])
    cuts += [[start, end, "" if gone else general_form(text[start:end])] for start, end, gone in terms]
    out, at = [], 0
    for start, end, label in sorted(cuts):
        out += [text[at:start], label]
        at = end
    return "".join([*out, text[at:]])
