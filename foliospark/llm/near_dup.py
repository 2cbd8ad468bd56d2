"""Near-duplicate documents (method: one-permutation MinHash with optimal densification, bands, star-shaped candidate edges)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.joins import salted_join
from foliospark.llm.common import utf8
from foliospark.session import materialize, text_batches

BINS, ROWS = 128, 4  # 32 bands of 4: two sets of similarity 0.8 share no band once in 20 million pairs
#: Least bits of the closing sweep's map of a set; a larger set has the next power of two from twice its size.
BITMAP_BITS = 2048
#: Documents on either side of one block of the closing sweep.
SWEEP_ROWS = 1024
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of the splitmix64 finisher


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run, one without words none."""
    parts = utf8(text or "").lower().split()  # bytes methods touch ASCII only
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    run = min(words, len(h))
    out = np.full(len(h) - run + 1, run, np.uint64)
    for i in range(run):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i: i + len(out)])
    return np.unique(out)


def shingles(text: str | None, words: int) -> set[bytes]:
    """The set itself, for confirming."""
    parts = utf8(text or "").lower().split()
    run = min(words, len(parts))
    return {b" ".join(parts[i: i + run]) for i in range(len(parts) - run + 1)} if parts else set()


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each bin, the order in which it looks for a full one: fixed random bins, then all in turn."""
    rng = np.random.default_rng(17)
    turn = (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS
    return np.concatenate([np.arange(BINS)[:, None], rng.integers(0, BINS, (BINS, 8 * BINS)), turn], axis=1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest hash in each of the bins the hash range is cut into; an empty bin borrows from the first full bin on its own walk."""
    spread = mixed(hashes)
    bins = (spread >> np.uint64(57)).astype(np.int64)
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bins, spread)
    full = np.zeros(BINS, bool)
    full[bins] = True
    if not full.all():
        walk = _probes()[~full]
        low[~full] = low[walk[np.arange(len(walk)), full[walk].argmax(axis=1)]]
    return low


def bands(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each band, which names the band too."""
    rows = sig.reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit for each hash, in so many bits that unrelated sets of any size differ in most of theirs."""
    bits = max(BITMAP_BITS, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else BITMAP_BITS
    out = np.zeros(bits, bool)
    out[(hashes % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """The maps (words in the last axis) of the same sets in half as many bits."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, n, print, bands)``: size of the set, a 128-bit print of it, and its bands (none for the empty set)."""
    @F.pandas_udf("n bigint, print binary, bands array<bigint>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.tolist():
                h = shingle_hashes(text, words)
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, bands(signature(h)).tolist() if len(h) else []))
            yield pd.DataFrame(rows, columns=["n", "print", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), made(F.col(text_col)).alias("_m")).select("id", "_m.*")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: every node of ``edges(a, b)`` with the smallest node it reaches.

    Every round gives a node the smallest root among its neighbours, and then that root's own root; it ends when no node's
    neighbour has a smaller one. Each round is written to the shared folder. Stars settle in two or three rounds.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = materialize(lower, "roots")
        if lower.filter("root <> old").isEmpty():
            return lower.select("node", "root")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = lower.join(up, "root").select("node", F.col("above").alias("root"))


def likely_among(df: DataFrame, id_col: str, ids: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``df`` whose id may be among ``ids(id)``: all that are, and a few others.

    A Bloom filter of 16 bits for each id, at most ``max_bits`` (32 MiB), is what every task gets; past that more rows pass.
    """
    bits = min(max(1 << 16, 1 << (16 * ids.count()).bit_length()), max_bits)
    spots = lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(4)])
    words = ids.select(F.explode(spots(F.col("id"))).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("value")).toPandas()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            bit = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 4), np.int64)
            yield pd.Series(((shared.value[bit >> 6] >> (bit & 63)) & 1 == 1).all(axis=1))

    return df.filter(F.col(id_col).isNotNull()).filter(passes(spots(F.col(id_col))))


def linked(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough; ``texts(id, text)`` holds every text of their documents.

    ``pairs`` is a written table. A star's centre has its text repeated over several tasks.
    """
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[str, set] = {}
        for ours, theirs in batches:
            out = []
            for x, y in zip(ours, theirs):
                if x not in held:  # a star's centre comes again and again
                    if len(held) >= 8:
                        held.pop(next(iter(held)))
                    held[x] = shingles(x, words)
                out.append(linked(held[x], shingles(y, words), percent))
            yield pd.Series(out)

    centres = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = salted_join(pairs.join(left, "b"), right, ["a"], F.col("b"), counts=centres)
    return both.filter(similar("text_a", "text_b")).select("a", "b").distinct()


def stars(reps: DataFrame) -> DataFrame:
    """Candidate edges ``(a, b)``: in every bucket, each document with the bucket's smallest id and with its most central one.

    Central is what shares most bucket places with others. A bucket gives at most two edges for each document, never all pairs.
    """
    placed = reps.select("id", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).filter("size > 1")
    shared = materialize(shared, "shared-buckets")
    sizes = shared.select("band", F.col("size").alias("n"))
    members = materialize(salted_join(placed, shared, ["band"], F.col("id"), counts=sizes), "bucket-members")
    central = members.groupBy("id").agg(F.sum("size").alias("reach"))
    members = members.join(central, "id")
    middle = members.groupBy("band").agg(F.max_by("id", F.struct("reach", -F.col("id"))).alias("middle"))
    once = members.select(F.col("first").alias("a"), F.col("id").alias("b"))
    again = salted_join(members, middle, ["band"], F.col("id"), counts=sizes).select(F.col("middle").alias("a"), F.col("id").alias("b"))
    edges = once.unionByName(again).filter("a <> b")
    return edges.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.max("a").alias("a")).select(
        "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` as pairs of the components their ends are in, those inside one component left out."""
    for end in ("a", "b"):
        label = parts.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(label, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    return materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "bridges")


def sweep(edges: DataFrame, nodes: DataFrame, parts: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that could link what the stars left apart.

    A family is what candidate edges hang together, ``parts(node, root)`` are the components of the links so far. Where they leave a family in several components, every document
    outside its largest component meets the documents of the other components, in blocks; only pairs pass whose bit maps
    allow the similarity: a bit that only one side has stands for a shingle that only that side has. That bound
    never rules out a link, and no pair that it rules out is ever a row.
    """
    apart = between(edges, parts)
    family = components(apart).select(F.col("node").alias("part"), F.col("root").alias("family"))
    label = parts.select("node", F.col("root").alias("part"))
    spread = nodes.select(F.col("id").alias("node")).join(label, "node", "left").select("node", F.coalesce("part", "node").alias("part"))
    spread = materialize(spread.join(family, "part").select("node", "family", "part"), "families")
    sizes = spread.groupBy("family", "part").agg(F.count(F.lit(1)).alias("size"))
    split = (sizes.groupBy("family").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("rows"), F.max("size").alias("most"),
                                         F.max_by("part", F.struct("size", -F.col("part"))).alias("main")).filter("parts > 1"))

    @F.pandas_udf("n bigint, bits binary")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch]
            yield pd.DataFrame({"n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets]})

    rows = spread.join(split, "family").join(texts.select(F.col("id").alias("node"), "text"), "node")
    rows = rows.select("family", "node", "part", "main", "rows", "most", mapped("text").alias("_m")).select("*", "_m.n", "_m.bits").drop("_m")
    rows = materialize(rows, "family-rows")
    cuts = lambda c: F.ceil(c / SWEEP_ROWS).cast("int")
    place = F.pmod(F.xxhash64("node"), F.greatest(cuts(F.col("rows")), F.lit(1))).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(cuts(c), F.lit(1)) - 1))
    outside = F.col("rows") - F.col("most")
    all_rows = rows.select("family", "node", "part", "n", "bits", place.alias("block"), every(outside).alias("asker"))
    askers = rows.filter("part <> main").select(
        "family", "node", "part", "main", "n", "bits", F.pmod(F.xxhash64("node"), F.greatest(cuts(outside), F.lit(1))).cast("int").alias("asker"), every(F.col("rows")).alias("block"))

    def meet(key: tuple, rest: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found_a, found_b = [], []
        if len(rest) and len(ask):
            for size, same in rest.groupby(rest["bits"].map(len)):
                whole = np.stack([np.frombuffer(b, np.uint64) for b in same["bits"]])
                maps = {8 * whole.shape[1]: whole, 4 * whole.shape[1]: folded(whole)}  # sets alike enough differ by one step at most
                n, part, node = (same[c].to_numpy() for c in ("n", "part", "node"))
                for u, up, main, un, ub in zip(*(ask[c] for c in ("node", "part", "main", "n", "bits"))):
                    # of two askers only the smaller id asks
                    at = np.flatnonzero((part != up) & ((part == main) | (node > u)) & (100 * np.minimum(n, un) >= percent * np.maximum(n, un)))
                    if not len(at):
                        continue
                    mine = np.frombuffer(ub, np.uint64)
                    if len(ub) > size:
                        mine = folded(mine)
                    bits = maps[8 * len(mine)][at]
                    only = np.bitwise_count(mine & ~bits).sum(axis=1, dtype=np.int64)
                    theirs = np.bitwise_count(bits & ~mine).sum(axis=1, dtype=np.int64)
                    most = np.minimum(un - only, n[at] - theirs)
                    at = at[100 * most >= percent * (un + n[at] - most)]
                    found_a += node[at].tolist()
                    found_b += [u] * len(at)
        return pd.DataFrame({"a": found_a, "b": found_b}, dtype="int64")

    keys = ["family", "block", "asker"]
    return all_rows.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, a row for every row of ``docs``.

    A document's set are its distinct runs of ``words`` words (ASCII white space between words, A-Z lowered; a shorter text is
    one run). Documents are linked when ``100 * intersection >= percent * union``, confirmed on full sets; ``component_id`` is the
    smallest id that links reach, and ``kept`` marks that document. Equal sets fold into one before candidates are sought; stars
    give candidates, and a closing sweep looks at what they left apart, so a link is lost only if two similar sets share none of 32 bands.

    A text that is null or without words has an empty set and links with nothing. Rows that share an id are one document: what any
    of them links to, all do. An empty table gives an empty one; other columns are not carried. A row without id is alone: its component is null and it is kept. Repeated rows come back as often.
    """
    spark = docs.sparkSession
    with text_batches(spark):
        made = materialize(sketch(docs, id_col, text_col, words), "sketches")
    usable = made.filter("id is not null and n > 0")
    first = usable.groupBy("print").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first, "distinct-sets")
    copies = first.select("print", F.col("copies").alias("n"))
    sets = salted_join(usable.select("id", F.col("n").alias("size"), "print"), first.select("print", "rep"), ["print"], F.col("id"), counts=copies)
    bare = made.filter("id is null or n = 0").select("id", "n", F.lit(None).cast("bigint").alias("rep"))
    placed = materialize(sets.select("id", F.col("size").alias("n"), "rep").unionByName(bare), "placed")
    reps = first.select(F.col("rep").alias("id"), "bands")
    edges = materialize(stars(reps), "candidates")
    needed = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    needed = materialize(needed, "candidate-ids")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    texts = likely_among(texts, "id", needed).join(needed, "id", "left_semi").distinct()
    texts = materialize(texts, "candidate-texts")
    with text_batches(spark):
        links = materialize(confirm(edges, texts, words, percent), "links")
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")  # one id, two sets
    links = links.unionByName(placed.join(several, "id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    parts = components(links)
    with text_batches(spark):
        late = sweep(edges, needed, parts, texts, words, percent)
    late = materialize(late, "sweep-pairs")  # its blocks hold no text, and are not split
    with text_batches(spark):
        bridges = between(confirm(late, texts, words, percent), parts)  # a late link joins two components, not all their documents
    joined = components(bridges).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    roots = (first.select("rep").distinct().join(parts.select(F.col("node").alias("rep"), "root"), "rep", "left")
             .select("rep", F.coalesce("root", "rep").alias("part")).join(joined, "part", "left")
             .select("rep", F.coalesce("whole", "part").alias("root")))
    held = first.groupBy("rep").agg(F.sum("copies").alias("n"))
    known = salted_join(placed.filter("rep is not null").withColumnRenamed("n", "size"), roots, ["rep"], F.col("id"), "left", held)
    out = known.withColumnRenamed("size", "n").unionByName(placed.filter("rep is null").withColumn("root", F.lit(None).cast("bigint")))
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
