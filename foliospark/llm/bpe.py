"""Merge tables of byte-level BPE and rank-synchronous merging over ragged arrays."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from foliospark.llm.common import utf8

NONE = np.int64(1) << 40  # rank of a pair that does not merge
#: Entries and characters that a cache of pre-tokens keeps beside those of the step at hand; it starts anew when it is full.
CACHE_SIZE, CACHE_CHARS = 400_000, 8_000_000


class Merges(NamedTuple):
    """``first[b]``: id of a byte; ``keys``: sorted ``left * size + right`` with ``rank`` and ``merged`` id beside."""

    size: int
    first: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    tokens: list[bytes]
    specials: tuple[str, ...]


def _merges(size: int, first: np.ndarray, rows: list[tuple[int, int, int, int]], tokens: list[bytes],
            specials: tuple[str, ...]) -> Merges:
    rows.sort(key=lambda r: r[0] * size + r[1])
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Merges(size, first, table[:, 0] * size + table[:, 1], table[:, 2].copy(), table[:, 3].copy(), tokens, specials)


def _printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load_json(path: str) -> Merges:
    """A vocabulary file with an explicit merge list; its added tokens are ``specials``."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, byte_of = spec["model"]["vocab"], _printable_bytes()
    specials = tuple(t["content"] for t in spec["added_tokens"])
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    tokens = [b""] * size
    for text, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in text)
    first = np.zeros(256, np.int64)
    for c, b in byte_of.items():
        first[b] = vocab[c]
    rows = []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        rows.append((vocab[left], vocab[right], rank, vocab[left + right]))
    return _merges(size, first, rows, tokens, specials)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Merges:
    """A rank file: two neighbours merge when their bytes together are a token, the lowest id first."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    rows = []
    for token, i in ranks.items():
        tokens[i] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.append((left, right, i, i))
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return _merges(size, first, rows, tokens, ())


def _pairs(m: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of pairs; NONE where there is no merge."""
    if not len(m.keys):
        return np.full(len(left), NONE), np.zeros(len(left), np.int64)
    key = left * m.size + right
    at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
    return np.where(m.keys[at] == key, m.rank[at], NONE), m.merged[at]


def merge_all(m: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and how many each word has.

    All words merge in step: each round finds every word's lowest rank, merges all its occurrences (of overlapping ones
    every other, from the left), and drops the words that have no merge left. Empty words have no tokens.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    ids = m.first[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), length)
    last = np.ones(len(ids), bool)
    last[:-1] = word[1:] != word[:-1]
    rank, into = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
    inner = np.flatnonzero(~last)
    rank[inner], into[inner] = _pairs(m, ids[inner], ids[inner + 1])
    done_ids, done_words = [], []
    while len(ids):
        start = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        low = np.minimum.reduceat(rank, start)
        span = np.diff(np.append(start, len(ids)))
        open_word = np.repeat(low < NONE, span)
        if not open_word.all():
            done_ids.append(ids[~open_word])
            done_words.append(word[~open_word])
            low, span = low[low < NONE], span[low < NONE]
            ids, word, last, rank, into = (a[open_word] for a in (ids, word, last, rank, into))
            if not len(ids):
                break
        hit = np.flatnonzero(rank == np.repeat(low, span))
        order = np.arange(len(hit))
        begins = np.ones(len(hit), bool)
        begins[1:] = hit[1:] != hit[:-1] + 1
        hit = hit[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
        ids[hit] = into[hit]
        last[hit] = last[hit + 1]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        changed = place[hit]
        ids, word, last, rank, into = (a[keep] for a in (ids, word, last, rank, into))
        before = changed[changed > 0] - 1
        changed = np.concatenate([changed, before[~last[before]]])
        rank[changed] = NONE
        changed = changed[~last[changed]]
        rank[changed], into[changed] = _pairs(m, ids[changed], ids[changed + 1])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(words))


class Cache(dict):
    """What is known of pre-tokens, and how many characters they have together."""

    chars = 0


def fill(cache: Cache, m: Merges, words: Iterable[str], value) -> None:
    """Merge the words the cache does not know; ``value(ids, counts)`` gives what is kept, one entry for each word.

    The cache never holds more than its bounds and the words of one step, so a corpus of long strings that never come again costs
    no memory beyond that.
    """
    new = list(set(words).difference(cache))
    chars = sum(map(len, new))
    if len(cache) + len(new) > CACHE_SIZE or cache.chars + chars > CACHE_CHARS:
        cache.clear()
        new = list(set(words))
        cache.chars, chars = 0, sum(map(len, new))
    cache.chars += chars
    for at in range(0, len(new), 200_000):
        part = new[at: at + 200_000]
        cache.update(zip(part, value(*merge_all(m, [utf8(w) for w in part]))))
