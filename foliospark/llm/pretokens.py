"""Pre-token boundaries of byte-level BPE without a regular expression.

The split pattern of byte-level BPE is a finite automaton once every character also knows its right neighbours. Texts
are laid end to end as an array of code points, mapped to symbol classes by table lookup, and every symbol stands for
a transition function on eight states. Composition of such functions is associative and only a few hundred functions can
arise, so each is a number, composition is one lookup in a square table, and all prefixes come from a blocked scan.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4  # BLANK: white space except U+0020; SPACE: U+0020
# Symbols: classes with what follows folded in. A white space symbol "before" precedes a character that is none.
END, L, N, O, Q1, Q2, SPACE_IN, BLANK_IN, SPACE_BEFORE, BLANK_BEFORE = range(10)
# States: what the last character belongs to.
# After a contraction anything starts anew, as after START.
START, IN_L, IN_N, IN_O, LEAD, IN_W, WANT1, WANT2 = range(8)
STATES, SYMBOLS = 8, 10
BLOCK = 64


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, by the Unicode tables of the library whose splits are to be met."""
    import tiktoken
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    single = {bytes([i]): i for i in range(256)}
    table = np.zeros(0x110000, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        matcher = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        matched = bytes(matcher.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = value
    table[0x20] = SPACE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at the character."""
    if symbol == END:
        return START, False
    if state in (WANT1, WANT2):  # letters of a contraction
        return (START if state == WANT1 else WANT1), False
    if symbol in (SPACE_IN, BLANK_IN, SPACE_BEFORE, BLANK_BEFORE):
        last = symbol in (SPACE_BEFORE, BLANK_BEFORE)
        starts = state != IN_W or last
        return (LEAD if symbol == SPACE_BEFORE else IN_W), starts
    same = {L: IN_L, N: IN_N, O: IN_O, Q1: IN_O, Q2: IN_O}[symbol]
    if state in (LEAD, same):
        return same, False
    return {Q1: WANT1, Q2: WANT2}.get(symbol, same), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, state each function leads to from START, starts by symbol and state)."""
    step = [tuple(_step(state, symbol)[0] for state in range(STATES)) for symbol in range(SYMBOLS)]
    starts = np.array([[_step(state, symbol)[1] for state in range(STATES)] for symbol in range(SYMBOLS)])
    known = {tuple(range(STATES)): 0}
    queue = [tuple(range(STATES))]
    for f in queue:
        for g in step:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
    return (np.array([known[f] for f in step], np.uint16), compose.ravel(), np.array([f[START] for f in queue], np.uint16),
            starts.ravel())


def _prefixes(f: np.ndarray) -> np.ndarray:
    """Composition of every prefix: inside blocks of 64 side by side, over blocks by doubling."""
    _, compose, _, _ = monoid()
    size = int(np.sqrt(len(compose)))
    blocks = -(-len(f) // BLOCK)
    rows = np.zeros((BLOCK, blocks), np.uint16)  # 0 is the identity
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[: len(f)] = f
    rows[:] = padded.reshape(blocks, BLOCK).T
    for k in range(1, BLOCK):
        rows[k] = compose[rows[k - 1].astype(np.intp) * size + rows[k]]
    total = rows[-1].copy()
    shift = 1
    while shift < blocks:
        total[shift:] = compose[total[:-shift].astype(np.intp) * size + total[shift:]]
        shift *= 2
    before = np.zeros(blocks, np.intp)
    before[1:] = total[:-1]
    return compose[(before * size)[None, :] + rows].T.ravel()[: len(f)]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with a NUL after each, the places where pre-tokens start in it, and the place where each text starts.

    A NUL inside a text is an ordinary character: only the closing ones end a text.
    """
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.zeros(len(texts), np.int64)
    np.cumsum(length[:-1] + 1, out=first[1:])
    end = first + length
    kind = class_table()[code]
    symbol = np.array([O, L, N, BLANK_IN, SPACE_IN], np.uint8)[kind]
    solid = kind < BLANK
    solid[end] = False
    follows = np.zeros(len(code), bool)
    follows[:-1] = solid[1:]
    symbol[(symbol >= SPACE_IN) & follows] += SPACE_BEFORE - SPACE_IN
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        ahead = np.zeros((2, len(quote)), np.uint32)  # the closing NUL keeps quote + 1 inside
        ahead[0] = code[quote + 1]
        ahead[1] = code[np.minimum(quote + 2, len(code) - 1)]
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(pair[0])) & (ahead[1] == ord(pair[1]))
        symbol[quote[one]] = Q1
        symbol[quote[two]] = Q2
    symbol[end] = END
    function, _, from_start, starts = monoid()
    state = from_start[_prefixes(function[symbol])]
    previous = np.zeros(len(state), np.intp)
    previous[1:] = state[:-1]
    return joined, np.flatnonzero(starts[symbol.astype(np.intp) * STATES + previous]), first


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens in order, and how many of them each text has."""
    joined, at, first = boundaries(texts)
    upto = np.append(np.searchsorted(at, first[1:]), len(at))
    count = np.diff(upto, prepend=0)
    stop = np.append(at[1:], len(joined))
    full = count > 0
    stop[upto[full] - 1] = np.append(first[1:], len(joined))[full] - 1  # not the closing NUL
    return [joined[a:b] for a, b in zip(at.tolist(), stop.tolist())], count
