"""Text expressions. Everything here is a Column built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as word characters and as digits for the text rules.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same as classes, and what is no white space: printable ASCII is told by one range, before the long list is gone through.
BLANK, INK = f"[[^!-~]&&[{SPACE}]]", f"[!-~[^{SPACE}]]"
#: Up to so many words a pattern can ask for them one by one.
SHORT_WORDS = 100
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
DAMAGE_MARKS = ["�", "Ã¢Â\u0080", "(cid:"]
AMOUNT_PATTERN = r"\$[\d,.]+"
LEGAL_TERMS = ["agreement", "party", "shall", "effective date"]
NON_PRINTABLE = r"[^\x20-\x7E\t\n\r\x0B\x0C]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def spans(c: Column, least: int) -> Column:
    """Whether a text has at least ``least`` characters once it is stripped; it is read no further than that takes."""
    if least < 1:
        return F.lit(True)
    more = f"(?s:.{{{least - 2}}}.*?){INK}" if least > 1 else ""
    return c.rlike(f"^{BLANK}*+{INK}{more}")


def normalize_text(c: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends. A single plain space, most of them, stays as it is."""
    return F.trim(F.regexp_replace(c, f"(?: {BLANK}|[{BLANK}&&[^ ]]){BLANK}*+", " "))


def word_count(c: Column) -> Column:
    """Number of white-space separated words, counted by the runs of white space around them: finding the words themselves, by the negated
    class, takes several times as long."""
    edged = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    return (F.regexp_count(edged, F.lit(f"{BLANK}+")) - 1).cast("bigint")


def is_short(c: Column, min_words: int = 10) -> Column:
    """Fewer words than ``min_words``: the text is read only as far as that many words go."""
    if not 1 <= min_words <= SHORT_WORDS:
        return word_count(c) < min_words
    more = f"(?:{BLANK}++{INK}++){{{min_words - 1}}}" if min_words > 1 else ""
    return ~F.coalesce(c, F.lit("")).rlike(f"^{BLANK}*+{INK}++{more}")


def tokenize(c: Column) -> Column:
    """Lower-case word tokens of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]{{2,}})"), 1)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space. Give a stored column: the lambda reads it once per element."""
    pairs = F.transform(tokens, lambda t, i: F.concat_ws(" ", t, F.get(tokens, i + 1)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def token_set(c: Column) -> Column:
    """Distinct lower-case words of more than two characters that are not plain numbers."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), f"[{SPACE}]+")
    keep = F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(f"^[.,]*[{DIGIT}][{DIGIT}.,]*$"))
    return F.array_distinct(keep)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two duplicate-free arrays; NULL when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common))


def dollar_amounts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({AMOUNT_PATTERN})"), 1)


def amount_value(c: Column) -> Column:
    """``$1,234.50`` as a number; NULL when the digits do not form one."""
    digits = F.translate(c, "$,", "")
    return F.when(digits.rlike(r"^(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))


def is_garbled(c: Column) -> Column:
    hit = F.lit(False)
    for mark in DAMAGE_MARKS:
        hit = hit | c.contains(mark)
    return hit


def non_printable_count(c: Column) -> Column:
    """Characters outside printable ASCII, each code point counted once."""
    return (F.length(c) - F.length(F.regexp_replace(c, NON_PRINTABLE, ""))).cast("bigint")


def term_hits(c: Column, terms: list[str] | None = None) -> Column:
    """How many of the terms occur in the text, case ignored."""
    lowered = F.lower(c)
    return sum((lowered.contains(t.lower()).cast("bigint") for t in terms or LEGAL_TERMS), F.lit(0).cast("bigint"))


def company_slug(c: Column) -> Column:
    return F.left(F.translate(F.lower(c), " ,-", ""), F.lit(20))


def mask_account(c: Column) -> Column:
    return F.concat(F.lit("****"), F.right(c, F.lit(4)))


def address_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(", "))


def join_names(names: Column) -> Column:
    """Names as one line, NULL for an empty list."""
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def fill_placeholders(clause: Column, values: Column) -> Column:
    """Replace every ``{name}`` marker by its value from a map column."""
    return F.aggregate(
        F.map_entries(values), clause,
        lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def document_number(layout: Column, day: Column, prefix: Column, seq: Column) -> Column:
    """A number in one of four layouts (0 to 3) from a date, a prefix and a five-digit sequence."""
    year, month, digits = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.lpad(seq.cast("string"), 5, "0")
    return (
        F.when(layout == 0, F.concat(F.lit("INV-"), year, month, F.lit("-"), digits))
        .when(layout == 1, F.concat_ws("-", prefix, year, digits))
        .when(layout == 2, F.concat(F.lit("#"), digits))
        .otherwise(F.concat(prefix, digits))
    )
