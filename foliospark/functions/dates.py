"""Date texts in the seven accepted layouts."""

from __future__ import annotations

from pyspark.sql import Column

from foliospark.functions.numbers import let_sql
from foliospark.functions.text import SPACE

# The accepted layouts, as the shape of the text and the pattern that reads it.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SHORT_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
YEAR = r"(?!0000)\d{4}"
LAYOUTS = [
    (rf"^\d{{1,2}}/\d{{1,2}}/{YEAR}$", "M/d/yyyy"),
    (rf"(?i)^({MONTHS}) \d{{1,2}}, {YEAR}$", "MMMM d, yyyy"),
    (rf"(?i)^\d{{1,2}}-({SHORT_MONTHS})-{YEAR}$", "d-MMM-yyyy"),
    (rf"^{YEAR}-\d{{1,2}}-\d{{1,2}}$", "yyyy-M-d"),
    (rf"(?i)^({SHORT_MONTHS}) \d{{1,2}}, {YEAR}$", "MMM d, yyyy"),
    (rf"(?i)^\d{{1,2}} ({MONTHS}) {YEAR}$", "d MMMM yyyy"),
]
SHORT_YEAR = r"^\d{1,2}/\d{1,2}/\d{2}$"
FIRST_YEAR_OF_1900S = 69


def _layouts() -> str:
    shapes = "\n".join(f"WHEN t RLIKE r'{shape}' THEN try_to_date(t, '{pattern}')" for shape, pattern in LAYOUTS)
    return f"""t -> CASE
      WHEN t RLIKE r'{SHORT_YEAR}' THEN try_to_date(concat(substring_index(t, '/', 2), '/',
        CASE WHEN try_cast(right(t, 2) AS INT) >= {FIRST_YEAR_OF_1900S} THEN '19' ELSE '20' END, right(t, 2)), 'M/d/yyyy')
      {shapes} END"""


_PARSE_DATE = f"""
d -> CASE WHEN NOT d RLIKE r'^[{SPACE}]|[{SPACE}]$'
  THEN get(transform(array(regexp_replace(d, r'[{SPACE}]+', ' ')), {_layouts()}), 0) END"""


def parse_date(c: Column) -> Column:
    """The date a text stands for, or NULL. The shape is checked first, so each text is parsed at most once."""
    return let_sql(c, _PARSE_DATE)
