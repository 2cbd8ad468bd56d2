"""Money and number expressions on doubles and decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: splits a double into two halves whose product with a small integer is exact.
SPLITTER = 134217729.0
# Fixed value: from here on doubles lie further apart than a cent, so each is its own rounding.
COARSE = 2.0 ** 46


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once, for bodies that mention a costly ``x`` many times."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def let_sql(x: Column, body: str) -> Column:
    """``let`` with the body as a lambda in SQL text. The text is parsed as a whole, where a body built of Column calls costs
    hundreds of calls to the JVM each time a rule mentions it, seconds for a record with all its rules."""
    return F.get(F.call_function("transform", F.array(x), F.expr(body)), F.lit(0))


def round_cents(x: Column) -> Column:
    """Round a double to two places by its exact binary value, ties to even.

    Spark's ``round`` works on the printed decimal digits, so 2.675 (which is stored a little below) becomes
    2.68. The records are checked against amounts rounded by binary value, 2.67. Only a product that looks like a
    tie needs a second look: there ``x * 100`` is taken as an exact sum of two doubles.
    """
    product = x * 100.0
    scaled = x * SPLITTER
    high = scaled - (scaled - x)
    error = (high * 100.0 - product) + (x - high) * 100.0
    nearest = F.rint(product)
    tie = F.when(error > 0, F.ceil(product)).when(error < 0, F.floor(product)).otherwise(nearest)
    cents = F.when(F.abs(product - nearest) != 0.5, nearest).otherwise(tie.cast("double"))
    return F.when(F.abs(x) < COARSE, cents / 100.0).otherwise(x)


def exact_sum(x: Column) -> Column:
    """Sum of doubles that does not depend on their order: added as decimals of ten places, as a double.

    NULL where a value or the sum does not fit decimal(38,10), as one row of 1e17 must not end a whole job.
    """
    wide = x.try_cast("decimal(28,10)")
    return F.when(F.count_if(x.isNotNull() & wide.isNull()) == 0, F.try_sum(wide)).cast("double")


_NUMBER_TEXT = r"""
v -> CASE
  WHEN abs(v) = 0 OR (abs(v) >= 1e-3D AND abs(v) < 1e7D) THEN CAST(v AS STRING)
  WHEN abs(v) >= 1e-4D AND abs(v) < 1e16D
    THEN regexp_replace(regexp_replace(CAST(try_cast(v AS DECIMAL(38,20)) AS STRING), r'0+$', ''), r'\.$', '.0')
  WHEN try_cast(substring_index(CAST(v AS STRING), 'E', -1) AS INT) IS NOT NULL
    THEN concat(regexp_replace(substring_index(CAST(v AS STRING), 'E', 1), r'\.0$', ''), 'e',
      CASE WHEN try_cast(substring_index(CAST(v AS STRING), 'E', -1) AS INT) < 0 THEN '-' ELSE '+' END,
      lpad(CAST(abs(try_cast(substring_index(CAST(v AS STRING), 'E', -1) AS INT)) AS STRING), 2, '0'))
  ELSE CAST(v AS STRING) END"""


def number_text(x: Column) -> Column:
    """A double as its shortest decimal text: ``25.0``, ``10000000.0``, ``1e+16``."""
    return let_sql(x, _NUMBER_TEXT)


def money_text(x: Column) -> Column:
    """``1,234.50``."""
    return F.format_number(x, 2)


def line_amount(quantity: Column, price: Column) -> Column:
    return round_cents(quantity * price)


def percent_of(amount: Column, percent: Column) -> Column:
    return round_cents(amount * percent / 100.0)
