"""Column functions: price ordering, time helpers, map building, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minor-unit digits of the supported currencies.
MINOR_DIGITS = {"GBP": 2, "EUR": 2, "USD": 2, "HKD": 2, "NZD": 2}
DEFAULT_CURRENCY = "GBP"


def price_key(price: Column, *, lenient: bool = False) -> Column:
    """Numeric ordering key of a price string; the string itself is what gets emitted."""
    cast = price.try_cast if lenient else price.cast
    return cast("decimal(38,18)")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def shift(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL {seconds} SECONDS")


def sorted_map(key: str, value: str) -> Column:
    """Aggregate: a map with keys in order, so equal groups give equal maps."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))


def of_minor(amount: Column, currency: Column) -> Column:
    """Decimal amount of a count of minor units."""
    digits = F.create_map(*[F.lit(x) for kv in MINOR_DIGITS.items() for x in kv])
    return (amount.cast("decimal(38,6)") / F.pow(F.lit(10), digits[currency]).cast("decimal(10,0)")).cast("decimal(38,6)")


def add_money(a: Column, a_cur: Column, b: Column, b_cur: Column) -> Column:
    """Sum of two amounts; raises when the currencies differ."""
    return F.when(a_cur.eqNullSafe(b_cur), a + b).otherwise(F.raise_error(F.lit("currency mismatch")).cast("decimal(38,6)"))
