"""Money arithmetic.

Order totals carry two decimals, prices and what follows from them four.  Amounts are summed as whole
cents, or as whole parts of a cent, in a bigint: that is exact, does not depend on the order of the
rows and stays inside generated code; results become doubles at the end.  A bigint of parts holds
9.2e14 in currency units; with ANSI mode on (the default) Spark raises beyond that.

Prices that come as decimals with more than four places are not rounded: their amounts are decimals of the
same scale throughout, of 38 digits when added up, and equally exact.  `exact_amount` picks the form by the
types of a frame's columns, `total` reads either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 10_000  # of a currency unit
PLACES = 4  # the decimals that parts have
PRICE_DIGITS = 27  # a price of so many digits, times a quantity of ten, fits 38


def cents(amount: Column) -> Column:
    """A double or decimal amount as whole cents."""
    return F.rint(amount.cast("double") * 100).cast("bigint")


def dollars(amount_in_cents: Column) -> Column:
    """Whole cents as a double amount."""
    return amount_in_cents.cast("double") / 100


def parts(amount: Column) -> Column:
    """A double or decimal amount in parts of a cent (the fourth decimal)."""
    return F.rint(amount.cast("double") * PARTS).cast("bigint")


def amount(in_parts: Column) -> Column:
    """Parts of a cent as a double amount."""
    return in_parts.cast("double") / PARTS


def decimals(df: DataFrame, names: Sequence[str]) -> int | None:
    """The most places of the decimals among some columns; None if parts of a cent hold them all."""
    kinds = [df.schema[name].dataType for name in names if name in df.columns]
    scale = max((kind.scale for kind in kinds if isinstance(kind, T.DecimalType)), default=0)
    return scale if scale > PLACES else None


def exact_amount(amount: Column, scale: int | None) -> Column:
    """An amount in parts of a cent, or as a decimal where ``scale`` asks for more places."""
    return parts(amount) if scale is None else amount.cast(T.DecimalType(PRICE_DIGITS, scale))


def total(df: DataFrame, name: str) -> Column:
    """A column of exact amounts as a double amount."""
    exact = isinstance(df.schema[name].dataType, T.DecimalType)
    return F.col(name).cast("double") if exact else amount(F.col(name))
