"""Column helpers that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut off both ends of a typed name.
BLANKS = " \t\r\n\u00a0"


def clean_ticker(column: Column | str) -> Column:
    """Trimmed upper-case name; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.upper(F.btrim(column, F.lit(BLANKS)))


def clean_label(column: Column | str) -> Column:
    """Lower case, trimmed, hyphen and blank written as underscore; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.translate(F.btrim(column, F.lit(BLANKS)), "- ", "__"))


def is_finite(column: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    column = F.col(column) if isinstance(column, str) else column
    column = column.cast("double")
    return F.coalesce(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), F.lit(False))


def finite_or_null(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(is_finite(column), column.cast("double"))


def ratio(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    """Division that yields ``otherwise`` (null by default) over zero."""
    return F.when(bottom != 0, top / bottom).otherwise(otherwise if otherwise is not None else F.lit(None).cast("double"))


def significant_code(column: Column | str, digits: int = 10) -> Column:
    """An exact 64-bit code of a double rounded to ``digits`` significant digits.

    Two numbers have the same code if and only if they round to the same
    ``digits`` significant digits. Null has a code of its own (0), so have NaN
    and the two infinities; the code is never null.
    """
    column = F.col(column) if isinstance(column, str) else column
    size = F.abs(column)
    power = F.floor(F.log10(size)).cast("int")
    # scaled in two steps: 10 ** (digits - power) alone overflows for the smallest doubles
    shift = F.lit(digits - 1) - power
    half = F.floor(shift / F.lit(2.0)).cast("int")
    mantissa = F.round(size * F.pow(F.lit(10.0), half.cast("double")) * F.pow(F.lit(10.0), (shift - half).cast("double"))).cast("long")
    full = F.lit(10**digits)
    power = F.when(mantissa >= full, power + 1).otherwise(power)
    mantissa = F.when(mantissa >= full, F.lit(10 ** (digits - 1))).otherwise(mantissa)
    code = ((power.cast("long") + 512) * F.lit(10 ** (digits + 1)) + mantissa) * F.signum(column).cast("long")
    infinity = F.lit(float("inf"))
    return (
        F.when(column.isNull(), F.lit(0).cast("long"))
        .when(F.isnan(column), F.lit(1).cast("long"))
        .when(column == 0, F.lit(2).cast("long"))
        .when(column == infinity, F.lit(3).cast("long"))
        .when(column == -infinity, F.lit(4).cast("long"))
        .otherwise(code)
    )
