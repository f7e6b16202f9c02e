from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\v"


def bank_number(col: Column | str, strict: bool = True) -> Column:
    """Bank id as an integer: ``"010"`` and ``"10"`` are one bank.

    An id which is no integer is an error, or null with ``strict=False``. As a
    grouping key the integer sorts about twice as fast as its text.
    """
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("bigint") if strict else col.try_cast("bigint")


def normalize_bank_id(col: Column | str, strict: bool = True) -> Column:
    """The same as text, without padding."""
    return bank_number(col, strict).cast("string")


def format_key(col: Column | str) -> Column:
    """Payment format for comparison: outer blanks and letter case do not count."""
    return F.lower(F.btrim(col, F.lit(_BLANKS)))


def currency_key(col: Column | str) -> Column:
    """Currency name for comparison: letter case does not count."""
    return F.lower(col)


def float_parse(col: Column | str, strict: bool = True) -> Column:
    """Decimal text as a double; bad text is an error, or null with ``strict=False``.

    A type letter at the end, as in ``9.0d``, is bad text, though a cast would take it.
    """
    col = F.col(col) if isinstance(col, str) else col
    text = F.lower(F.btrim(col.cast("string"), F.lit(_BLANKS)))
    typed = F.right(text, F.lit(1)).isin("d", "f") & ~F.endswith(text, F.lit("inf"))
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a number: "), col.cast("string")))
        return F.when(typed, bad).otherwise(col.cast("double"))
    return F.when(~typed, col.try_cast("double"))
