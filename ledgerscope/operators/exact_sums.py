"""Sums of doubles that do not depend on the order or the partitioning of the rows.

A double is a whole number times a power of two. It is cut into digits of ``BITS`` bits at fixed places, digits
of one place are added as 64-bit numbers (exact in any order, for up to 2**40 rows of one place), and only the total is
rounded, once, to the nearest double with ties to even. The result is that of Python's ``math.fsum``.

A first aggregation goes by key and place of a number's lowest digit, with Spark's partial stage, and turns any number
of rows into some few per key (amounts of money lie within two or three places, all doubles within 107). These can be stored and
merged; the last aggregation goes by key over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
PARTS = 4  # a number of up to 55 bits, moved by up to 19, has at most four digits
LOWEST = -1074  # the exponent of the smallest double; digit 0 begins here
FLAGS = ("has_nan", "has_plus", "has_minus")
STATE = ("place", *(f"part_{i}" for i in range(PARTS)), "number", *FLAGS)
CARRIES = 4  # further digits for the carries of 63-bit sums


def _times_power(value: Column, exponent: Column) -> Column:
    """value * 2**exponent in two steps, as one factor alone can be beyond the range of doubles."""
    half = F.floor(exponent / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _shift(direction: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{direction}", value, by.cast("int"))


def _number(value: Column) -> tuple[Column, Column]:
    """Whole number below 2**55 and exponent of the size of a finite double.

    The logarithm may be off by one either way: two bits of room keep the number whole and below the limit.
    """
    size = F.abs(value)
    exponent = F.greatest(F.coalesce(F.floor(F.log2(size)) - 53, F.lit(LOWEST)), F.lit(LOWEST))
    return size, exponent


def exact_sums(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per key: ``by``, ``total`` (double) and ``number`` (how many values are not null).

    Nulls are left out; a key without values has the total null. NaN, and infinities of both signs, give NaN; infinities of one
    sign give it; a total beyond the range of doubles is infinite; a total of zero is 0.0. Without ``by`` there is always one row.
    Other columns of ``df`` may have any name, and keys may be null.
    """
    names = [f"key_{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(name) for name, c in zip(names, by)], F.col(value).alias("value"))
    sums = finished_sums(partial_sums(rows, names, "value"), names)
    return sums.select(*[F.col(name).alias(c) for name, c in zip(names, by)], "total", "number")


def partial_sums(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """State of the sums, which may be stored: ``by`` and the columns of ``STATE``, some few rows per key.

    States of parts of a table, put together in any way, are a state of the whole table. No key may be named like a column of it.
    """
    keys = [F.col(c).alias(f"key_{i}") for i, c in enumerate(by)]
    names = [f"key_{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = df.select(*keys, x.alias("x"), F.when(finite, x).otherwise(F.lit(0.0)).alias("plain"))

    size, exponent = _number(F.col("plain"))
    rows = rows.select(*names, "x", "plain", size.alias("size"), exponent.alias("exponent"))
    moved = F.col("exponent") - LOWEST
    rows = rows.select(
        *names, "x",
        F.when(F.col("plain") < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("sign"),
        _times_power(F.col("size"), -F.col("exponent")).cast("long").alias("whole"),
        F.floor(moved / BITS).cast("int").alias("place"),
        F.pmod(moved, F.lit(BITS)).cast("int").alias("shift"),
    )
    mask = F.lit((1 << BITS) - 1).cast("long")
    room = BITS - F.col("shift")
    low_mask = _shift("left", F.lit(1).cast("long"), room) - 1
    rest = _shift("right", F.col("whole"), room)
    parts = [_shift("left", F.col("whole").bitwiseAND(low_mask), F.col("shift"))]
    parts += [F.shiftright(rest, BITS * i).bitwiseAND(mask) for i in range(PARTS - 1)]

    infinite = F.abs("x") == F.lit(float("inf"))
    sums = rows.groupBy(*names, "place").agg(
        *[F.sum(F.col("sign") * part).alias(f"part_{i}") for i, part in enumerate(parts)],
        F.count("x").alias("number"),
        F.max(F.isnan("x")).alias("has_nan"),
        F.max(infinite & (F.col("x") > 0)).alias("has_plus"),
        F.max(infinite & (F.col("x") < 0)).alias("has_minus"),
    )
    return sums.select(*[F.col(name).alias(c) for name, c in zip(names, by)], *STATE)


def finished_sums(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sums of `exact_sums` from states of parts of a table. Each part adds at most 107 rows per key."""
    names = [f"key_{i}" for i in range(len(by))]
    states = states.select(*[F.col(c).alias(name) for name, c in zip(names, by)], *STATE)
    # First by place, so that the array below has at most one entry per place, however many parts there are.
    sums = states.groupBy(*names, "place").agg(
        *[F.sum(f"part_{i}").alias(f"part_{i}") for i in range(PARTS)],
        F.sum("number").alias("number"),
        *[F.max(c).alias(c) for c in FLAGS],
    )
    digit = [
        F.struct((F.col("place") + i).alias("place"), F.col(f"part_{i}").alias("part")) for i in range(PARTS)
    ]
    totals = sums.groupBy(*names).agg(
        F.flatten(F.collect_list(F.array(*digit))).alias("parts"),
        F.coalesce(F.sum("number"), F.lit(0)).alias("number"),
        *[F.max(c).alias(c) for c in FLAGS],
    )
    total = (
        F.when(F.col("number") == 0, F.lit(None).cast("double"))
        .when(F.col("has_nan") | (F.col("has_plus") & F.col("has_minus")), F.lit(float("nan")))
        .when(F.col("has_plus"), F.lit(float("inf")))
        .when(F.col("has_minus"), F.lit(float("-inf")))
        .otherwise(F.col("rounded"))
    )
    return _rounded(totals, names).select(
        *[F.col(name).alias(c) for name, c in zip(names, by)], total.alias("total"), "number"
    )


def _carried(parts: Column, sign: int) -> Column:
    """Digits from 0 to 2**BITS - 1, lowest first, and the carry left over (negative if the number is)."""
    base = 1 << BITS
    start = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast("long").alias("carry"))

    def step(state: Column, place: Column) -> Column:
        here = F.aggregate(
            F.filter(parts, lambda p: p["place"] == place), state["carry"], lambda total, p: total + sign * p["part"]
        )
        return F.struct(
            F.concat(state["digits"], F.array(F.pmod(here, F.lit(base).cast("long")))).alias("digits"),
            F.shiftright(here, BITS).alias("carry"),
        )

    places = F.sequence(F.col("lowest"), F.col("highest"))
    return F.aggregate(places, start, step)


def _rounded(totals: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``rounded``, the double nearest to the number that ``parts`` add up to."""
    places = F.transform("parts", lambda p: p["place"])
    rows = totals.select(
        "*",
        F.coalesce(F.array_min(places), F.lit(0)).alias("lowest"),
        (F.coalesce(F.array_max(places), F.lit(0)) + CARRIES).alias("highest"),
    )
    rows = rows.withColumn("plus", _carried(F.col("parts"), 1))
    rows = rows.withColumn("negative", F.col("plus.carry") < 0)
    minus = F.when(F.col("negative"), _carried(F.col("parts"), -1)["digits"])
    rows = rows.withColumn("digits", F.coalesce(minus, F.col("plus.digits")))
    # The highest digit that is not 0, counted from 1; 0 for a sum of zero.
    indexed = F.transform("digits", lambda d, i: F.when(d != 0, i + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("top", F.coalesce(F.array_max(indexed), F.lit(0)))

    def at(back: int) -> Column:
        return F.coalesce(F.get("digits", F.col("top") - 1 - back), F.lit(0).cast("long"))

    # 60 bits from the highest one down; a 1 in the last place stands for anything below. A long becomes
    # the nearest double with ties to even, and the power of two changes nothing but the exponent.
    used = F.length(F.bin(at(0)))
    free = BITS - used
    lead = F.shiftleft(at(0), 2 * BITS).bitwiseOR(F.shiftleft(at(1), BITS)).bitwiseOR(at(2))
    lead = _shift("left", lead, free).bitwiseOR(_shift("right", at(3), used))
    left_out = at(3).bitwiseAND(_shift("left", F.lit(1).cast("long"), used) - 1) != 0
    below = F.exists(F.slice("digits", 1, F.greatest(F.col("top") - 4, F.lit(0))), lambda d: d != 0)
    lead = lead.bitwiseOR((left_out | below).cast("long"))
    exponent = (F.col("lowest") + F.col("top") - 3) * BITS - free + LOWEST
    value = _times_power(lead.cast("double"), exponent)
    return rows.withColumn(
        "rounded",
        F.when(F.col("top") == 0, F.lit(0.0)).when(F.col("negative"), -value).otherwise(value),
    )
