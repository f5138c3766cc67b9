"""Small scalar functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLUE, GREEN = "blue", "green"

# Units of a human-readable byte count, in steps of 1024.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0


def first_truthy_text(*cols: Column) -> Column:
    """First column that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def numeric_key(c: Column) -> Column:
    """A whole number written as text, as bigint; anything else is null.

    The pattern goes first because a failed cast costs far more than a failed match.
    """
    t = F.trim(c)
    d = t.try_cast("double")
    whole = F.when((d == F.floor(d)) & (F.abs(d) < F.lit(2.0**53)), d.cast("bigint"))
    return F.when(t.rlike(r"^[+-]?[0-9]{1,18}$"), t.try_cast("bigint")).when(
        t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), whole
    )


def compact_timestamp(ts: Column, digits: int = 17) -> Column:
    if digits not in (14, 17):
        raise ValueError("digits must be 14 or 17")
    return F.date_format(ts, "yyyyMMddHHmmssSSS" if digits == 17 else "yyyyMMddHHmmss")


def version_timestamp(name: Column, alias: Column) -> Column:
    """The 17 digits that follow ``{alias}_`` in a version name, else null."""
    at = F.instr(name, F.concat(alias, F.lit("_")))
    rest = F.substring(name, at + F.length(alias) + 1, F.length(name))
    return F.when(at > 0, F.nullif(F.regexp_extract(rest, r"^(\d{17})", 1), F.lit("")))


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding spelled out, so that every engine breaks ties the same way."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one decimal; 0 when there is nothing."""
    return F.when(whole > 0, round_half_up(part * 100.0 / whole, 1)).otherwise(F.lit(0.0))


def human_bytes(c: Column) -> Column:
    """``1536`` -> ``1.5 KB``: steps of 1024, at most two decimals, no trailing zeros."""
    step = F.lit(0)
    for i in range(1, len(BYTE_UNITS)):
        step = F.when(c >= F.lit(1024**i), F.lit(i)).otherwise(step)
    scaled = round_half_up(c / F.pow(F.lit(1024.0), step), 2)
    shown = F.regexp_replace(F.format_string("%.2f", scaled), r"\.?0+$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), (step + 1).cast("int"))
    return F.when(c == 0, F.lit("0 B")).otherwise(F.concat_ws(" ", shown, unit))


def opposite_color(c: Column) -> Column:
    return F.when(c == BLUE, F.lit(GREEN)).otherwise(F.lit(BLUE))


def color_of_name(name: Column) -> Column:
    """The colour written between separators in a version name, else null."""
    return F.nullif(F.regexp_extract(name, r"[-_](blue|green)[-_]", 1), F.lit(""))


def hash_pick(key: Column, slot: int, n: int | Column) -> Column:
    """A repeatable integer in ``[0, n)`` drawn from eight hex digits of ``md5(key)``.

    ``slot`` (0 to 3) chooses which eight digits, so one digest serves four draws.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    return hash_word(key, slot) % n


def hash_word(key: Column, slot: int) -> Column:
    digits = F.substring(F.md5(key.cast("binary")), slot * 8 + 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def hash_unit(key: Column, slot: int) -> Column:
    """A repeatable double in ``[0, 1)``."""
    return hash_word(key, slot) / F.lit(4294967296.0)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
