"""Predicates over single values, as column expressions (rules D1 to D9 of the inventory, and numeric guards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CATEGORIES, WS, WS_CHARS
from .spans import let


def chars(text: Column) -> Column:
    """The characters of a text; of an empty one none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def email(value: Column) -> Column:
    return value.rlike(rf"^[^{WS_CHARS}@]+@[^{WS_CHARS}@]+\.[^{WS_CHARS}@]+$")


def mod97(value: Column) -> Column:
    """The number that a text of digits and capitals stands for (A is 10), modulo 97."""

    def step(r: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(chars(value), F.lit(0), step)


def iban(value: Column) -> Column:
    good = r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"
    turned = lambda own: F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4))
    return let(F.upper(F.regexp_replace(value, f"{WS}+", "")), lambda own: F.when(own.rlike(good), mod97(turned(own)) == 1).otherwise(False))


def card(value: Column) -> Column:
    return let(only_digits(value), lambda digits: F.length(digits).between(13, 19) & luhn(digits))


def ipv4(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d{1,3}$") & (p.try_cast("int") <= 255))


def ipv6(value: Column) -> Column:
    """Eight groups, or fewer with one '::'."""
    part = lambda p: p.rlike("^[A-Fa-f0-9]{1,4}$")
    full = F.split(value, ":")
    halves = F.split(value, "::")
    listed = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
    short = F.concat(listed(F.get(halves, F.lit(0))), listed(F.get(halves, F.lit(1))))
    return value.contains(":") & F.when(value.contains("::"), (F.size(short) < 8) & F.forall(short, part)).otherwise((F.size(full) == 8) & F.forall(full, part))


def date_parts(value: Column) -> Column:
    """(year, month, day, order, separator, short) of 2024-01-31 or 31.1.2024 or 31.1.24; null if it is neither."""
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    dmy = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{2}|\d{4})$"
    part = lambda p, i: F.regexp_extract(value, p, i).try_cast("int")
    year = part(dmy, 4)
    first = F.struct(part(iso, 1).alias("year"), part(iso, 2).alias("month"), part(iso, 3).alias("day"), F.lit("ymd").alias("order"), F.lit("-").alias("separator"), F.lit(False).alias("short"))
    second = F.struct(F.when(year < 100, year + 1900).otherwise(year).alias("year"), part(dmy, 3).alias("month"), part(dmy, 1).alias("day"), F.lit("dmy").alias("order"), F.regexp_extract(value, dmy, 2).alias("separator"), (F.length(F.regexp_extract(value, dmy, 4)) == 2).alias("short"))
    return F.when(value.rlike(iso), first).when(value.rlike(dmy), second)


def date(value: Column) -> Column:

    def ok(d: Column) -> Column:
        written = F.format_string("%04d-%02d-%02d", d["year"], d["month"], d["day"])
        return d.isNotNull() & F.coalesce(d["year"].between(1900, 2099) & written.try_cast("date").isNotNull(), F.lit(False))

    return let(date_parts(value), ok)


def phone(value: Column) -> Column:
    """7 to 15 digits that don't pass as a card number, with a separator or a leading plus."""
    return value.rlike(rf"[{WS_CHARS}./()+-]") & let(only_digits(value), lambda digits: F.length(digits).between(7, 15) & ~luhn(digits))


def known_category(value: Column) -> Column:
    return F.coalesce(value.isin(*CATEGORIES), F.lit(False))


def finite(value: Column) -> Column:
    """The number itself, or null if it is null, NaN or infinite."""
    own = value.cast("double")
    return F.when(own.isNotNull() & ~F.isnan(own) & (F.abs(own) != float("inf")), own)


def finite_positive(value: Column) -> Column:
    own = finite(value)
    return F.when(own > 0, own)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, of timestamps with or without a zone (the session's zone counts for those without)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


#: The validator of each pass of the detector, in order.
BY_PASS = (email, iban, card, ipv4, ipv6, date, phone)
