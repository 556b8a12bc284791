"""Deterministic synthetic values that keep a value's format, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators as V
from .patterns import BANK, CALLING_CODES, DIGITS, LOWER, UPPER, WS
from .spans import let


def seed(value: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of a text: a character beyond the first 65,536 counts as its two surrogates."""
    start = F.lit(0x811C9DC5).cast("long")
    mixed = lambda h, unit: (h.bitwiseXOR(unit) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        low = lambda: (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(code < 0x10000, mixed(h, code)).otherwise(mixed(mixed(h, F.shiftright(code - 0x10000, 10) + 0xD800), low()))

    return F.aggregate(V.chars(value), start, step)


def hash36(value: Column) -> Column:
    return F.lpad(F.lower(F.conv(seed(value).cast("string"), 10, 36)), 7, "0")


def seed_key(original: Column, key: Column | None = None, variant: Column | None = None) -> Column:
    base = original if key is None else F.coalesce(F.when(key != "", key), original)
    return base if variant is None else F.when(variant > 0, F.concat(base, F.lit("#"), variant.cast("string"))).otherwise(base)


def pick(values: list[str] | tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (seed(key) % len(values)).cast("int"))


def refill(original: Column, digits: Column) -> Column:
    """original with its digits replaced in order, by 0 when they run out."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        own = F.coalesce(F.nullif(F.substring(digits, a["i"] + 1, F.lit(1)), F.lit("")), F.lit("0"))
        new = F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], own).alias("out"))
        return F.when(c.rlike("[0-9]"), new).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out")))

    return F.aggregate(V.chars(original), start, step, lambda a: a["out"])


def email(original: Column, key: Column) -> Column:
    return F.concat(F.lit("person-"), F.substring(hash36(key), 1, 6), F.lit("@example.invalid"))


def iban(original: Column, key: Column) -> Column:
    bban = F.concat(F.lit(BANK), F.lpad((seed(key) % 10_000_000_000).cast("string"), 10, "0"))
    whole = let(bban, lambda b: F.concat(F.lit("DE"), F.lpad((98 - V.mod97(F.concat(b, F.lit("131400")))).cast("string"), 2, "0"), b))
    return let(whole, lambda w: F.when(original.rlike(WS), F.regexp_replace(w, "(.{4})(?=.)", "$1 ")).otherwise(w))


def card(original: Column, key: Column) -> Column:
    n = F.least(F.greatest(F.length(V.only_digits(original)), F.lit(13)), F.lit(19))
    body = F.substring(F.concat(F.lit("4"), F.rpad(seed(key).cast("string"), 19, "0")), F.lit(1), n - 1)
    last = let(body, lambda own: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(own, d.cast("string"))), lambda c: V.luhn(c)))
    return let(F.get(last, F.lit(0)), lambda digits: refill(original, digits))


def phone(original: Column, key: Column) -> Column:
    plus = F.regexp_replace(original, f"^{WS}+", "").startswith("+")

    def code(digits: Column) -> Column:
        n = F.length(digits)
        known = F.filter(F.array(*[F.lit(c) for c in CALLING_CODES]), lambda c: digits.startswith(c) & (n - F.length(c) >= 6))
        guess = F.substring(digits, F.lit(1), F.least(F.lit(3), F.greatest(n - 6, F.lit(1))))
        return F.struct(F.when(plus, F.coalesce(F.get(known, F.lit(0)), guess)).otherwise("").alias("code"), n.alias("n"))

    def fill(x: Column) -> Column:
        own = F.substring(F.repeat(F.concat(F.lit(DIGITS), seed(key).cast("string")), F.lit(2)), F.lit(1), x["n"] - F.length(x["code"]))
        return let(F.substring(F.concat(x["code"], own), F.lit(1), x["n"]), lambda d: refill(original, d))

    return let(let(V.only_digits(original), code), fill)


def ip(original: Column, key: Column) -> Column:
    four = lambda s: F.concat(F.lit("203.0.113."), (s % 254 + 1).cast("string"))
    six = lambda s: F.concat(F.lit("2001:db8::"), F.lower(F.hex(s % 65535)))
    return let(seed(key), lambda s: F.when(original.contains(":"), six(s)).otherwise(four(s)))


def date(original: Column, key: Column) -> Column:
    day = F.lpad((seed(key) % 27 + 1).cast("string"), 2, "0")
    month = F.lpad((seed(F.concat(key, F.lit(":month"))) % 12 + 1).cast("string"), 2, "0")

    def made(x: Column) -> Column:
        d = x["d"]
        year = F.when(d["short"], "88").otherwise("1988")
        mark = F.coalesce(d["separator"], F.lit("."))
        return F.when(d["order"] == "ymd", F.concat(year, F.lit("-"), x["month"], F.lit("-"), x["day"])).otherwise(F.concat(x["day"], mark, x["month"], mark, year))

    return let(F.struct(V.date_parts(original).alias("d"), day.alias("day"), month.alias("month")), made)


def pattern(original: Column, key: Column) -> Column:
    """Digits from the stream, ASCII letters from streams turned by the seed, all else as it is."""

    def made(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("u"), F.lit(0).alias("l"), F.lit("").alias("out"))

        def step(a: Column, c: Column) -> Column:
            is_d, is_u, is_l = c.rlike("[0-9]"), c.rlike("[A-Z]"), c.rlike("[a-z]")
            digit = F.substring(x["digits"], a["d"] + 1, F.lit(1))
            letter = lambda s, turn, n: F.substring(F.lit(s), ((n.cast("long") + turn) % len(s) + 1).cast("int"), F.lit(1))
            new = F.when(is_d, F.when(digit == "", "0").otherwise(digit)).when(is_u, letter(UPPER, x["up"], a["u"])).when(is_l, letter(LOWER, x["low"], a["l"])).otherwise(c)
            one = lambda on: F.when(on, 1).otherwise(0)
            return F.struct((a["d"] + one(is_d)).alias("d"), (a["u"] + one(is_u)).alias("u"), (a["l"] + one(is_l)).alias("l"), F.concat(a["out"], new).alias("out"))

        return F.aggregate(V.chars(original), start, step, lambda a: a["out"])

    up = seed(key)
    streams = let(up, lambda u: F.struct(F.repeat(F.concat(F.lit(DIGITS), u.cast("string")), F.lit(3)).alias("digits"), u.alias("up"), seed(F.concat(key, F.lit(":lower"))).alias("low")))
    return let(streams, made)


def generic(original: Column, key: Column) -> Column:
    return F.concat(F.lit("Redacted-"), F.substring(hash36(key), 1, 6))


STRUCTURED: dict[str, Callable[[Column, Column], Column]] = {
    "email": email,
    "iban": iban,
    "credit_card": card,
    "phone": phone,
    "ip_address": ip,
    "date": date,
    "national_id": pattern,
    "passport": pattern,
    "driver_license": pattern,
    "medical_record": pattern,
}


def replacement(original: Column, category: Column, key: Column | None = None, only: tuple[str, ...] = tuple(STRUCTURED)) -> Column:
    """A synthetic value for a category; what isn't structured is generic here (names, addresses and companies: see people)."""
    own = original if key is None else key

    def choose(x: Column) -> Column:
        o, k = x["o"], x["k"]
        out = F.when(F.lit(False), o)
        for name in only:
            out = out.when(category == name, STRUCTURED[name](o, k))
        return out.otherwise(generic(o, k))

    return let(F.struct(original.alias("o"), own.alias("k")), choose)


def suggestion(original: Column, proposed: Column) -> Column:
    """A proposed value without white space at its ends; empty if it is the original or contains it."""
    trimmed = F.regexp_replace(F.regexp_replace(F.coalesce(proposed, F.lit("")), f"^{WS}+", ""), f"{WS}+$", "")
    return let(trimmed, lambda own: F.when(own.contains(original), "").otherwise(own))
