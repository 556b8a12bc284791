"""The detector on plain Python strings, for texts with runs that overflow Java's recursive matcher, and for tests."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from functools import lru_cache

from . import patterns as P
from .people import luhn, mod97


@lru_cache(None)
def _passes() -> tuple:
    return tuple((c, re.compile(p, re.ASCII)) for c, p in P.PASSES)


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _iban(value: str) -> bool:
    own = re.sub(f"{P.WS}+", "", value).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", own)) and mod97(own[4:] + own[:4]) == 1


def _card(value: str) -> bool:
    return 13 <= len(_digits(value)) <= 19 and luhn(_digits(value))


def _date(value: str) -> bool:
    if m := re.fullmatch(r"([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", value):
        y, mo, d = map(int, m.groups())
    elif m := re.fullmatch(r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})", value):
        d, mo, y = int(m[1]), int(m[3]), int(m[4])
        y += 1900 if y < 100 else 0
    else:
        return False
    return 1900 <= y <= 2099 and 1 <= mo <= 12 and 1 <= d <= calendar.monthrange(y, mo)[1]


def _phone(value: str) -> bool:
    digits = _digits(value)
    return 7 <= len(digits) <= 15 and not luhn(digits) and bool(re.search(rf"[{P.WS_CHARS}./()+-]", value))


_VALID = (
    lambda v: bool(re.match(rf"^[^{P.WS_CHARS}@]+@[^{P.WS_CHARS}@]+\.[^{P.WS_CHARS}@]+$", v)),
    _iban,
    _card,
    lambda v: all(int(p) <= 255 for p in v.split(".")),
    lambda v: len(v.split(":")) == 8,
    _date,
    _phone,
)


def matches(text: str, number: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of each valid match of a pass, trimmed, left to right."""
    for m in _passes()[number][1].finditer(text):
        lead = len(m[0]) - len(re.sub(f"^{P.WS}+", "", m[0]))
        own = re.sub(f"{P.WS}+$", "", m[0][lead:])
        if _VALID[number](own):
            yield m.start() + lead, m.start() + lead + len(own), own


def detect(text: str, dedupe: bool = True) -> list[tuple[str, str, int, int]]:
    """(category, original, start, end) of each entity, by start."""
    out: list[tuple[str, str, int, int]] = []
    seen: set[tuple[str, str]] = set()
    for number, (category, _) in enumerate(P.PASSES):
        for start, end, own in matches(text, number):
            if (dedupe and (category, own) in seen) or any(start < b and end > a for _, _, a, b in out):
                continue
            seen.add((category, own))
            out.append((category, own, start, end))
    return sorted(out, key=lambda e: e[2])
