"""Names, addresses and companies, and the resolution of a document's entities, on plain Python values.

These rules look at tokens in sequence and at earlier decisions, which column expressions can't state
clearly.  operators.resolve applies them to Arrow batches, and only to documents with such entities.
"""

from __future__ import annotations

import re
from functools import lru_cache

from . import patterns as P

_LETTER = r"[^\W\d_]"


def _word(ascii_pattern: str) -> str:
    """A pattern with ASCII word boundaries for a matcher whose \\b follows all letters."""
    return P.java(ascii_pattern).replace(P.B, r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))").replace(r"\d", "[0-9]")


@lru_cache(None)
def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(_word(pattern), flags)


# -- seeds -----------------------------------------------------------------------------------------


def seed(value: str) -> int:
    """The seed of functions.synthetic, over UTF-16 units."""
    h = 0x811C9DC5
    raw = value.encode("utf-16-le", "surrogatepass")
    for low, high in zip(raw[::2], raw[1::2]):
        h = (h ^ (high << 8 | low)) * 0x01000193 & 0xFFFFFFFF
    return h


def hash36(value: str) -> str:
    n, out = seed(value), ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out.rjust(7, "0")


def pick(values, key: str):
    return values[seed(key) % len(values)]


# -- names -----------------------------------------------------------------------------------------


def strip_edges(value: str) -> str:
    """Without what is neither letter nor digit at its ends; a full stop may end it."""
    a, b = 0, len(value)
    alnum = lambda c: c.isalpha() or c.isnumeric()
    while a < b and not alnum(value[a]):
        a += 1
    while b > a and not (alnum(value[b - 1]) or value[b - 1] == "."):
        b -= 1
    return value[a:b]


def name_token(part: str) -> str:
    return strip_edges(re.sub(rf"\.(?:{P.IMAGE})$", "", strip_edges(part), flags=re.I))


def plausible(part: str) -> bool:
    token = name_token(part)
    low = token.lower()
    if not token or low in P.NOT_NAMES or re.fullmatch(P.IMAGE, token, re.I) or re.search("[0-9]", token):
        return False
    if low in P.PARTICLES or re.fullmatch(rf"{_LETTER}\.", token):
        return True
    if "-" in token:
        return all(s and plausible(s) for s in token.split("-"))
    return bool(re.fullmatch(rf"{_LETTER}(?:{_LETTER}|['’])*", token))


def title(token: str) -> tuple[str, str] | None:
    """Gender and locale of a form of address."""
    low = strip_edges(token).lower()
    return next(((g, where) for forms, g, where in P.TITLES if low in forms), None)


def name_parts(parts: list[str]) -> list[str]:
    out: list[str] = []
    for part in parts:
        token = name_token(part)
        if not token:
            continue
        if len(out) >= 2 and re.fullmatch("[A-ZÄÖÜ]{2,}", token):
            break
        if plausible(token):
            out.append(token)
        elif out:
            break
    return out


def normalize_name(value: str | None) -> str:
    parts = (value or "").split()
    if not parts:
        return ""
    lead = parts[:1] if title(parts[0]) else []
    body = name_parts(parts[len(lead) :])
    return " ".join(lead + body) if body else ""


def name_key(value: str | None) -> str:
    parts = normalize_name(value).split()
    if parts and title(parts[0]):
        parts = parts[1:]
    return " ".join(x for x in (strip_edges(p).lower() for p in parts) if x)


def locale(value: str) -> str:
    for where, letters, words in P.LOCALE_RULES:
        if (letters and re.search(letters, value, re.I)) or _re(words, re.I).search(value):
            return where
    return "en"


def gender(token: str, where: str) -> str:
    low = strip_edges(token).lower()
    own = P.NAMES.get(where, P.NAMES["en"])
    has = lambda names: any(n.lower() == low for n in names)
    if has(own[1]):
        return "female"
    if has(own[0]):
        return "male"
    if any(has(n[1]) for n in P.NAMES.values()):
        return "female"
    return "male" if any(has(n[0]) for n in P.NAMES.values()) else "neutral"


def case_like(template: str, value: str) -> str:
    return value.upper() if template.upper() == template and template.lower() != template else value


def _map_part(part: str, i: int, n: int, sex: str, where: str, key: str) -> str:
    male, female, neutral, last = P.NAMES.get(where, P.NAMES["en"])
    first = {"female": female, "male": male}.get(sex, neutral)
    if part.lower() in P.PARTICLES:
        return case_like(part, part.lower())
    if "-" in part:
        return "-".join(_map_part(s, i, n, sex, where, f"{key}:hyphen:{i}:{j}") if s else s for j, s in enumerate(part.split("-")))
    if re.fullmatch(rf"{_LETTER}\.", part):
        own = pick(last, f"{key}:initial:last:{i}") if i == n - 1 and n > 1 else pick(first, f"{key}:initial:first:{i}")
        return own[0].upper() + "."
    low = strip_edges(part).lower()
    given = n == 1 and any(x.lower() == low for x in (*male, *female, *neutral))
    return case_like(part, pick(first, f"{key}:first:{i}") if i == 0 and (n > 1 or given) else pick(last, f"{key}:last:{i}"))


def fake_name(original: str, key: str) -> str:
    whole = normalize_name(original)
    if not whole:
        return generic(original)
    parts = whole.split()
    known = title(parts[0])
    body = parts[1:] if known else parts
    where = known[1] if known else locale(whole)
    outside = key and key != original and not key.startswith(f"{original}#")
    own = key if outside else name_key(whole) or key
    if not body:
        return parts[0]
    sex = known[0] if known else gender(body[0], where)
    made = [_map_part(p, i, len(body), sex, where, own) for i, p in enumerate(body)]
    return " ".join(([parts[0]] if known else []) + made)


# -- addresses and companies -----------------------------------------------------------------------


def country(value: str) -> str:
    for where, loose, exact in P.COUNTRY_RULES:
        if any(_re(p, re.I).search(value) for p in loose) or any(_re(p).search(value) for p in exact):
            return where
    own = locale(value)
    return own if own != "en" else "us"


def fake_address(original: str, key: str) -> str:
    where = country(original)
    entries, (native, english, code) = P.ADDRESSES[where]
    street, number, postal, city, state = pick(entries, f"{key}:address")
    line = f"{number} {street}" if where in ("us", "uk") else f"{street} {number}"
    place = f"{city}, {state} {postal}" if where == "us" else f"{city} {postal}" if where == "uk" else f"{postal} {city}"
    label = next((x for x, flags in ((native, re.I), (english, re.I), (code, 0)) if _re(rf"\b{re.escape(x)}\b", flags).search(original)), "")
    if not re.search(r"[,\n]", original) and not re.search("[0-9]{4,5}", original):
        return line
    return ("\n" if "\n" in original else ", ").join(x for x in (line, place, label) if x)


def legal_form(value: str) -> tuple[str, str] | None:
    """The legal form that ends a company's name, and its locale."""
    for pattern, where in P.LEGAL_FORMS:
        if m := _re(pattern.removesuffix("$") + r"\Z", re.I).search(value):
            return m[0], where
    return None


def fake_company(original: str, key: str) -> str:
    form = legal_form(original)
    base = pick(P.COMPANIES[form[1] if form else locale(original)], f"{key}:company")
    return f"{base} {form[0]}" if form else base


# -- structured values (the same rules as functions.synthetic, for the sequential steps) ------------


def mod97(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value)) % 97


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _refill(original: str, digits: str) -> str:
    own = iter(digits)
    return "".join(next(own, "0") if c in "0123456789" else c for c in original)


def fake_iban(original: str, key: str) -> str:
    bban = P.BANK + str(seed(key) % 10**10).rjust(10, "0")
    whole = f"DE{98 - mod97(bban + 'DE00'):02d}{bban}"
    return " ".join(re.findall(".{1,4}", whole)) if re.search(P.WS, original) else whole


def fake_card(original: str, key: str) -> str:
    n = min(max(len(_digits(original)), 13), 19)
    body = ("4" + str(seed(key)).ljust(n, "0"))[: n - 1]
    return _refill(original, next(body + d for d in "0123456789" if luhn(body + d)))


def fake_phone(original: str, key: str) -> str:
    digits = _digits(original)
    code = ""
    if original.strip().startswith("+"):
        code = next((c for c in P.CALLING_CODES if digits.startswith(c) and len(digits) - len(c) >= 6), digits[: min(3, max(len(digits) - 6, 1))])
    own = ((P.DIGITS + str(seed(key))) * 2)[: max(len(digits) - len(code), 0)]
    return _refill(original, (code + own)[: len(digits)])


def fake_ip(original: str, key: str) -> str:
    return f"2001:db8::{seed(key) % 65535:x}" if ":" in original else f"203.0.113.{seed(key) % 254 + 1}"


def fake_date(original: str, key: str) -> str:
    day, month = f"{seed(key) % 27 + 1:02d}", f"{seed(key + ':month') % 12 + 1:02d}"
    if re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", original):
        return f"1988-{month}-{day}"
    m = re.fullmatch(r"[0-9]{1,2}([./-])[0-9]{1,2}\1([0-9]{2}|[0-9]{4})", original)
    mark, year = (m[1], "88" if len(m[2]) == 2 else "1988") if m else (".", "1988")
    return f"{day}{mark}{month}{mark}{year}"


def fake_pattern(original: str, key: str) -> str:
    digits, out, d, u, low = (P.DIGITS + str(seed(key))) * 3, [], 0, 0, 0
    for c in original:
        if c in "0123456789":
            out.append(digits[d] if d < len(digits) else "0")
            d += 1
        elif "A" <= c <= "Z":
            out.append(P.UPPER[(u + seed(key)) % len(P.UPPER)])
            u += 1
        elif "a" <= c <= "z":
            out.append(P.LOWER[(low + seed(key + ":lower")) % len(P.LOWER)])
            low += 1
        else:
            out.append(c)
    return "".join(out)


def generic(original: str, key: str | None = None) -> str:
    return f"Redacted-{hash36(key or original)[:6]}"


def fake_email(original: str, key: str) -> str:
    return f"person-{hash36(key)[:6]}@example.invalid"


FAKES = {
    "email": fake_email,
    "iban": fake_iban,
    "credit_card": fake_card,
    "phone": fake_phone,
    "ip_address": fake_ip,
    "date": fake_date,
    "name": fake_name,
    "address": fake_address,
    "company": fake_company,
    "national_id": fake_pattern,
    "passport": fake_pattern,
    "driver_license": fake_pattern,
    "medical_record": fake_pattern,
}


def fallback(original: str, category: str, key: str = "", variant: int = 0) -> str:
    own = (key or original) + (f"#{variant}" if variant else "")
    return FAKES.get(category, generic)(original, own)


def in_context(original: str, category: str, proposed: str = "", key: str = "", variant: int = 0) -> str:
    """The proposal for what has no better category; else a synthetic value, the proposal, or a generic one."""
    offer = (proposed or "").strip()
    offer = "" if original in offer else offer
    if category == "other" and offer:
        return offer
    made = fallback(original, category, key, variant)
    if made and original not in made:
        return made
    return offer or generic(original, (key or original) + (f"#{variant}" if variant else ""))


# -- resolution of a document's entities -----------------------------------------------------------


def locate(text: str, original: str, start: int | None, end: int | None) -> tuple[int, int] | None:
    """Where an entity stands: at the hint, inside it, first exact place, first place in any case, or nowhere."""
    if start is not None and end is not None and 0 <= start < end <= len(text):
        hint = text[start:end]
        if hint == original or hint.lower() == original.lower():
            return start, end
        if (at := hint.find(original)) >= 0:
            return start + at, start + at + len(original)
    if (at := text.find(original)) >= 0:
        return at, at + len(original)
    m = re.search(re.escape(original), text, re.I)
    return m.span() if m else None


def entity_key(category: str, original: str) -> str:
    if category == "name":
        own = name_key(original)
        return f"name:{own}" if own else ""
    return f"{category}:{original.lower() if category == 'email' else original}"


def name_case(value: str) -> int:
    score = 0
    for part in normalize_name(value).split():
        if re.fullmatch(rf"[A-ZÄÖÜ](?:{_LETTER}|['’-])*", part):
            score += 2
        elif re.fullmatch(rf"(?:{_LETTER}|['’-])+", part):
            score += 1
    return score


def normalize_entity(text: str, e: dict) -> dict | None:
    category = e.get("category") if e.get("category") in P.CATEGORIES else "other"
    raw = (e.get("original") or "").strip()
    own = normalize_name(raw) if category == "name" else raw
    place = locate(text, own, e.get("start"), e.get("end")) if own else None
    if place is None:
        return None
    original = text[place[0] : place[1]]
    key = entity_key(category, original)
    made = in_context(original, category, (e.get("replacement") or "").strip(), key)
    if not made or original in made:
        return None
    return {"original": original, "replacement": made, "category": category, "key": key or f"{category}:{original}", "source": e.get("source") or "ai", "start": place[0], "end": place[1], "confidence": e.get("confidence")}


def preference(e: dict) -> tuple:
    """Larger is better; the first of equals stays."""
    return (2 if e["source"] == "deterministic" else 1, name_case(e["original"]), e["confidence"] or 0.0, -e["start"])


def unique_replacements(entities: list[dict]) -> list[dict]:
    used: dict[str, str] = {}
    out = []
    for e in entities:
        made, variant = e["replacement"], 0
        while made in used and used[made] != e["key"]:
            variant += 1
            made = in_context(e["original"], e["category"], e["replacement"], e["key"], variant)
            if not made or e["original"] in made:
                made = fallback(e["original"], e["category"], "", variant)
            if variant > 8 and made in used and used[made] != e["original"]:
                made = f"{made} {variant + 1}"
        used[made] = e["key"]
        out.append({**e, "replacement": made})
    return out


def resolve(text: str, entities: list[dict]) -> list[dict]:
    """One entity for each key, the preferred one, longest first, with replacements that differ."""
    best: dict[str, dict] = {}
    for e in entities:
        own = normalize_entity(text, e)
        if own and (own["key"] not in best or preference(own) > preference(best[own["key"]])):
            best[own["key"]] = own
    return unique_replacements(sorted(best.values(), key=lambda e: (-len(e["original"]), e["start"])))
