"""Signals that a short text may hold more than structured identifiers (H1 to H9), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from . import spans as S

_TOKEN = P.java(r"\b[\p{L}'’-]{2,}\b")
_CAPITAL = P.java(r"\b\p{Lu}[\p{L}'’-]{1,}\b")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iu)" + P.java(pattern))


def strip_token(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def all_caps(token: Column) -> Column:
    return (F.upper(token) == token) & (F.lower(token) != token)


def title_case(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}[\p{L}'’-]{1,}$") & ~all_caps(token)


def known_first_name(text: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.lower(strip_token(t)))
    return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in P.FIRST_NAMES]))


def multi_part_name(text: Column) -> Column:
    """Two tokens with nothing but white space between them, the first in title case, the second too or a particle."""
    tokens = F.transform(S.find(text, _TOKEN), lambda s: F.struct(s["start"].alias("start"), strip_token(s["value"]).alias("token")))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def name(p: Column) -> Column:
        end = p["a"]["start"] + F.length(p["a"]["token"])
        between = F.substring(text, end + 1, F.greatest(p["b"]["start"] - end, F.lit(0)))
        follows = title_case(p["b"]["token"]) | F.lower(p["b"]["token"]).isin(*P.PARTICLES)
        return between.rlike(f"^{P.WS}+$") & title_case(p["a"]["token"]) & follows

    return F.exists(pairs, name)


def mid_sentence_capital(text: Column) -> Column:
    def inside(s: Column) -> Column:
        token = strip_token(s["value"])
        before = F.regexp_replace(F.substring(text, F.lit(1), s["start"]), rf"[{P.WS_CHARS}\"'(\[{{]+$", "")
        opens = (before == "") | before.rlike(r"[.!?。！？:;]$")
        return (token != "") & ~all_caps(token) & ~opens

    return F.exists(S.find(text, _CAPITAL), inside)


def risk_signals(text: Column) -> Column:
    """Names of the signals of a text whose entities are blanked, in a fixed order."""
    return S.let(text, _signals)


def _signals(text: Column) -> Column:
    rules = (
        ("honorific", _has(text, P.HONORIFIC)),
        ("address", _has(text, P.ADDRESS)),
        ("company", _has(text, P.COMPANY)),
        ("id_context", _has(text, P.ID_CONTEXT) | _has(text, P.ID_VALUE)),
        ("known_first_name", known_first_name(text)),
        ("multi_part_name", multi_part_name(text)),
        ("mid_sentence_capitalized_token", mid_sentence_capital(text)),
    )
    return F.filter(F.array(*[F.when(on, F.lit(name)) for name, on in rules]), lambda x: x.isNotNull())


def low_risk(text: Column) -> Column:

    def any_of(own: Column) -> Column:
        out = _has(own, P.LOW_RISK[0])
        for p in P.LOW_RISK[1:]:
            out = out | _has(own, p)
        return out

    return S.let(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"{P.WS}+", " "), "^ ", ""), " $", ""), any_of)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{P.WS}+", ""), f"{P.WS}+$", "")


def lines(trimmed: Column) -> Column:
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\r\n|\r|\n", -1)))


@S.build_once
def decide(text: Column, entities: Column) -> Column:
    """(decision, reason, risk_signals) for a text and its entities (spans with start and end)."""
    none = F.array().cast("array<string>")
    answer = lambda d, r, s=none: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"), s.alias("risk_signals"))

    def sized(x: Column) -> Column:
        large = (F.length(x["trimmed"]) > P.BYPASS_CHARS) | (lines(x["trimmed"]) > P.BYPASS_LINES)
        # CASE stops at the first branch that holds: the signals are computed for short texts only.
        return (
            F.when(x["trimmed"] == "", answer("safe_skip_ai", "empty"))
            .when(large, answer("needs_ai", "too_large_for_bypass"))
            .otherwise(S.let(risk_signals(S.blank(x["text"], entities)), lambda signals: judged(x, signals)))
        )

    def judged(x: Column, signals: Column) -> Column:
        return (
            F.when(F.size(signals) > 0, answer("needs_ai", "open_semantic_risk", signals))
            .when(F.size(entities) > 0, answer("deterministic_only", "structured_pii_only"))
            .when(low_risk(x["trimmed"]), answer("safe_skip_ai", "explicit_low_risk_snippet"))
            .otherwise(answer("needs_ai", "not_explicitly_low_risk"))
        )

    return S.let(F.struct(F.coalesce(text, F.lit("")).alias("text"), strip(F.coalesce(text, F.lit(""))).alias("trimmed")), sized)


def with_decision(df: DataFrame, text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """df with decision, reason and risk_signals, from a text column and its entities, computed once."""
    return S.once(df, _triage=decide(F.col(text_col), F.col(entities_col))).select(*df.columns, "_triage.*")
