"""Detection of structured identifiers: seven passes of patterns and checksums, one fold over their candidates.

Passes run in order of priority and each scans left to right; a match counts if its value is valid, if
it overlaps nothing accepted before, and (dedupe) if its category and text weren't accepted before.
Sorting all candidates by pass and place and folding over them once is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import validators as V

CANDIDATE = "struct<pass:int,start:int,end:int,category:string,value:string>"
ENTITY = "struct<original:string,category:string,source:string,start:int,end:int,confidence:double>"


#: What each match of a pass contains, in patterns that cost far less than the pass itself.
_HINTS = (
    None,
    "[A-Z]{2}[0-9]{2}",
    "(?:[0-9][ -]?){12}[0-9]",
    r"[0-9]\.[0-9]",
    "[0-9A-Fa-f]:[0-9A-Fa-f]",
    "[0-9][./-][0-9]",
    # Six digits with a bracket, a separator and a bracket between two of them at most.
    rf"[0-9](?:\)?[{P.WS_CHARS}./-]?\(?[0-9]){{5}}",
)


def _hint(text: Column, i: int) -> Column:
    """A cheap test that a text must pass to hold a match of pass i."""
    return text.contains("@") if i == 0 else text.rlike(_HINTS[i])


@S.build_once
def pass_candidates(text: Column, i: int) -> Column:
    """Valid matches of pass i, trimmed, before any of the rules that look at other matches."""
    category, pattern = P.PASSES[i]
    raw = S.find(text, pattern)
    own = raw if i in (0, 1, 3, 4, 5) else F.transform(raw, lambda s: S.trim(s, P.WS))  # only cards and phones may end in a space
    valid = F.filter(own, lambda s: V.BY_PASS[i](s["value"]))
    made = F.transform(valid, lambda s: F.struct(F.lit(i).alias("pass"), s["start"].alias("start"), s["end"].alias("end"), F.lit(category).alias("category"), s["value"].alias("value")))
    return F.when(_hint(text, i), made).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


@S.build_once
def entities(text: Column, dedupe: bool = True) -> Column:
    """All entities of a text by start, as an array of ENTITY."""
    found = F.concat(*[pass_candidates(text, i) for i in range(len(P.PASSES))])
    same = (lambda kept, x: F.exists(kept, lambda k: (k["category"] == x["category"]) & (k["value"] == x["value"]))) if dedupe else None
    kept = S.let(found, lambda all_: F.when(F.size(all_) > 1, S.greedy(F.array_sort(all_), f"array<{CANDIDATE}>", same)).otherwise(all_))
    placed = F.array_sort(F.transform(kept, lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["category"].alias("category"), k["value"].alias("value"))))
    return F.transform(
        placed,
        lambda k: F.struct(k["value"].alias("original"), k["category"].alias("category"), F.lit("deterministic").alias("source"), k["start"].alias("start"), k["end"].alias("end"), F.lit(1.0).alias("confidence")),
    )


def has_long_run(text: Column) -> Column:
    """Whether a text must go through Python; most are too short to need the search."""
    return F.coalesce((F.length(text) >= 1000) & text.rlike(P.LONG_RUN), F.lit(False))


def _beside(df: DataFrame, text_col: str, name: str, plain: Column, scan: Callable[[str], list[dict]], kind: str, arrow: pa.DataType) -> DataFrame:
    """df with a column: plain, computed in the JVM, or what scan makes of the text in Python.

    Texts with a run of a thousand digits and separators would overflow the stack of Java's matcher;
    those alone go to Python, which gets a null for every other row.  One scan serves both.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scan(t) for t in texts.to_pylist()], arrow)

    own, away = S.fresh(df.columns, "own", "away")
    done = S.once(S.once(df, **{away: has_long_run(F.col(text_col))}), **{own: F.when(~F.col(away), plain)})
    columns = [F.col(f"`{c}`") for c in df.columns]
    # The name is made behind a generator, or filters above it would have Python scan once more.
    done = done.select(*columns, own, F.arrow_udf(run, f"array<{kind}>")(F.when(F.col(away), F.col(text_col))).alias(away))
    return S.once(done, **{name: F.coalesce(own, away, F.array().cast(f"array<{kind}>"))}).select(*columns, name)


_ENTITY = pa.list_(pa.struct([("original", pa.string()), ("category", pa.string()), ("source", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
_CANDIDATE = pa.list_(pa.struct([("pass", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("value", pa.string())]))


def with_entities(df: DataFrame, text_col: str = "text", dedupe: bool = True) -> DataFrame:
    """df with a column entities (array of ENTITY; empty for null texts)."""

    def scan(text: str) -> list[dict]:
        from ..functions.textscan import detect

        return [{"original": v, "category": c, "source": "deterministic", "start": a, "end": b, "confidence": 1.0} for c, v, a, b in detect(text, dedupe)]

    return _beside(df, text_col, "entities", entities(F.col(text_col), dedupe), scan, ENTITY, _ENTITY)


def with_candidates(df: DataFrame, *passes: int, text_col: str = "text") -> DataFrame:
    """df with a column found: the pass_candidates of each of the passes, one after the other."""

    def scan(text: str) -> list[dict]:
        from ..functions.textscan import matches

        return [{"pass": i, "start": a, "end": b, "category": P.PASSES[i][0], "value": v} for i in passes for a, b, v in matches(text, i)]

    return _beside(df, text_col, "found", F.concat(*[pass_candidates(F.col(text_col), i) for i in passes]), scan, CANDIDATE, _CANDIDATE)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dedupe: bool = True) -> DataFrame:
    """One row per entity: the id, original, category, source, start, end, confidence."""
    own = with_entities(df.select(id_col, text_col), text_col, dedupe)
    return own.select(id_col, F.inline("entities"))
