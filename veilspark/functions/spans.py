"""Spans as arrays of structs: find, merge and rewrite without leaving the JVM.

Offsets count code points from 0, ends are exclusive.  Spark has no function that finds all matches
with their places; the pieces between matches and the matches themselves give them by running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda variable stands for it wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_BUILT: dict[tuple, tuple[object, Column]] = {}


def build_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """make, whose result for the same plain columns and options is built once: a large expression takes seconds to put together, and it holds no data."""

    def key_of(x: object) -> object:
        if not isinstance(x, Column):
            return x
        own = getattr(x, "_jc", None)
        return ("column", repr(x)) if own is not None and own.node().getClass().getSimpleName() == "UnresolvedAttribute" else None

    @wraps(make)
    def own(*args, **options) -> Column:
        gateway = SparkContext._gateway
        key = (make.__module__, make.__qualname__, id(gateway), *map(key_of, args), *((k, key_of(v)) for k, v in sorted(options.items())))
        if gateway is None or any(isinstance(x, Column) and key_of(x) is None for x in (*args, *options.values())):
            return make(*args, **options)
        if key not in _BUILT:
            _BUILT[key] = gateway, make(*args, **options)
        return _BUILT[key][1]

    return own


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with so many underscores in front that it is none of those taken (whose case Spark ignores)."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once and not copied into filters or expressions above: a generator is a barrier to the optimizer."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def find(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, left to right, as an array of (start, end, value)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        end = at + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(at.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
        # Texts without a match, most of them, skip the fold.
        return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(none)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def trim(span: Column, ws: str) -> Column:
    """A span without white space at its ends."""
    value = span["value"]
    lead = F.length(F.regexp_extract(value, f"^{ws}*", 0))
    own = F.regexp_replace(F.regexp_replace(value, f"^{ws}+", ""), f"{ws}+$", "")
    return F.struct((span["start"] + lead).alias("start"), (span["start"] + lead + F.length(own)).alias("end"), own.alias("value"))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def overlaps_any(span: Column, taken: Column) -> Column:
    return F.exists(taken, lambda x: overlap(x, span))


def greedy(ordered: Column, kind: str, also: Callable | None = None) -> Column:
    """Of spans in order of preference those that overlap none kept before them; also(kept, span) may reject more."""

    def step(kept: Column, x: Column) -> Column:
        no = overlaps_any(x, kept)
        if also is not None:
            no = no | also(kept, x)
        return F.when(no, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(ordered, F.array().cast(kind), step)


def forward(ordered: Column, kind: str) -> Column:
    """Of spans sorted by start those that begin at or after the end of the one kept last."""
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, x: F.when((F.size(kept) > 0) & (x["start"] < F.element_at(kept, -1)["end"]), kept).otherwise(F.array_append(kept, x)))


def splice(text: Column, spans: Column, value) -> Column:
    """text with each span, sorted and disjoint, replaced by value(span)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), value(x)).alias("out"))

    whole = lambda own: F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return let(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(whole(own)))


def blank(text: Column, spans: Column) -> Column:
    """text with each valid span overwritten by spaces; its length stays."""
    whole_in = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))
    valid = F.array_sort(F.transform(whole_in, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        at, end = F.greatest(a["at"], x["start"]), F.greatest(a["at"], x["end"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, at - a["at"]), F.repeat(F.lit(" "), end - at)).alias("out"))

    whole = lambda own: F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return let(valid, lambda own: F.when(F.size(own) == 0, text).otherwise(whole(own)))
