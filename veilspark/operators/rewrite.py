"""Rewriting by a map of values: entries, spans chosen on the original text, one splice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S

ENTRY = "struct<from:string,to:string>"
CHOICE = "struct<start:int,end:int,replacement:string,from:string>"
_WORDS = rf"^[\p{{L}}\p{{N}}{P.WS_CHARS}\-]+$"
_NAME = r"^[\p{L}\-]+$"


def entries(pairs: Column) -> Column:
    """From an array of (from, to): the pairs and, for names of equally many parts, their parts; longest first."""
    full = F.filter(pairs, lambda p: F.coalesce((p["from"] != "") & (p["to"] != ""), F.lit(False)))

    def with_parts(p: Column) -> Column:
        return S.let(F.struct(p["from"].alias("from"), p["to"].alias("to"), F.split(p["from"], f"{P.WS}+", -1).alias("a"), F.split(p["to"], f"{P.WS}+", -1).alias("b")), parted)

    def parted(p: Column) -> Column:
        parts = F.zip_with(p["a"], p["b"], lambda x, y: F.struct(x.alias("from"), y.alias("to")))
        good = F.filter(parts, lambda x: F.coalesce((F.length(x["from"]) >= 3) & (F.length(x["to"]) >= 2) & x["from"].rlike(_NAME) & x["to"].rlike(_NAME), F.lit(False)))
        alone = F.array(F.struct(p["from"].alias("from"), p["to"].alias("to")))
        return F.when((F.size(p["a"]) == F.size(p["b"])) & (F.size(p["a"]) >= 2), F.concat(alone, good)).otherwise(alone)

    flat = F.flatten(F.transform(full, with_parts))
    keyed = F.array_sort(F.transform(flat, lambda e, i: F.struct((-F.length(e["from"])).alias("n"), i.alias("i"), e["from"].alias("from"), e["to"].alias("to"))))
    return F.transform(keyed, lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to")))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def choose(text: Column, entry_list: Column, ignore_case: bool = True) -> Column:
    """Spans to replace: word-like values at word boundaries with up to two more letters, others wherever they stand.

    By start, then longer, then earlier entry; each begins at or after the end of the one before.
    """
    flags = "(?iu)" if ignore_case else ""

    def of_entry(e: Column, i: Column) -> Column:
        word = F.concat(F.lit(flags + r"(?<=^|[^\p{L}\p{N}_])"), _quoted(e["from"]), F.lit(r"(\p{L}{0,2})(?=$|[^\p{L}\p{N}_])"))
        near = F.lower(text).contains(F.lower(e["from"])) if ignore_case else text.contains(e["from"])
        words = F.transform(S.find(text, word), lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), i.alias("entry"), s["end"].alias("end"), F.concat(e["to"], F.substring(s["value"], F.length(e["from"]) + 1, F.lit(2))).alias("replacement"), e["from"].alias("from")))
        plain = F.transform(S.find(text, _quoted(e["from"])), lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), i.alias("entry"), s["end"].alias("end"), e["to"].alias("replacement"), e["from"].alias("from")))
        none = F.array().cast("array<struct<start:int,short:int,entry:int,end:int,replacement:string,from:string>>")
        # Most entries aren't in most places; a plain search costs less than a pattern.
        return F.when(~near, none).when(e["from"].rlike(_WORDS), words).otherwise(plain)

    every = F.array_sort(F.flatten(F.transform(entry_list, of_entry)))
    slim = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement"), s["from"].alias("from")))
    return S.forward(slim, f"array<{CHOICE}>")


@S.build_once
def rewrite(text: Column, pairs: Column, ignore_case: bool = True) -> Column:
    """text with all values of pairs (array of from, to) replaced at once; what is put in is not replaced again."""
    return S.splice(text, choose(text, entries(pairs), ignore_case), lambda s: s["replacement"])
