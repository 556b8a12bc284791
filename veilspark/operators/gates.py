"""Gates and small predicates over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.triage import strip
from ..functions.validators import micros


def should_scan(text: Column) -> Column:
    """Whether a text is worth a scan: any of ten characters or more; a shorter one if a quick pattern is in it."""
    own = strip(F.coalesce(text, F.lit("")))
    quick = own.rlike(P.QUICK[0])
    for p in P.QUICK[1:]:
        quick = quick | own.rlike(p)
    return F.when(own == "", False).when(F.length(own) >= P.SCAN_FROM, True).otherwise(quick)


def should_restore(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= P.RESTORE_FROM


def is_copy_control(*descriptors: Column) -> Column:
    """Whether the joined descriptors of a control name copying."""
    parts = F.filter(F.array(*descriptors), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, " ").rlike("(?i)" + P.java(P.COPY_CONTROL))


def is_copy_shortcut(key: Column, ctrl: Column, meta: Column, alt: Column) -> Column:
    low = F.lower(F.coalesce(key, F.lit("")))
    return ~alt & (((low == "c") & (ctrl | meta)) | ((low == "insert") & ctrl & ~meta))


def is_quota_error(name: Column, code: Column, message: Column) -> Column:
    own = lambda c: F.coalesce(c, F.lit(""))
    return (own(name) == "QuotaExceededError") | (own(code) == "QuotaExceededError") | own(message).rlike("(?i)quota")


def occurs_once(text: Column, needle: Column) -> Column:
    """Whether the needle stands in the text exactly once, not counting overlaps."""
    n = F.length(needle)
    return (n > 0) & ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) == n)


def replace_unique(text: Column, needle: Column, value: Column) -> Column:
    return F.when(occurs_once(text, needle), F.replace(text, needle, value)).otherwise(text)


def honoured_writes(events: DataFrame, key: str, ts: str, kind: str, intent: str, write: str, window_ms: int = P.COPY_WINDOW_MS) -> DataFrame:
    """Writes with the last intent of their key at or before them, and whether that is window_ms old at most.

    The running maximum needs one shuffle by key and a sort; nothing is joined.  Of equal times an intent counts first.
    """
    first = F.when(F.col(kind) == intent, 0).otherwise(1)
    upto = Window.partitionBy(key).orderBy(ts, first).rowsBetween(Window.unboundedPreceding, 0)
    own = events.filter(F.col(kind).isin(intent, write)).withColumn("intent_ts", F.max(F.when(F.col(kind) == intent, F.col(ts))).over(upto))
    age = micros(ts) - micros("intent_ts")
    return own.filter(F.col(kind) == write).withColumn("honoured", F.coalesce(age <= window_ms * 1000, F.lit(False)))
