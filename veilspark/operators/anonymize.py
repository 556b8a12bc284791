"""The reversible path: detect, triage, propose, resolve, rewrite; and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import triage as T
from .detect import with_entities
from .gates import occurs_once, should_restore
from .mask import apply_mask, detector_spans, merge
from .model import Detector, propose
from .resolve import RESOLVED, proposed, resolve, structured
from .rewrite import rewrite


def _pairs(resolved: Column) -> Column:
    """(from, to) of resolved entities; of equal originals the last replacement, at the first one's place."""
    own = F.transform(resolved, lambda e: F.struct(e["original"].alias("from"), e["replacement"].alias("to")))
    names = lambda all_: F.array_distinct(F.transform(all_, lambda p: p["from"]))
    return S.let(own, lambda all_: F.transform(names(all_), lambda n: F.struct(n.alias("from"), F.element_at(F.filter(all_, lambda p: p["from"] == n), -1)["to"].alias("to"))))


def result(df: DataFrame, text_col: str, resolved_col: str) -> DataFrame:
    """df with output_text, replacements (array of from, to), has_pii and n_entities."""
    text = F.col(text_col)
    out = S.once(df, replacements=_pairs(F.col(resolved_col)))
    out = S.once(out, output_text=F.when(F.size("replacements") == 0, text).otherwise(rewrite(text, F.col("replacements"))))
    return out.withColumn("has_pii", F.col("output_text") != text).withColumn("n_entities", F.size(resolved_col))


def anonymize_structured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Pseudonyms for structured identifiers only: expressions from end to end."""
    own = with_entities(df, text_col)
    return result(S.once(own, resolved=structured(F.col("entities"))), text_col, "resolved").drop("entities", "resolved")


def anonymize(df: DataFrame, make: Callable[[], Detector] | None = None, text_col: str = "text", telemetry: bool = False) -> DataFrame:
    """df with output_text, replacements, has_pii, n_entities, decision, reason, analysis_status, fallback_reason and error.

    Only rows that triage sends to the model reach it.  Without a model, or when it fails, such a row
    has an error and no output: a raw text never passes for a result.  A timeout falls back on the
    structured entities and says 'partial'.
    """
    names = df.columns
    own = T.with_decision(with_entities(df, text_col), text_col)
    none = F.array().cast(f"array<{RESOLVED}>")
    asks = F.col("decision") == "needs_ai"
    if make is None:
        empty = {"chunk_count": 0, "quota_retries": 0, "timeouts": 0, "char_limit": None}
        own = own.withColumns({"analysis_status": F.when(asks, "error").otherwise("complete"), "fallback_reason": F.when(asks, "ai_unavailable"), "error": F.when(asks, "ai_unavailable"), **{k: F.lit(v).cast("int") for k, v in empty.items()}, "_found": F.lit(None).cast(f"array<{RESOLVED}>")})
    else:
        # One scan serves all rows; those that need no model pass through Python as they are.
        got = propose(own.withColumn("_asks", asks), make, text_col, asks_col="_asks")
        timed = (F.col("analysis_status") == "partial") & (F.col("fallback_reason") == "timeout") & (F.size("proposed") == 0)
        both = F.when(F.col("_asks"), F.concat(proposed(F.col("entities")), F.coalesce("proposed", F.array().cast(dict(got.dtypes)["proposed"]))))
        # A timeout of a single call without structured entities is an error; with them they are the result.
        got = got.withColumn("error", F.when(timed & (F.size("entities") == 0), F.lit("timeout")).otherwise(F.col("error"))).withColumn("_all", both)
        own = resolve(got, text_col, "_all", "_asks").withColumnRenamed("resolved", "_found").drop("_all", "_asks", "proposed")
    own = S.once(own, resolved=F.when(F.col("decision") == "deterministic_only", structured(F.col("entities"))).otherwise(F.coalesce("_found", none)))
    every = result(own, text_col, "resolved")
    every = every.withColumn("output_text", F.when(F.col("error").isNull(), F.col("output_text"))).withColumn("has_pii", F.col("error").isNull() & F.col("has_pii"))
    extra = ["chunk_count", "quota_retries", "timeouts", "char_limit"] if telemetry else []
    return every.select(*names, "output_text", "replacements", "has_pii", "n_entities", "decision", "reason", "analysis_status", "fallback_reason", "error", *extra)


def remask(df: DataFrame, text_col: str = "text", shown_col: str = "shown_text") -> DataFrame:
    """After a partial result: the masked text put in the place of the pseudonymised one, if that stands in shown_text once.

    Refused where masking changes nothing, the result wasn't partial or the place isn't unique.
    """
    own = with_entities(df, text_col, dedupe=False)
    own = S.once(own, _masked=apply_mask(F.col(text_col), merge(detector_spans(F.col("entities")))))
    masked = F.col("_masked")
    ok = (F.col("analysis_status") == "partial") & (masked != F.col(text_col)) & occurs_once(F.col(shown_col), F.col("output_text"))
    ok = F.coalesce(ok, F.lit(False))
    return own.select(*df.columns, ok.alias("remasked"), F.when(ok, F.replace(F.col(shown_col), F.col("output_text"), masked)).otherwise(F.col(shown_col)).alias("remasked_text"))


def dispatch(df: DataFrame) -> DataFrame:
    """What to do with a result: manual decision or error block it, partial and found results are put in with their mappings, else the text itself."""
    kind = (
        F.when(F.col("analysis_status").isNull() & F.col("error").isNull(), "blocked")
        .when(F.coalesce(F.col("manual_decision_reason"), F.lit("")) != "", "manual_decision")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("analysis_status") == "partial", "partial")
        .when(F.col("has_pii"), "replaced")
        .otherwise("identity")
    )
    emit = ~kind.isin("blocked", "manual_decision", "error")
    return df.withColumn("outcome", kind).withColumn("emit", emit).withColumn("output_text", F.when(emit, F.col("output_text")))


def mappings(df: DataFrame, key: str, touched: Column) -> DataFrame:
    """Rows of a mapping store: key, fake, original, touched_at."""
    return df.filter(F.size("replacements") > 0).select(key, F.explode("replacements").alias("r"), touched.alias("touched_at")).select(key, F.col("r.to").alias("fake"), F.col("r.from").alias("original"), "touched_at")


def restore(df: DataFrame, store: DataFrame, key: str, text_col: str = "text", ignore_case: bool = False) -> DataFrame:
    """df with restored_text and changed: the key's synthetic values turned back.

    A key's mappings meet its texts by one equi-join; a later row for the same synthetic value wins.
    Texts of fewer than five characters stay as they are.
    """
    last = store.groupBy(key, "fake").agg(F.max_by("original", "touched_at").alias("original"))
    lists = last.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("fake").alias("from"), F.col("original").alias("to")))).alias("_pairs"))
    text = F.col(text_col)
    joined = df.join(lists, df[key] == F.col("_key"), "left")
    turned = F.when(F.col("_pairs").isNotNull() & should_restore(text), rewrite(text, F.col("_pairs"), ignore_case)).otherwise(text)
    out = S.once(joined, restored_text=turned)
    return out.select(*df.columns, "restored_text", F.coalesce(F.col("restored_text") != text, F.lit(False)).alias("changed"))
