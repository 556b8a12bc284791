"""One-way masking: spans from detectors and models are merged by priority and replaced by placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from .detect import with_entities

MASK = "struct<start:int,end:int,category:string,source:string>"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def mask_category(category: Column) -> Column:
    return F.try_element_at(_map(P.MASK_OF_CATEGORY), category)


def label_category(label: Column) -> Column:
    """The mask category of a model's label, with or without its B-, I-, E- or S-."""
    return F.try_element_at(_map(P.MASK_OF_LABEL), F.trim(F.regexp_replace(label, "^[BIES]-", "")))


def placeholder(category: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(P.PLACEHOLDERS), category), F.lit(P.PLACEHOLDERS["secret"]))


def source_priority(source: Column) -> Column:
    return F.when(source == "deterministic", 0).when(source == "model", 1).otherwise(2)


def normalize(spans: Column) -> Column:
    """Valid spans with a category; a missing source is 'unknown', a missing start 0."""
    own = F.transform(spans, lambda s: F.struct(F.coalesce(s["start"], F.lit(0)).alias("start"), s["end"].alias("end"), F.trim(s["category"]).alias("category"), F.coalesce(F.when(s["source"] != "", s["source"]), F.lit("unknown")).alias("source")))
    return F.filter(own, lambda s: F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["category"] != ""), F.lit(False)))


def merge(*groups: Column) -> Column:
    """Spans kept greedily: deterministic before model before other, then by start, longer first, by category."""
    every = normalize(groups[0]) if len(groups) == 1 else F.concat(*[normalize(g) for g in groups])

    def chosen(own: Column) -> Column:
        keyed = F.array_sort(F.transform(own, lambda s: F.struct(source_priority(s["source"]).alias("p"), s["start"].alias("start"), (s["start"] - s["end"]).alias("short"), s["category"].alias("category"), s["end"].alias("end"), s["source"].alias("source"))))
        ordered = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["source"].alias("source")))
        return F.when(F.size(own) > 1, F.array_sort(S.greedy(ordered, f"array<{MASK}>"))).otherwise(own)

    return S.let(every, chosen)


def apply_mask(text: Column, merged: Column) -> Column:
    return S.splice(text, merged, lambda s: placeholder(s["category"]))


def detector_spans(entities: Column) -> Column:
    """Mask spans of detector entities; categories without a mask category drop out."""
    own = F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), mask_category(e["category"]).alias("category"), F.lit("deterministic").alias("source")))
    return F.filter(own, lambda s: s["category"].isNotNull())


def model_spans(spans: Column, text: Column) -> Column:
    """Mask spans of a model's (label, start, end); unknown labels and spans outside of the text drop out."""
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label_category(s["label"]).alias("category"), F.lit("model").alias("source")))
    return F.filter(own, lambda s: s["category"].isNotNull() & (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))


def summary(merged: Column) -> Column:
    """How many spans each category has, as a map."""
    names = F.array_sort(F.array_distinct(F.transform(merged, lambda s: s["category"])))
    return F.map_from_entries(F.transform(names, lambda c: F.struct(c.alias("key"), F.size(F.filter(merged, lambda s: s["category"] == c)).alias("value"))))


def mask(df: DataFrame, text_col: str = "text", dedupe: bool = False, spans_col: str | None = None, require_model: bool = False) -> DataFrame:
    """df with output_text, has_pii, n_entities, categories and manual_decision_reason.

    spans_col holds a model's spans (array of label, start, end, score).  With require_model, a row
    whose spans are null was not analysed: its output is null and the reason says so; raw text never
    stands in for a result.
    """
    own = with_entities(df, text_col, dedupe)
    text = F.col(text_col)
    groups = [detector_spans(F.col("entities"))]
    if spans_col:
        groups.append(model_spans(F.coalesce(F.col(spans_col), F.array().cast(dict(df.dtypes)[spans_col])), text))
    out = S.once(own, _spans=merge(*groups))
    out = S.once(out, _masked=apply_mask(text, F.col("_spans")))
    blocked = F.col(spans_col).isNull() if spans_col and require_model else F.lit(bool(require_model and not spans_col))
    shown = lambda c: F.when(~blocked, c)
    return out.select(
        *[F.col(c) for c in df.columns],
        shown(F.col("_masked")).alias("output_text"),
        shown(F.col("_masked") != text).alias("has_pii"),
        shown(F.size("_spans")).alias("n_entities"),
        shown(summary(F.col("_spans"))).alias("categories"),
        F.when(blocked, F.lit("simple_model_unavailable")).alias("manual_decision_reason"),
    )
