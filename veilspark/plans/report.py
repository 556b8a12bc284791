"""Reports over run records: latency percentiles, coverage by type, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile(value: Column | str, p: float) -> Column:
    """Nearest-rank percentile: a value that occurs."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})") if isinstance(value, str) else F.percentile(value, p)


def _share(on: Column) -> Column:
    return F.avg(F.when(F.coalesce(on, F.lit(False)), 1.0).otherwise(0.0))


def latency(records: DataFrame) -> DataFrame:
    """One row per measurement, size and variant; partial rows aren't complete, error rows are."""
    r = F.col("result")
    late = (F.coalesce(r["timeout_count"], F.lit(0)) > 0) | (r["fallback_reason"] == "timeout")
    return (
        records.filter(~F.col("discarded"))
        .groupBy("measurement", "size_label", "variant")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            percentile("roundtrip_ms", 0.5).alias("p50"),
            percentile("roundtrip_ms", 0.95).alias("p95"),
            F.max("roundtrip_ms").alias("max"),
            (1 - _share(r["analysis_status"] == "partial")).alias("complete_rate"),
            _share(late).alias("timeout_rate"),
            _share(F.coalesce(r["quota_retry_count"], F.lit(0)) > 0).alias("quota_retry_rate"),
        )
        .orderBy("measurement", F.regexp_extract("size_label", r"^\d+", 0).try_cast("int"), "variant")
    )


def coverage(records: DataFrame) -> DataFrame:
    """How often each type was expected and protected."""
    rows = records.filter(~F.col("discarded") & F.col("quality").isNotNull()).select(F.explode("expected_types").alias("type"), F.col("quality.protected_types").alias("p"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("expected"), F.sum(F.when(F.array_contains("p", F.col("type")), 1).otherwise(0)).alias("protected")).orderBy("type")


def recommend(records: DataFrame, threshold: int = 4000, timeout: int = 5000, budget: int = 11000) -> DataFrame:
    """One row of settings that the measured runs suggest."""
    r = F.col("result")
    seen = records.filter(~F.col("discarded") & (F.col("measurement") == "background")).agg(
        F.coalesce(F.bool_or(r["quota_retry_count"] > 0), F.lit(False)).alias("quota"),
        F.coalesce(F.bool_or((r["timeout_count"] > 0) | F.coalesce(r["fallback_reason"] == "timeout", F.lit(False))), F.lit(False)).alias("late"),
        F.coalesce(F.bool_or(F.coalesce(r["fallback_reason"] == "analysis_budget_exceeded", F.lit(False))), F.lit(False)).alias("over"),
        F.max(F.when(r["analysis_status"] == "complete", F.col("target_chars"))).alias("largest_complete_chars"),
        F.floor(F.avg(r["char_limit"]) + 0.5).cast("int").alias("limit"),
        percentile("roundtrip_ms", 0.95).alias("p95"),
    )
    steps = lambda x: (F.ceil(x / 500) * 500).cast("int")
    return seen.select(
        F.when(F.col("late") | F.col("over"), min(threshold, 4000)).otherwise(threshold).alias("long_text_threshold_chars"),
        F.when(F.col("quota") & F.col("limit").isNotNull(), F.greatest(F.lit(1200), F.floor(F.col("limit") * 0.8).cast("int"))).otherwise(F.col("limit")).alias("chunk_budget_chars"),
        F.coalesce(F.greatest(F.lit(timeout), steps(F.col("p95") / 2)), F.lit(timeout)).alias("chunk_timeout_ms"),
        F.coalesce(F.greatest(F.lit(budget), steps(F.col("p95") * 1.25)), F.lit(budget)).alias("analysis_budget_ms"),
        "largest_complete_chars",
        F.col("quota").alias("quota_retries_seen"),
        (F.col("late") | F.col("over")).alias("partial_seen"),
    )


def render(records: DataFrame, title: str) -> str:
    """The report as Markdown; the aggregates have a row per size and variant, so they fit the driver."""
    ms = lambda x: "n/a" if x is None else f"{int(x + 0.5)} ms"
    pc = lambda x: "n/a" if x is None else f"{int(100 * x + 0.5)}%"
    out = [f"# {title}", "", "## Latency", "", "| Measurement | Size | Variant | Runs | p50 | p95 | Max | Complete | Timeout | Quota retry |", "|---|---:|---|---:|---:|---:|---:|---:|---:|---:|"]
    for x in latency(records).collect():
        out.append(f"| {x.measurement} | {x.size_label} | {x.variant} | {x.runs} | {ms(x.p50)} | {ms(x.p95)} | {ms(x['max'])} | {pc(x.complete_rate)} | {pc(x.timeout_rate)} | {pc(x.quota_retry_rate)} |")
    partial, every = records.filter(~F.col("discarded") & F.col("quality").isNotNull()).agg(F.count_if(F.col("result.analysis_status") == "partial"), F.count(F.lit(1))).first()
    out += ["", "## Complete and partial", "", f"Complete: {every - partial}", f"Partial: {partial}", "", "## Coverage", "", "| Type | Protected | Expected | Coverage |", "|---|---:|---:|---:|"]
    for x in coverage(records).collect():
        out.append(f"| {x.type} | {x.protected} | {x.expected} | {pc(x.protected / x.expected if x.expected else 0.0)} |")
    out += ["", "## Recommendations", ""]
    out += [f"- {name}: {value}" for name, value in recommend(records).first().asDict().items()]
    return "\n".join(out) + "\n"
