"""Small rules around models and errors (F20 to F23, B10), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators as V


def error_code(message: Column, has_gpu: Column, fallback: Column) -> Column:
    """The code of a model runtime's error message."""
    own = F.coalesce(message, F.lit(""))
    return (
        F.when(~has_gpu, "webgpu_unavailable")
        .when(own.rlike("(?i)quota"), "simple_model_cache_quota_exceeded")
        .when(own.rlike("(?i)Failed to fetch|Load failed|NetworkError|404|403|not found|CORS"), "simple_model_download_failed")
        .when(own.rlike("(?i)webgpu"), "webgpu_unavailable")
        .otherwise(fallback)
    )


def progress(value: Column, loaded: Column, total: Column) -> Column:
    """A share from a percentage or share, or from loaded and total; null without either."""
    own, part, whole = V.finite(value), V.finite(loaded), V.finite(total)
    return F.when(own.isNotNull(), F.when(own > 1, own / 100).otherwise(own)).when(part.isNotNull() & (whole > 0), part / whole)


def session_params(default_k: Column, max_k: Column, default_t: Column, max_t: Column, target: float = 0.2) -> Column:
    """(top_k, temperature) within a model's limits; null if those aren't numbers or allow nothing."""
    a, b, c, d = (V.finite(x) for x in (default_k, max_k, default_t, max_t))
    top = F.least(F.greatest(F.lit(1.0), F.floor(a + 0.5).cast("double")), F.floor(b).cast("double"))
    ok = a.isNotNull() & (b >= 1) & c.isNotNull() & (d >= 0)
    return F.when(ok, F.struct(top.cast("int").alias("top_k"), F.least(F.lit(target), d).alias("temperature")))
