"""The switch in front of the operators: enabled or not, and which of the two modes.

Settings live in the session's configuration, so every job of a session sees the same ones, or in a table
of control events, from which the settings that hold at each of them follow by a running last value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import model
from .anonymize import anonymize
from .mask import mask
from .model import Detector

SIMPLE, REVERSIBLE = "simple", "reversible"
_ENABLED, _MODE = "spark.veilspark.enabled", "spark.veilspark.mode"


@dataclass(frozen=True)
class Engine:
    enabled: bool = True
    mode: str = REVERSIBLE

    @classmethod
    def load(cls, spark: SparkSession) -> Engine:
        """The session's settings; an unknown mode counts as none set."""
        mode = spark.conf.get(_MODE, REVERSIBLE)
        return cls(spark.conf.get(_ENABLED, "true") == "true", mode if mode in (SIMPLE, REVERSIBLE) else REVERSIBLE)

    def save(self, spark: SparkSession) -> Engine:
        spark.conf.set(_ENABLED, str(self.enabled).lower())
        spark.conf.set(_MODE, self.mode)
        return self

    def with_enabled(self, value: object) -> Engine:
        return replace(self, enabled=bool(value))

    def with_mode(self, mode: str) -> Engine:
        """Anything but 'simple' means the reversible mode.  Whoever switches has to clear all mappings (see settings)."""
        return replace(self, mode=SIMPLE if mode == SIMPLE else REVERSIBLE)

    def status(self, spark: SparkSession, model_ready: bool = False) -> DataFrame:
        """One row: enabled, mode, model_ready."""
        return spark.createDataFrame([(self.enabled, self.mode, model_ready)], "enabled boolean, mode string, model_ready boolean")

    def transform(self, df: DataFrame, make: Callable[[], Detector] | None = None, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
        """df with output_text, has_pii and n_entities: the text itself when disabled, placeholders in the simple mode, pseudonyms in the reversible one.

        The branch is taken when the plan is made, so a mode that is off costs nothing.
        """
        made = ("output_text", "has_pii", "n_entities")
        if not self.enabled:
            return df.select("*", F.col(text_col).alias(made[0]), F.lit(False).alias(made[1]), F.lit(0).alias(made[2]))
        out = mask(df, text_col, spans_col=spans_col) if self.mode == SIMPLE else anonymize(df, make, text_col)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def settings(controls: DataFrame, order: str) -> DataFrame:
    """controls (kind: set_enabled or set_mode, value, allowed) with enabled, mode, clears and error as they are after each.

    A switch to the simple mode needs access to its model (allowed); without it nothing changes.  Each
    switch that happens clears all mappings.  Control events are a person's clicks: one task orders them.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    refused = (F.col("kind") == "set_mode") & (F.col("value") == SIMPLE) & ~F.col("allowed")
    mode = F.when((F.col("kind") == "set_mode") & ~refused, F.when(F.col("value") == SIMPLE, SIMPLE).otherwise(REVERSIBLE))
    enabled = F.when(F.col("kind") == "set_enabled", F.col("value") == "true")
    return controls.select(
        "*",
        F.coalesce(F.last(enabled, True).over(upto), F.lit(True)).alias("enabled"),
        F.coalesce(F.last(mode, True).over(upto), F.lit(REVERSIBLE)).alias("mode"),
        ((F.col("kind") == "set_mode") & ~refused).alias("clears"),
        F.when(refused, "simple_model_permission_missing").alias("error"),
    )


def runtime_info(spark: SparkSession) -> DataFrame:
    """name and value of the limits that hold in this build."""
    rows = {"long_text_from": P.LONG_TEXT, "chunk_chars": P.CHUNK["fallback"], "chunk_least": P.CHUNK["least"], "chunk_most": P.CHUNK["most"], "budget_ms": model.BUDGET_MS, "chunk_timeout_ms": model.PIECE_MS, "quota_retries": model.RETRIES, "mapping_ttl_minutes": P.TTL_MINUTES}
    return spark.createDataFrame([(k, int(v)) for k, v in rows.items()], "name string, value long")
