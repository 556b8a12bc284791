"""Chunks of long texts at natural boundaries, with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import validators as V

_SENTENCE = re.compile(rf"[.!?。！？][)\"'\]”’]*{P.WS}+")


def char_limit(context_window: Column, input_quota: Column, context_usage: Column, overhead_tokens: Column, ratio: float | Column = P.CHUNK["ratio"]) -> Column:
    """Characters that fit a model's context; the fallback where its size isn't known."""
    least, most = P.CHUNK["least"], P.CHUNK["most"]
    quota = F.coalesce(V.finite_positive(context_window), V.finite_positive(input_quota))
    used = lambda c: F.greatest(F.lit(0.0), F.coalesce(V.finite(c), F.lit(0.0)))
    free = F.greatest(F.lit(0.0), quota - used(context_usage) - used(overhead_tokens))
    tokens = F.floor(free * ratio)
    fit = V.clamp(F.floor(tokens * P.CHUNK["per_token"]), least, most)
    return F.when(quota.isNull(), min(max(P.CHUNK["fallback"], least), most)).when(tokens <= 0, least).otherwise(fit).cast("int")


def near_limit(n_chars: Column, limit: Column) -> Column:
    """Whether a chunk is so long that its use of the context should be measured."""
    own = V.finite_positive(limit)
    return F.coalesce((n_chars > 0) & (n_chars >= own * P.CHUNK["near"]), F.lit(False))


def _boundary(text: str, start: int, target: int, least: int) -> tuple[int, str]:
    """The end of a chunk: the last paragraph, line, sentence or word that ends late enough, else the limit."""
    for mark, kind in (("\n\n", "paragraph"), ("\n", "line")):
        if (at := text.rfind(mark, 0, target + len(mark))) >= least:
            return at + len(mark), kind
    end = -1
    for m in _SENTENCE.finditer(text, start, target):
        end = m.end()
    if end >= least:
        return end, "sentence"
    if (at := text.rfind(" ", 0, target + 1)) >= least:
        return at + 1, "word"
    return target, "hard"


def split_text(text: str, limit: int, least: int = P.CHUNK["least"], overlap: int = P.CHUNK["overlap"], base: int = 0, depth: int = 0) -> list[tuple[int, int, str, int]]:
    """(start, end, boundary, depth) of each chunk; chunks overlap after a cut inside a sentence or word."""
    limit = max(1, int(limit))
    least = max(1, min(least, limit))
    out, at, n = [], 0, len(text)
    while at < n:
        if n - at <= limit:
            out.append((base + at, base + n, "end", depth))
            break
        end, kind = _boundary(text, at, at + limit, at + min(least, limit // 2))
        end = max(at + 1, min(end, n))
        out.append((base + at, base + end, kind, depth))
        back = max(0, min(overlap, end - at - 1)) if kind in ("word", "hard") else 0
        at = end - back if end - back > at else end
    return out


def retry_pieces(text: str, chunk: tuple[int, int, str, int], least: int = P.CHUNK["least"]) -> list[tuple[int, int, str, int]] | None:
    """A chunk in halves without overlap, one level deeper; None if it is too short."""
    start, end, _, depth = chunk
    n = end - start
    if n <= max(2, least):
        return None
    pieces = split_text(text[start:end], max(least, -(-n // 2)), least, 0, start, depth + 1)
    return pieces if len(pieces) > 1 else None


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = P.CHUNK["fallback"], least: int = P.CHUNK["least"], overlap: int = P.CHUNK["overlap"], retry: bool = False) -> DataFrame:
    """One row per chunk: the id, chunk (from 0), start, end, boundary, retry_depth, text.  With retry every chunk is halved once."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = split_text(text or "", limit, least, overlap)
                if retry:
                    own = [p for c in own for p in (retry_pieces(text, c, least) or [c])]
                rows += [(key, i, a, b, k, d, text[a:b]) for i, (a, b, k, d) in enumerate(own)]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "chunk", "start", "end", "boundary", "retry_depth", "text"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} {kind}, chunk int, start int, end int, boundary string, retry_depth int, text string")


def offset_entities(entities: Column, start: Column) -> Column:
    """Entities of a chunk with their places moved to those in the text."""
    return F.transform(entities, lambda e: e.withField("start", e["start"] + start).withField("end", e["end"] + start))
