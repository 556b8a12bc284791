"""Where models plug in: detectors that propose entities or spans for texts, and the long-text loop around them.

No model ships with this engine.  A detector is any picklable object with is_ready(), error() and
detect(text), which returns proposals and raises Quota or Timeout; it is built once per worker.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import patterns as P
from .chunk import retry_pieces, split_text
from .resolve import PROPOSED

#: Budget of a long text and of a piece (milliseconds), retries after quota errors.
BUDGET_MS = 11_000
PIECE_MS = 5_000
RETRIES = 5


class Quota(Exception):
    """The text is too long for the model."""


class Timeout(Exception):
    """The model took too long."""


class Detector(Protocol):
    def is_ready(self) -> bool: ...

    def detect(self, text: str, timeout_ms: int) -> list[dict]: ...


class KnownNames:
    """A stand-in for a model: finds given names of the tables followed by a capitalised word.  Deterministic, offline."""

    def __init__(self) -> None:
        names = sorted({n for group in P.NAMES.values() for kind in group[:3] for n in kind}, key=len, reverse=True)
        self.pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, names))}) [A-ZÄÖÜ][^\W\d_]+")

    def is_ready(self) -> bool:
        return True

    def detect(self, text: str, timeout_ms: int) -> list[dict]:
        return [{"original": m[0], "replacement": "", "category": "name", "source": "ai", "start": m.start(), "end": m.end(), "confidence": 0.9} for m in self.pattern.finditer(text)]


def analyse(detector: Detector, text: str, limit: int = P.CHUNK["fallback"], threshold: int = P.LONG_TEXT, budget_ms: int = BUDGET_MS) -> dict:
    """Proposals for a text, with status, reason and counters; long texts go piece by piece within a budget."""
    out = {"entities": [], "status": "complete", "reason": None, "chunks": 1, "quota_retries": 0, "timeouts": 0, "limit": None}
    if len(text) < threshold:
        try:
            out["entities"] = detector.detect(text, 30_000)
        except Timeout:
            out |= {"status": "partial", "reason": "timeout", "timeouts": 1}
        return out
    pieces = deque(split_text(text, limit))
    out |= {"chunks": len(pieces), "limit": limit}
    end = time.monotonic() + budget_ms / 1000
    while pieces:
        left = end - time.monotonic()
        if left <= 0:
            return out | {"status": "partial", "reason": "analysis_budget_exceeded"}
        start, stop, kind, depth = pieces.popleft()
        try:
            got = detector.detect(text[start:stop], int(min(PIECE_MS, max(500, left * 1000))))
        except Quota:
            halves = retry_pieces(text, (start, stop, kind, depth)) if out["quota_retries"] < RETRIES else None
            if not halves:
                return out | {"status": "partial", "reason": "quota_retry_exhausted"}
            out["quota_retries"] += 1
            out["chunks"] += len(halves) - 1
            pieces.extendleft(reversed(halves))
            continue
        except Timeout:
            return out | {"status": "partial", "reason": "timeout", "timeouts": out["timeouts"] + 1}
        shift = lambda x, by=start: None if x is None else x + by
        out["entities"] += [{**e, "start": shift(e.get("start")), "end": shift(e.get("end"))} for e in got]
    return out


_DETECTORS: dict[bytes, Detector] = {}


def _detector(make: Callable[[], Detector]) -> Detector:
    """make(), called once in each worker process, which serves many tasks."""
    key = cloudpickle.dumps(make)
    if key not in _DETECTORS:
        _DETECTORS.clear()
        _DETECTORS[key] = make()
    return _DETECTORS[key]


def propose(df: DataFrame, make: Callable[[], Detector], text_col: str = "text", limit: int = P.CHUNK["fallback"], asks_col: str | None = None) -> DataFrame:
    """df with proposed (array of PROPOSED), analysis_status, fallback_reason, chunk_count, quota_retries, timeouts, char_limit and error.

    A detector that isn't ready, or fails, gives null proposals and an error; the text itself is never a result.
    Rows whose asks_col isn't true are complete without a detector.
    """
    names, at = df.columns, df.columns.index(text_col)
    asks = None if asks_col is None else names.index(asks_col)
    more = T.StructType.fromDDL(f"proposed array<{PROPOSED}>, analysis_status string, fallback_reason string, chunk_count int, quota_retries int, timeouts int, char_limit int, error string")
    schema = T.StructType([*df.schema.fields, *more.fields])
    kind = pa.list_(pa.struct([("original", pa.string()), ("replacement", pa.string()), ("category", pa.string()), ("source", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(make)
        for batch in batches:
            got = []
            for text, ask in zip(batch.column(at).to_pylist(), [True] * batch.num_rows if asks is None else batch.column(asks).to_pylist()):
                if not ask:
                    got.append((None, "complete", None, 0, 0, 0, None, None))
                    continue
                error, one = None, {"entities": None, "status": "error", "reason": None, "chunks": 0, "quota_retries": 0, "timeouts": 0, "limit": None}
                try:
                    if detector.is_ready():
                        one = analyse(detector, text or "", limit)
                    else:
                        error = "ai_unavailable"
                except Exception:  # noqa: BLE001  a detector's own failure is a result: fail closed
                    error = "detection_failed"
                got.append((one["entities"], one["status"], error or one["reason"], one["chunks"], one["quota_retries"], one["timeouts"], one["limit"], error))
            kinds = [kind, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*got), kinds)] if got else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)
