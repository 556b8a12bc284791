"""Operator 1: substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where its top bits are zero.  The hash is 16 bits wide
and shifts one bit a byte, so a cut depends on the last 16 bytes only and chunks fall into step again
right after an insertion.  Rules on the size of chunks look at neighbouring cut candidates, never at
where the text begins, so they don't spoil that.  A chunk is a duplicate if its digest occurs in a
document with a smaller id.  Runs of adjacent duplicates of MIN_RUN bytes or more are removed; shorter
ones are everyday phrases and stay.

Digests are counted by aggregation; each chunk then looks its digest up, hot digests by a bounded
broadcast (common.lookup's rule), and a document's duplicates return to it as one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_LEAST, HOT_SHARE, fresh, shipped, slices, stage

CUT_BITS = 4
MIN_CHUNK = 12
MAX_CHUNK = 256
MIN_RUN = 80
#: Rows of spans, and numbers in them, that may be broadcast to the documents: 16 MB at most.
BROADCAST_SPANS = 200_000
BROADCAST_NUMBERS = 2_000_000


def _gear() -> np.ndarray:
    """256 numbers of 16 bits, from a mixing function."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype(np.uint16)


with np.errstate(over="ignore"):
    GEAR = _gear()


def cuts(data: bytes, bits: int = CUT_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of data, ascending, the last one len(data)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):  # h[i] becomes the sum of 2 s terms, each byte shifted by its distance
        if n > s:
            h[s:] += h[:-s] << s
    found = np.flatnonzero(h[15:] >> (16 - bits) == 0) + 16
    found = found[found < n]
    if len(found):
        # A candidate that follows another closely is none; this looks at candidates, not at earlier cuts.
        found = found[np.diff(found, prepend=-least) >= least]
    ends = np.r_[found, n]
    starts = np.r_[0, found]
    if (ends - starts).max() > most:
        ends = np.concatenate([np.r_[np.arange(a + most, b, most), b] for a, b in zip(starts.tolist(), ends.tolist())])
    return ends.astype(np.int64)


def _digests(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each chunk's digest."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    marks = [0, *ends.tolist()]
    both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(marks, marks[1:])]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.int32)


def chunks(docs: DataFrame) -> DataFrame:
    """d1, d2 (digest), doc_id, start, size of each chunk of docs(doc_id, text)."""
    kinds = (("d1", pa.int64()), ("d2", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()))
    out = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                if doc is None or not data:
                    continue
                ends = cuts(data)
                d1, d2 = _digests(data, ends)
                starts = np.r_[0, ends[:-1]]
                rows.append((d1, d2, np.full(len(ends), doc, np.int64), starts, ends - starts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*rows), out)], schema=out)

    return shipped(docs).mapInArrow(run, "d1 long, d2 int, doc_id long, start int, size int")


def _duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, start and size of the chunks that occur in a document with a smaller id."""
    found = chunks(docs)
    first = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stage(first.filter("first < last").select("d1", "d2", "first", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot_from = max(HOT_LEAST, total * HOT_SHARE)
    # At most 1 / HOT_SHARE digests hold that share of all shared chunks.
    hot = shared.filter(F.col("n") >= hot_from).select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), F.col("first").alias("hot"))
    cold = shared.filter(F.col("n") < hot_from).select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("first").alias("cold"))
    rows = found.join(F.broadcast(hot), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left")
    # What a hot digest has answered goes anywhere; the rest meets its digest.
    away = F.col("hot").isNotNull()
    rows = rows.select("doc_id", "start", "size", "hot", F.when(away, F.xxhash64("doc_id", "start")).otherwise(F.col("d1")).alias("k1"), F.when(away, -1).otherwise(F.col("d2")).alias("k2"))
    met = rows.join(cold, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return met.filter(F.coalesce("hot", "cold") < F.col("doc_id")).select("doc_id", "start", "size")


def spans(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and runs: the byte ranges [start, end) of each document that repeat text of a document with a smaller id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = _duplicates(rows).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("chunks"))
    # Adjacent chunks become one run; a document's chunks fit its task, as its text did.

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = [], []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = own.values.field("start").to_numpy()
                b = a + own.values.field("size").to_numpy()
                new = np.r_[True, a[1:] > np.maximum.accumulate(b)[:-1]]
                lo, hi = a[new], np.maximum.reduceat(b, np.flatnonzero(new))
                ok = hi - lo >= min_run
                if ok.any():
                    ids.append(doc)
                    runs.append([x for pair in zip(lo[ok].tolist(), hi[ok].tolist()) for x in pair])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["doc_id", "runs"])

    return lists.mapInArrow(join, "doc_id long, runs array<int>")


def _kept(data: bytes, runs: list[int]) -> tuple[bytes, int, int]:
    """data without its runs, which shrink to whole characters; bytes and runs removed."""
    out, at, removed, n = [], 0, 0, 0
    for a, b in zip(runs[::2], runs[1::2]):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append(data[at:a])
            at, removed, n = b, removed + b - a, n + 1
    return b"".join([*out, data[at:]]), removed, n


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from the text column, and with the columns _n_bytes, _n_removed and _n_spans (longs).

    Of equal passages the one in the document with the smallest id stays.  Null texts stay null and
    lose nothing; a null id takes no part; rows that repeat an id are one document to this rule, so
    the first of them keeps its passages and so do the others.  Other columns pass through, whatever
    their names: where docs has one of the three, the new one has one more underscore in front.  An
    empty table gives an empty one.
    """
    names = docs.columns
    text = names.index(text_col)
    counted = fresh(names, "_n_bytes", "_n_removed", "_n_spans")
    cut_of, runs_of = fresh([*names, *counted], "cut_of", "runs")
    cut = stage(spans(docs, min_run, id_col, text_col).select(F.col("doc_id").alias(cut_of), F.col("runs").alias(runs_of)))
    n_rows, numbers = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(runs_of)), F.lit(0))).first()
    few = n_rows <= BROADCAST_SPANS and numbers <= BROADCAST_NUMBERS
    joined = docs.join(F.broadcast(cut) if few else cut, docs[id_col].cast("long") == F.col(cut_of), "left").select(*[F.col(f"`{c}`") for c in names], runs_of)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            own, texts, counts = part.column(len(names)).to_pylist(), [], []
            for t, runs in zip(part.column(text).to_pylist(), own):
                data = (t or "").encode("utf-8", "replace")
                left, removed, n = _kept(data, runs) if runs else (data, 0, 0)
                texts.append(None if t is None else left.decode("utf-8") if runs else t)
                counts.append((len(data), removed, n))
            columns = [part.column(i) for i in range(len(names))]
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*counts))], names=[*names, *counted])

    return joined.mapInArrow(run, schema)
