"""Operator 8: removal of repeated 50-byte strings with difference-cover suffix arrays.

A suffix array over all bytes at once would shuffle some ten bytes for every byte of input at each of
its rounds.  Here each task builds suffix arrays of its own, by the difference-cover algorithm, over
texts that have been routed so that equal 50-byte strings always meet in one array:

1. Routing.  Every 50-byte window picks one of its 20-byte strings, the least by a hash (leftmost of
   ties): its anchor.  Equal windows pick equal anchors at equal offsets, and one anchor serves about
   sixteen windows, so anchors are about a sixteenth of the positions.
2. Sieve.  Only anchors whose 20 bytes occur in two documents can matter.  Their hashes are counted in
   packed blocks (a few bytes an anchor) and the answers return to the documents.
3. Arrays.  The text around each such anchor that its windows cover (50 bytes and up to 30 more) goes
   to the anchor's bucket.  There equal texts are merged, and the suffix array of the rest is built:
   sort the triples at positions 1 and 2 modulo 3, name them, recurse on the names until they differ,
   sort the remaining suffixes by first byte and rank, merge.  Neighbours in it are compared over 50
   bytes; a run of equal ones takes the smallest doc_id, and windows of larger ids are removed.

Hot strings.  Copies within a block of input travel as one entry.  If over HOT places share an anchor,
its windows travel one by one by their own hash instead, so no bucket gathers them all.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, lookup, shipped, slices, stage

WINDOW = 50
GRAM = 20
SPAN = WINDOW - GRAM + 1  # 20-byte strings in a window
SEGMENT = 1 << 20
#: Bytes of text that a task of steps 2 and 3 gathers before it sends blocks.
BLOCK_BYTES = 16 << 20
#: Aimed bytes of text in a bucket, and the most that one suffix array holds.
BUCKET_BYTES = 1 << 20
ARRAY_BYTES = 1_200_000
HOT = 12_000
#: Two thirds of an array's places are sampled, and their names must fit 20 bits.
LONGEST = (1 << 20) * 3 // 2 - 8
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _table() -> np.ndarray:
    """256 numbers of 64 bits, from a mixing function."""
    x = np.arange(1, 257, dtype=_U) * _U(_ODD)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


TABLE = _table()
_POWER = {n: _U(pow(_ODD, n, 1 << 64)) for n in (1, 2, 4, 8)}


# -- anchors ---------------------------------------------------------------------------------------


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor's string, and the first and last start of the windows that picked it."""
    found = []
    for at in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
        b = np.frombuffer(data, np.uint8, min(SEGMENT + WINDOW - 1, len(data) - at), at)
        h = {1: TABLE[b]}
        for m in (1, 2, 4, 8):
            h[2 * m] = h[m][:-m] * _POWER[m] + h[m][m:]
        n = len(b) - GRAM + 1
        key = (h[16][:n] * _POWER[4] + h[4][16 : 16 + n]) * _U(0xD1B54A32D192ED03)
        # The high bits rank a string, the low ones are its place: the least is the leftmost of the least.
        least = key & ~_U((1 << 21) - 1) | np.arange(n, dtype=_U)
        for s in (1, 2, 4, 8):
            least = np.minimum(least[:-s], least[s:])
        least = np.minimum(least[: len(least) - (SPAN - 16)], least[SPAN - 16 :])
        pick = (least & _U((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
        found.append((key[pick[first]], first + at, np.r_[first[1:] - 1, len(pick) - 1] + at))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


# -- blocks ----------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers of equal length, byte plane by byte plane, compressed."""
    n = len(columns[0])
    out = [struct.pack("<QB", n, len(columns))]
    planes = []
    for c in columns:
        out.append(struct.pack("<B", c.itemsize))
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, c.itemsize).T).tobytes() if n else b"")
    return zstandard.ZstdCompressor(1).compress(b"".join([*out, *planes]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k = struct.unpack_from("<QB", raw)
    sizes = struct.unpack_from(f"<{k}B", raw, 9)
    at, out = 9 + k, []
    for s in sizes:
        plane = np.frombuffer(raw, np.uint8, n * s, at).reshape(s, n)
        out.append(np.ascontiguousarray(plane.T).view(f"<u{s}").ravel() if n else np.zeros(0, f"<u{s}"))
        at += n * s
    return out


# -- suffix arrays ---------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (positive integers below 2 ** 20, at most 2 ** 20 * 1.5 of them), by difference cover modulo 3."""
    n = len(s)
    if n > LONGEST:
        raise ValueError(f"an array of {n} places overflows the fields of its triples; {LONGEST} is the most")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    # One more sampled place past an end that is 1 modulo 3, so that the two halves of the names can't run together.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    triple = t[sample] << 40 | t[np.minimum(sample + 1, n + 2)] << 20 | t[np.minimum(sample + 2, n + 2)]
    values, names = np.unique(triple, return_inverse=True)
    if len(values) < len(sample):
        order = suffix_array(names + 1)
        place = np.empty(len(sample), np.int64)
        place[order] = np.arange(len(sample))
    else:
        place = names
        order = np.empty(len(sample), np.int64)
        order[place] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = place + 1
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] << 22 | rank[zero + 1])]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # Where each remaining suffix falls among the sampled ones of either kind.
    kind = sampled % 3
    ones, twos = sampled[kind == 1], sampled[kind == 2]
    before = np.searchsorted(t[ones] << 22 | rank[ones + 1], t[zero] << 22 | rank[zero + 1])
    before += np.searchsorted(t[twos] << 42 | t[twos + 1] << 22 | rank[twos + 2], t[zero] << 42 | t[zero + 1] << 22 | rank[zero + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def repeated(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (text, start, end) that windows cover which also occur in a text of a smaller document."""
    sizes = np.array([len(x) for x in texts], np.int64)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    s = joined.astype(np.int64) + 2
    s[begin + sizes] = 1
    order = suffix_array(s)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    whole = np.repeat(begin + sizes - WINDOW, sizes + 1) >= np.arange(len(joined))
    order = order[whole[order]]
    # Adjacent prefixes, some at a time.
    same = np.zeros(len(order), bool)
    reach = np.arange(WINDOW)
    for lo in range(1, len(order), 1 << 15):
        hi = min(len(order), lo + (1 << 15))
        both = joined[order[lo - 1 : hi, None] + reach]
        same[lo:hi] = (both[1:] == both[:-1]).all(axis=1)
    starts = np.flatnonzero(~same)
    own = docs[owner[order]]
    least = np.minimum.reduceat(own, starts) if len(starts) else own
    hit = np.repeat(least, np.diff(starts, append=len(order))) < own
    flagged = np.sort(order[hit])
    if not len(flagged):
        return (np.zeros(0, np.int64),) * 3
    of = owner[flagged]
    new = np.ones(len(flagged), bool)
    new[1:] = (flagged[1:] > flagged[:-1] + WINDOW) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(flagged)) - 1
    who = of[first]
    return who, flagged[first] - begin[who], flagged[last] + WINDOW - begin[who]


# -- steps on tables -------------------------------------------------------------------------------

_SIEVE = "bucket long, kind byte, block long, data binary"
_REPLY = "block long, kind byte, data binary"
_MARK = 0xFFFFFFFF


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "byte": pa.int8(), "binary": pa.binary(), "int": pa.int32()}
    names, types = zip(*((a, kinds[b]) for a, b in (c.split() for c in schema.split(", "))))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def _send_anchors(buckets: int):
    """docs(doc_id, h, text) to blocks of anchors by bucket, and what the block needs to read the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        docs, hs, keys, rows, ords, size = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            key, row, ord_ = np.concatenate(keys), np.concatenate(rows), np.concatenate(ords)
            doc = np.array(docs, np.int64)
            order = np.argsort(key, kind="stable")
            key, row, ord_ = key[order], row[order], ord_[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            of = doc[row]
            multi = (np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first))[group]
            # Anchors of two documents of the block: no need to ask, but others must hear of them, and of their number.
            mine = np.flatnonzero(multi)
            heads = first[multi[first]]
            number = np.cumsum(np.isin(mine, heads)) - 1
            counts = np.diff(np.r_[first, len(key)])[multi[first]]
            out = [(-1, 0, block, pack(doc.view(_U), np.array(hs, np.uint32))), (-1, 1, block, pack(number.astype(np.uint32), row[mine].astype(np.uint32), ord_[mine].astype(np.uint32)))]
            ask = np.flatnonzero(~multi)
            k = np.r_[key[ask], key[heads]]
            r = np.r_[row[ask], np.full(len(heads), _MARK)].astype(np.uint32)
            o = np.r_[ord_[ask], np.arange(len(heads))].astype(np.uint32)
            c = np.r_[np.ones(len(ask), np.uint32), counts.astype(np.uint32)]
            order = np.argsort(k, kind="stable")
            k, r, o, c = k[order], r[order], o[order], c[order]
            # An anchor's hash is the least of its window, so its high bits are small: mix before dealing.
            mixed = (k ^ k >> _U(29)) * _U(0xBF58476D1CE4E5B9)
            where = ((mixed >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            k, r, o, c, where = k[order], r[order], o[order], c[order], where[order]
            edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(k) else np.zeros(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(k)]):
                # 48 of the hash's bits, besides those that chose the bucket: enough for a sieve.
                out.append((int(where[a]), 2, block, pack((k[a:b] & _U(0xFFFFFFFF)).astype(np.uint32), (k[a:b] >> _U(32) & _U(0xFFFF)).astype(np.uint16), r[a:b], o[a:b], c[a:b])))
            return _rows(_SIEVE, out)

        for batch in slices(batches):
            for d, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8", "replace")
                key, _, _ = anchors(data)
                if d is None or not len(key):
                    continue
                keys.append(key)
                rows.append(np.full(len(key), len(docs), np.uint32))
                ords.append(np.arange(len(key), dtype=np.uint32))
                docs.append(d)
                hs.append(h & 0xFFFFFFFF)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    block += 1
                    docs, hs, keys, rows, ords, size = [], [], [], [], [], 0
        if docs:
            yield flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Neighbouring rows of one bucket, whose number is the first column."""
    at, held = None, []
    for batch in slices(batches, 16):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def _sieve(hot: int):
    """Blocks of anchors to answers: which of them occur in more than one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            if bucket < 0:
                yield _rows(_REPLY, [(block, kind, data) for kind, block, data in rows])
                continue
            parts = [unpack(data) for _, _, data in rows]
            key = np.concatenate([p[0].astype(_U) | p[1].astype(_U) << _U(32) for p in parts])
            row, ord_, count = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
            of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            order = np.argsort(key, kind="stable")
            key, row, ord_, count, of = key[order], row[order], ord_[order], count[order], of[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            # An entry stands for one document or, marked, for several; two blocks hold different documents.
            many = (np.maximum.reduceat(of, first) != np.minimum.reduceat(of, first))[group]
            warm = (np.add.reduceat(count.astype(np.int64), first) > hot)[group]
            tell = (row != _MARK) & many | (row == _MARK) & warm
            got = [(rows[b][1], 2, pack(row[x], ord_[x], warm[x].astype(np.uint8))) for b in range(len(parts)) if len(x := np.flatnonzero(tell & (of == b)))] if tell.any() else []
            if got:
                yield _rows(_REPLY, got)

    return run


def _answers(group: pa.Table) -> pa.Table:
    """All answers of a block to rows of (doc_id, h, data): which anchors of each document, and which of those are hot."""
    doc = h = mine = None
    parts = []
    for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist()):
        if kind == 0:
            doc, h = unpack(data)
        elif kind == 1:
            mine = unpack(data)
        else:
            parts.append(unpack(data))
    out = pa.schema([("doc_id", pa.int64()), ("h", pa.int32()), ("data", pa.binary())])
    row, ord_, warm = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint32) for i in range(3))
    number, mine_row, mine_ord = mine
    heads = np.zeros(int(number.max()) + 1 if len(number) else 0, bool)
    heads[ord_[row == _MARK]] = True
    ask = row != _MARK
    row, ord_, warm = np.r_[row[ask], mine_row], np.r_[ord_[ask], mine_ord], np.r_[warm[ask].astype(bool), heads[number]]
    order = np.lexsort((ord_, row))
    row, ord_, warm = row[order], ord_[order], warm[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    docs, hs, datas = [], [], []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
        docs.append(int(doc[row[a]].astype(np.int64)))
        hs.append(int(h[row[a]].astype(np.int32)))
        datas.append(pack(np.diff(ord_[a:b], prepend=np.uint32(0)).astype(np.uint32), warm[a:b].astype(np.uint8)))
    return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(hs, pa.int32()), pa.array(datas, pa.binary())], schema=out)


_TEXTS = "bucket long, kind byte, doc_id long, h int, data binary"
_RUNS = "doc_id long, h int, data binary"


def _send_texts(buckets: int):
    """docs(doc_id, h, text, data) to blocks of the texts around their anchors, by bucket; runs that are sure already pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sure: dict[tuple[int, int], list] = defaultdict(list)
            by: dict[int, list] = defaultdict(list)
            for text, (key, places) in seen.items():
                least = min(places)[0]
                for doc, h, start in places:
                    if doc == least:
                        by[key % buckets].append((text, doc, h, start, key & 0xFFFFFFFF))
                    else:
                        # All of it stands in a smaller document of this very block.
                        sure[doc, h].append((start, start + len(text)))
            out = [(-1, 0, doc, h, _pack_runs(runs)) for (doc, h), runs in sure.items()]
            for bucket, entries in by.items():
                out.append((bucket, 1, 0, 0, _pack_entries(entries)))
                if len(out) >= 2000:
                    yield _rows(_TEXTS, out)
                    out = []
            if out:
                yield _rows(_TEXTS, out)

        for batch in slices(batches):
            for doc, h, text, data in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "replace")
                key, first, last = anchors(raw)
                steps, warm = unpack(data)
                ords = np.cumsum(steps.astype(np.int64))
                for k, a, b, w in zip(key[ords].tolist(), first[ords].tolist(), last[ords].tolist(), warm.tolist()):
                    spans = [(s, s + WINDOW) for s in range(a, b + 1)] if w else [(a, b + WINDOW)]
                    for s, e in spans:
                        own = raw[s:e]
                        size += e - s
                        if (at := seen.get(own)) is None:
                            seen[own] = [xxhash.xxh3_64_intdigest(own) if w else k, [(doc, h, s)]]
                        else:
                            at[1].append((doc, h, s))
                if size >= BLOCK_BYTES:
                    yield from flush()
                    seen, size = {}, 0
        yield from flush()

    return run


def _pack_runs(runs: list[tuple[int, int]]) -> bytes:
    x = np.array(runs, np.uint32).reshape(-1, 2)
    return pack(np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1]))


def _pack_entries(entries: list[tuple[bytes, int, int, int, int]]) -> bytes:
    text, doc, h, start, key = zip(*entries)
    head = pack(np.array([len(t) for t in text], np.uint16), np.array(doc, np.int64).view(_U), np.array(h, np.int32).view(np.uint32), np.array(start, np.uint32), np.array(key, np.uint32))
    return struct.pack("<I", len(head)) + head + zstandard.ZstdCompressor(1).compress(b"".join(text))


def _unpack_entries(data: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
    (n,) = struct.unpack_from("<I", data)
    size, doc, h, start, key = unpack(data[4 : 4 + n])
    text = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    at = 0
    for s, d, x, b, k in zip(size.tolist(), doc.view(np.int64).tolist(), h.view(np.int32).tolist(), start.tolist(), key.tolist()):
        yield text[at : at + s], d, x, b, k
        at += s


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a bucket to the runs of their documents that are to go."""
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            yield _rows(_RUNS, [(doc, h, data) for _, doc, h, data in rows])
            continue
        found: dict[tuple[int, int], list] = defaultdict(list)
        seen: dict[bytes, list] = {}
        groups: dict[int, list[int]] = defaultdict(list)
        for _, _, _, data in rows:
            for text, doc, h, start, key in _unpack_entries(data):
                if (at := seen.get(text)) is None:
                    groups[key].append(len(seen))
                    seen[text] = [(doc, h, start)]
                else:
                    at.append((doc, h, start))
        texts, docs, places = [], [], []
        for text, at in seen.items():
            least = min(at)[0]
            for doc, h, start in at:
                if doc != least:
                    found[doc, h].append((start, start + len(text)))
            texts.append(text)
            docs.append(least)
            places.append([(doc, h, start) for doc, h, start in at if doc == least])
        for part in _parts(texts, groups):
            own = repeated([texts[i] for i in part], np.array([docs[i] for i in part], np.int64))
            for j, a, b in zip(*(x.tolist() for x in own)):
                for doc, h, start in places[part[j]]:
                    found[doc, h].append((start + a, start + b))
        if found:
            yield _rows(_RUNS, [(doc, h, _pack_runs(runs)) for (doc, h), runs in found.items()])


def _parts(texts: list[bytes], groups: dict[int, list[int]]) -> Iterator[list[int]]:
    """Indices of texts, in parts that fit one array; texts that could share a window, which share an anchor, stay together.

    A text that is the only one of its anchor shares none and is left out.
    """
    held, size = [], 0
    for group in groups.values():
        if len(group) < 2:
            continue
        n = sum(len(texts[i]) + 1 for i in group)
        if held and size + n > ARRAY_BYTES:
            yield held
            held, size = [], 0
        held += group
        size += n
    if held:
        yield held


def _finish(group_runs: list[bytes], data: bytes) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs from all that the buckets found, and what is left of the text."""
    if not group_runs:
        return [], data
    parts = [unpack(x) for x in group_runs]
    a, b = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    runs = list(zip(a[new].tolist(), b[np.r_[new[1:] - 1, len(a) - 1]].tolist()))
    kept, at = [], 0
    for x, y in runs:
        kept.append(data[at:x])
        at = y
    return runs, b"".join([*kept, data[at:]])


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id, h and n_bytes of texts of WINDOW bytes or more that a smaller document holds as a whole.

    All of such a text goes, and whatever it shares with others its original shares too, so it needs no array.
    """
    keyed = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select("doc_id", "h", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).filter("first < last")
    return lookup(keyed, stage(groups), "key", "size", ["first"]).filter("first < doc_id").select("doc_id", "h", "n_bytes")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        if batch.num_rows:
            yield _rows(_RUNS, [(d, h, _pack_runs([(0, n)])) for d, h, n in zip(*(c.to_pylist() for c in batch.columns))])


def _dealt(rows: DataFrame, least: int, *others: str) -> DataFrame:
    """rows by bucket, those of none (below 0) by other columns, over as many tasks as their number of buckets asks for, if the session asks for fewer."""
    tasks = max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, F.when(F.col("bucket") < 0, F.xxhash64(*others)).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")


def remove_repeats(docs: DataFrame, digests: bool = False, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept (their SHA-256 in hex as kept_sha256, with digests).

    A byte goes if it lies in a string of WINDOW bytes that also starts in a document with a smaller
    doc_id; all strings are judged on the input.  Null text counts as empty, and texts shorter than
    WINDOW lose nothing.  A row with a null doc_id is neither smaller nor larger than any other, so it
    keeps its text and removes none.  Rows that repeat a doc_id are one document: none of them removes
    from another.  Other columns aren't looked at; an empty table gives no rows.
    """
    if (hot + 1) * (WINDOW + SPAN + 1) > LONGEST:
        raise ValueError(f"{hot} places of one anchor don't fit one array")
    shipped(docs)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).cast("string").alias("_x"), text.alias("text"))
    rows = rows.select("doc_id", F.hash("_x").alias("h"), "text")
    on = lambda df: (F.col("doc_id") == df["_d"]) & (F.col("h") == df["_h"])
    copies = stage(_copies(rows))
    gone = copies.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = rows.join(F.broadcast(gone) if few else gone, on(gone), "left_anti")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About eight megabytes of packed anchors a bucket at most, whatever the input.
    sieve_buckets = int(max(256, total // (16 << 20)))
    sent = own.mapInArrow(_send_anchors(sieve_buckets), _SIEVE)
    # Directories go where their block's number says, the rest by bucket.
    dealt = _dealt(sent, sieve_buckets // 4, "block")
    replies = dealt.mapInArrow(_sieve(hot), _REPLY)
    wanted = stage(replies.groupBy("block").applyInArrow(_answers, "doc_id long, h int, data binary").groupBy("doc_id", "h").agg(F.min("data").alias("data")))
    size = wanted.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # An answer is about a byte an anchor, an anchor about seventy bytes of text.
    buckets = int(max(64, size * 70 // BUCKET_BYTES))
    w = wanted.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "data")
    # The texts are dealt by document once; the join at the end reads the same shuffle.
    # Both joins name the columns anew, in the same way: only then Spark sees one shuffle in the two.
    named = lambda: rows.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_of"), F.col("text").alias("_text"))
    at = lambda df: (F.col("_doc") == df["_d"]) & (F.col("_of") == df["_h"])
    met = named().join(w.hint("shuffle_hash"), at(w), "inner")
    texts = met.select(F.col("_doc").alias("doc_id"), F.col("_of").alias("h"), F.col("_text").alias("text"), "data").mapInArrow(_send_texts(buckets), _TEXTS)
    placed = _dealt(texts, buckets // 8, "doc_id", "h", "data")
    found = placed.mapInArrow(_arrays, _RUNS).unionByName(copies.mapInArrow(_whole, _RUNS))
    runs = found.groupBy("doc_id", "h").agg(F.collect_list("data").alias("runs")).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "runs")
    all_rows = named().join(runs.hint("shuffle_hash"), at(runs), "left").select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"), "runs")
    all_rows = all_rows.unionByName(rows.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ("kept_sha256", pa.string()) if digests else ("kept", pa.binary())
        for batch in slices(batches):
            out = []
            for doc, own, got in zip(*(c.to_pylist() for c in batch.columns)):
                data = (own or "").encode("utf-8", "replace")
                spans, kept = _finish(got or [], data)
                out.append((doc, len(data), len(data) - len(kept), len(spans), sha256(kept).hexdigest() if digests else kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [last[1]])] if out else [pa.array([], t) for t in [pa.int64()] * 4 + [last[1]]], names=["doc_id", "n_bytes", "n_removed", "n_spans", last[0]])

    return all_rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}")
