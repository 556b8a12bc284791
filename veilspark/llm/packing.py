"""Operator 2: packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into windows of the full capacity and a remainder.  Remainders, cut into
pieces of at most CUT ids, are gathered until their sum lies a little under a whole number of
windows; differencing then deals them to that many windows of nearly equal load: partial partitions
wait in a heap by imbalance, and the two with the largest are merged with their loads opposed.  If a
window exceeds the capacity, the window count rises by one.  What is left over at the end of an input
partition beyond whole windows goes to sequences whose lengths are powers of two, which need no
padding.  There is no shuffle; a lost task is run again on its input partition with the same result.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices

CUT = 170
WINDOWS = 256
SLACK = (12, 64)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long, ids binary"
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))])


def difference(sizes: list[int], m: int) -> tuple[np.ndarray, list[int]]:
    """Karmarkar-Karp for m sets: the load of each set and the set of each item.

    A partial partition is the loads of its sets that hold something, largest first; the others are empty.
    """
    if m == 1 or not sizes:
        return np.array([sum(sizes)] + [0] * (m - 1)), [0] * len(sizes)
    loads: list[np.ndarray | None] = list(np.array(sizes, np.int64).reshape(-1, 1))
    made: list[tuple[int, int, int, int, np.ndarray | None] | None] = [None] * len(sizes)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = loads[a], loads[b]
        n, k = len(x), len(y)
        if n + k <= m:
            # No set of one meets a set of the other.
            total = np.concatenate((x, y[::-1]))
            order = None if x[-1] >= y[0] == y[-1] else np.argsort(-total, kind="stable")
        else:
            total = np.zeros(m, np.int64)
            total[:n] = x
            total[m - k :] += y[::-1]
            order = np.argsort(-total, kind="stable")
        if order is not None:
            total = total[order]
        loads[a] = loads[b] = None
        loads.append(total)
        made.append((a, b, n, k, order))
        heapq.heappush(heap, (int(total[-1] if len(total) == m else 0) - int(total[0]), len(loads) - 1))
    top = heap[0][1]
    slots: list[np.ndarray | None] = [None] * len(loads)
    slots[top] = np.arange(len(loads[top]))
    for i in range(top, len(sizes) - 1, -1):
        at, slots[i] = slots[i], None
        a, b, n, k, order = made[i]
        if order is not None:
            back = np.empty(len(at), np.int64)
            back[order] = at
            at = back
        slots[a], slots[b] = at[:n], at[len(at) - k :][::-1]
    out = np.zeros(m, np.int64)
    out[: len(loads[top])] = loads[top]
    return out, [int(slots[i][0]) for i in range(len(sizes))]


def balanced(sizes: list[int], capacity: int) -> tuple[int, list[int]]:
    """Windows of at most capacity for items that fit one each: how many, and the window of each item."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        loads, where = difference(sizes, m)
        if loads.max(initial=0) <= capacity:
            return m, where
        m += 1


class Packer:
    """Deals the pieces of one input partition; take() and end() return rows in the order of SCHEMA."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.items, self.load = capacity, first, [], 0

    def _close(self, piece: list[tuple], size: int) -> list[tuple]:
        padded = size if size & (size - 1) == 0 else self.capacity
        rows, at = [], 0
        for doc, start, ids, total in piece:
            rows.append((doc, start, len(ids), total, self.next, at, size, padded, ids.tobytes()))
            at += len(ids)
        self.next += 1
        return rows

    def take(self, doc, ids: np.ndarray) -> list[tuple]:
        rows, n, c = [], len(ids), self.capacity
        whole = n // c * c
        for s in range(0, whole, c):
            rows += self._close([(doc, s, ids[s : s + c], n)], c)
        if rest := n - whole:
            edges = [*range(whole, n, min(CUT, c)), n]
            self.items += [(doc, a, ids[a:b].copy(), n) for a, b in zip(edges, edges[1:])]
            self.load += rest
            slack = -self.load % c
            if self.load >= WINDOWS * c and (SLACK[0] <= slack <= SLACK[1] or self.load >= 2 * WINDOWS * c):
                rows += self._deal()
        return rows

    def _deal(self) -> list[tuple]:
        if not self.items:
            return []
        m, where = balanced([len(x[2]) for x in self.items], self.capacity)
        windows: list[list] = [[] for _ in range(m)]
        for x, w in zip(self.items, where):
            windows[w].append(x)
        self.items, self.load = [], 0
        return [r for w in windows if w for r in self._close(w, sum(len(x[2]) for x in w))]

    def end(self) -> list[tuple]:
        c, over = self.capacity, self.load % self.capacity
        if over and SLACK[0] <= c - over <= SLACK[1]:
            return self._deal()
        odd = over if self.load < c else min(self.load, -(-(over + SLACK[0]) // 64) * 64)
        rows = []
        for bit in reversed(range(odd.bit_length())):
            if odd >> bit & 1:
                need, piece = 1 << bit, []
                while need:
                    doc, start, ids, total = self.items.pop()
                    if len(ids) > need:
                        self.items.append((doc, start, ids[:-need], total))
                        start, ids = start + len(ids) - need, ids[-need:]
                    piece.append((doc, start, ids, total))
                    need -= len(ids)
                    self.load -= len(ids)
                rows += self._close(piece, 1 << bit)
        return rows + self._deal()


class Encoder:
    """The file's own encoder and a faster one from the ranks of its vocabulary, for the texts on which the two agree."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(vocabulary)
        file = json.loads(vocabulary)
        #: The tokens that the file's encoder takes out of a text before it splits the rest.
        self.special = tuple(t["content"] for t in file.get("added_tokens", ()))
        # The printable stand-ins that byte-level vocabularies use for bytes.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The file's own encoder decides where a text holds a special token, and beyond Latin-1, where the two could split texts by other Unicode tables."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.own.encode(text, add_special_tokens=False).ids
        if any(t in text for t in self.special):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """One for each worker.  To be called once a task: looking up a whole file's text costs as much as comparing it."""
    return Encoder(vocabulary)


def encode(text: str, vocabulary: str) -> list[int]:
    return encoder(vocabulary).encode(text)


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SCHEMA, one per piece: where its ids stand in their document and in their sequence, and the ids (little-endian, 32 bits).

    A document is its tokens and the separator, so an empty or null text is one id.  Every id lies in
    exactly one piece.  padded_length is the sequence's length with padding.  sequence_id is unique;
    the numbers depend on how the input is split.  Null and repeated doc_ids are packed like any other;
    an empty table gives no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = f.read()
    # The file goes to the executors by broadcast: its size is the vocabulary's, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(shared.value)
        packer, rows, held = Packer(capacity, TaskContext.get().partitionId() << 40), [], 0
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = array("I", own.encode(text or ""))
                ids.append(separator)
                new = packer.take(doc, np.frombuffer(ids, np.uint32))
                rows += new
                held += sum(len(r[-1]) for r in new)
                if held >= 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += packer.end()
        if rows:
            yield _batch(rows)

    return shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
