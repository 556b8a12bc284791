"""Operator 7: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace): a whole pre-token that is
in the vocabulary costs one probe and one comparison.  The rest are merged by rank with a heap over
a doubly linked list of their bytes.  Both tiers run on the distinct pre-tokens that a worker hasn't
met lately; its memory of them is bounded and changes no result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices

MEMORY = 300_000
_ALL = (1 << 64) - 1
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def latin(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of Latin-1, with \\p{L}, \\p{N}, \\s and \\S spelled out, which is faster; None if it holds other escapes."""
    import regex

    every = "".join(map(chr, range(256)))
    own = {x: "".join(f"\\x{ord(c):02x}" for c in regex.findall(x, every)) for x in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((x for x in (*own, r"\S") if pattern.startswith(x, i)), None)
        if name == r"\S":
            if inside:
                return None
            out.append("[^" + own[r"\s"] + "]")
        elif name:
            out.append(own[name] if inside else f"[{own[name]}]")
        elif pattern[i] == "\\":
            return None
        else:
            inside = True if pattern[i] == "[" else False if pattern[i] == "]" else inside
            out.append(pattern[i])
        i += len(name or "x")
    return re.compile("".join(out))


class PerfectHash:
    """A minimal perfect hash of byte strings: each key has a place of its own in 0 .. n - 1.

    Keys are dealt to buckets of about four; large buckets first, each takes the first displacement
    that sends all its keys to free places.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        a, b = self._hashes(keys)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, x in enumerate((a % np.uint64(self.buckets)).tolist()):
            members[x].append(i)
        b = b.tolist()
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key: list[bytes | None] = [None] * self.n
        free = [True] * self.n
        for bucket in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            own = members[bucket]
            d = 0
            while own:
                at = [self._place(b[i], d) for i in own]
                if len(set(at)) == len(at) and all(free[x] for x in at):
                    for i, x in zip(own, at):
                        free[x] = False
                        self.key[x] = keys[i]
                    break
                d += 1
            self.shift[bucket] = d

    @staticmethod
    def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _place(self, b: int, d: int) -> int:
        # An odd multiplier after the displacement; the high half of the product is scaled to 0 .. n - 1.
        return (((b ^ d * 0x9E3779B97F4A7C15 & _ALL) * 0xD1B54A32D192ED03 & _ALL) >> 32) * self.n >> 32

    def places(self, keys: list[bytes]) -> np.ndarray:
        a, b = self._hashes(keys)
        with np.errstate(over="ignore"):
            d = self.shift[(a % np.uint64(self.buckets)).astype(np.int64)]
            x = (b ^ d * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1B54A32D192ED03)
        return ((x >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.hash = PerfectHash(list(self.ranks))
        self.at = np.array([self.ranks[k] for k in self.hash.key], np.uint32)
        self.find = regex.compile(pattern)
        self.find_latin = latin(pattern) or self.find
        self.seen: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the pair of lowest rank, then leftmost, is joined until none is left."""
        n, ranks = len(word), self.ranks
        part: list[bytes] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been joined with another
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p]

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        places = self.hash.places(raw)
        key, seen = self.hash.key, self.seen
        whole = self.at[places].astype("<u4").tobytes()
        for i, (w, r, p) in enumerate(zip(words, raw, places.tolist())):
            seen[w] = whole[4 * i : 4 * i + 4] if key[p] == r else pack(f"<{len(ids := self.merge(r))}I", *ids)

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            words = self.find_latin.findall(text)
        except UnicodeEncodeError:
            words = self.find.findall(text)
        if len(self.seen) > MEMORY:
            self.seen.clear()
        seen = self.seen
        if new := [w for w in set(words) if w not in seen]:
            self.learn(new)
        return b"".join(map(self.seen.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_bpe(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 32 bits) and the decoded bytes; with digests, SHA-256 in hex of the last two instead.

    Each match of the pattern is encoded for itself and there are no special tokens, so their strings
    are ordinary text.  A null or empty text has no ids.  Null and repeated doc_ids pass through, and
    an empty table gives no rows.
    """
    with open(rank_file, "rb") as f:
        # Built once and broadcast: the vocabulary's size, whatever the input.  A worker keeps its copy, memory included.
        shared = docs.sparkSession.sparkContext.broadcast(Codec(f.read(), pattern))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((n, pa.string()) if digests else (n[:-7], pa.binary()) for n in ("ids_sha256", "decoded_sha256"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = own.encode(text or "")
                back = own.decode(ids)
                rows.append((doc, len(ids) // 4, *((sha256(ids).hexdigest(), sha256(back).hexdigest()) if digests else (ids, back))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
