"""Operator 6: SimHash near-duplicates by bit-sliced comparison.

Fingerprints that meet in a block are stored vertically: plane b holds bit b of 64 fingerprints in a
word.  One XOR per plane compares a fingerprint with 64 others; their distances grow in carry-save
counters (one word per binary digit), and a block is abandoned once all 64 exceed the radius.

Blocks.  With radius r, the bits are cut into r + KEPT groups; two fingerprints within r agree in at
least KEPT of the groups, so each choice of KEPT groups is one table, and fingerprints that agree in
its groups share a block.  That loses no link.  A block of more than BLOCK different fingerprints is
split by the same rule over its remaining bits until it fits; BLOCK bounds what a task holds.
Links inside a block are reported as one star per connected set.  The stars are merged by alternating
large-star and small-star steps, all of them joins and aggregations on (id, id) rows.

near_dedup takes such links as candidates only and decides by the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, lookup, shipped, slices, stage, without_ids

KEPT = 3
BLOCK = 1 << 15
#: So many edges fit one task, whatever their nodes.
TASK_EDGES = 1_000_000
#: Names of nodes without any doc_id begin here.
NAMELESS = 2**63 - 1 - 2**40
#: Bytes of shingle sets that a task compares with as many others.
PIECE = 1 << 23
#: Candidates that came together over others are compared if they differ in so many bits more.
SLACK = 16
_EMPTY = np.zeros(0, np.uint64)
_FULL = np.uint64(2**64 - 1)


# -- fingerprints ----------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of that many words, joined by single spaces; of the whole sequence if it is shorter."""
    import xxhash

    own = text.encode("utf-8", "replace").lower().split()  # both of ASCII letters and white space only
    if not own:
        return _EMPTY
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    k = min(words, len(own))
    starts = [0, *(ends[: len(own) - k] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, more: int = 1) -> list[int]:
    """64 * more bits: bit i is 1 if it is set in over half of the hashes.  Words after the first use remixed hashes."""
    out = []
    for w in range(more):
        h = _mix(hashes + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)) if w else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            counts += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big"))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One key per band of the smallest remixed hash in each of bands * rows bins; empty bins copy the next one that is filled."""
    k = bands * rows
    x = _mix(hashes if len(hashes) else np.zeros(1, np.uint64))
    least = np.full(k, _FULL)
    np.minimum.at(least, (x % np.uint64(k)).astype(np.int64), x)
    filled = np.flatnonzero(least != _FULL)
    if len(filled) < k:
        nxt = filled[np.searchsorted(filled, np.arange(k)) % len(filled)]
        least = least[nxt] + (np.arange(k) - nxt).astype(np.uint64)
    key = np.zeros(bands, np.uint64)
    for c in least.reshape(bands, rows).T:
        key = _mix(key * np.uint64(31) + c)
    return _mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


# -- bit-sliced comparison -------------------------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """fps: n rows of words, n a multiple of 64.  Plane b, word i: bit b of fingerprints 64 i .. 64 i + 63 (bit j: the j-th)."""
    n, words = fps.shape
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, words * 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _within(planes: np.ndarray, at: np.ndarray, fps: np.ndarray, radius: int, alive: np.ndarray) -> np.ndarray:
    """For each row of fps, a mask of which of the 64 fingerprints in word at[row] differ in radius bits at most."""
    digits = radius.bit_length()
    out = np.zeros(len(at), np.uint64)
    left = np.arange(len(at))
    over = ~alive
    count = [np.zeros(len(at), np.uint64) for _ in range(digits)]
    start = np.uint64((1 << digits) - 1 - radius)  # counters begin so high that radius + 1 more differences overflow
    for d in range(digits):
        if int(start) >> d & 1:
            count[d][:] = _FULL
    total = planes.shape[0]
    for b in range(total):
        word, bit = divmod(b, 64)
        carry = planes[b, at] ^ (np.uint64(0) - (fps[:, word] >> np.uint64(63 - bit) & np.uint64(1)))
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b % 8 == 7 and b >= radius and b + 1 < total:
            keep = over != _FULL
            if not keep.all():
                at, fps, over, left = at[keep], fps[keep], over[keep], left[keep]
                count = [c[keep] for c in count]
                if not len(at):
                    return out
    out[left] = ~over
    return out


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links(blocks: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars (id, smaller id) that connect what is linked within each block.  Rows are sorted by block; block numbers are any."""
    n = len(blocks)
    edge = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    size = np.diff(np.r_[edge, n])
    own = size > 1
    edge, size = edge[own], size[own]
    if not len(edge):
        return []
    # Small blocks share words of 64 places, none crosses a word; large ones begin on a word of their own.
    place = np.empty(len(edge), np.int64)
    at = 0
    for i, s in enumerate(size.tolist()):
        if at % 64 + s > 64:
            at += -at % 64
        place[i] = at
        at += s
    rows = np.repeat(edge - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    spot = np.repeat(place - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    laid = np.zeros((at + -at % 64, fps.shape[1]), np.uint64)
    laid[spot] = fps[rows]
    planes = _planes(laid)
    of_spot = np.full(len(laid), -1, np.int64)
    of_spot[spot] = rows
    parent = np.arange(n)
    last = np.repeat(place + size, size)
    found: list[tuple[int, int]] = []

    def compare(spots: np.ndarray, ends: np.ndarray, word: np.ndarray) -> None:
        """Later members of the same block that stand in the given word."""
        low = np.maximum(spots + 1 - word * 64, 0)
        high = np.minimum(ends - word * 64, 64)
        ok = (low < high) & (low < 64)
        spots, word, low, high = spots[ok], word[ok], low[ok], high[ok]
        upto = np.where(high >= 64, _FULL, (np.uint64(1) << (high % 64).astype(np.uint64)) - np.uint64(1))
        alive = upto & ~((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1))
        mask = _within(planes, word, laid[spots], radius, alive)
        for s, w, m in zip(spots[mask != 0].tolist(), word[mask != 0].tolist(), mask[mask != 0].tolist()):
            while m:
                j = (m & -m).bit_length() - 1
                m &= m - 1
                a, b = _root(parent, int(of_spot[s])), _root(parent, int(of_spot[64 * w + j]))
                if a != b:
                    if ids[a] > ids[b]:
                        a, b = b, a
                    parent[b] = a

    for lo in range(0, len(spot), 1 << 14):
        s, e = spot[lo : lo + (1 << 14)], last[lo : lo + (1 << 14)]
        step = 0
        while len(s):
            compare(s, e, s // 64 + step)
            step += 1
            more = (s // 64 + step) * 64 < e
            s, e = s[more], e[more]
    for r in rows.tolist():
        if (a := _root(parent, r)) != r:
            found.append((int(ids[r]), int(ids[a])))
    return found


def _runs(batches: Iterator[pa.RecordBatch], words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block: (block, node, fp0 ..).  A block may go on in the next batch."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(words + 2)], axis=1)
        rows = np.concatenate([*held, new]) if held else new
        cut = int(np.searchsorted(-(rows[::-1, 0] == rows[-1, 0]).astype(np.int8), 0))  # rows of the last block, at the end
        if cut < len(rows):
            done = rows[: len(rows) - cut]
            if got := links(done[:, 0], done[:, 2:], done[:, 1].view(np.int64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], schema=out)
        held = [rows[len(rows) - cut :].copy()]
    if held and (got := links(held[0][:, 0], held[0][:, 2:], held[0][:, 1].view(np.int64), radius)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], schema=out)


# -- connected components --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each linked node reaches, from edges (a, b), by large-star and small-star steps.

    The steps go on until nothing changes, some log of the longest path times.  A node's neighbours meet
    its least one in a join; of more than TASK_EDGES edges, where a node that a third of all others hang
    on would be too much for a task, by common.lookup.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _beside_least(both, n > TASK_EDGES).filter("b > a").select(F.col("b").alias("a"), F.least(F.col("a"), F.col("m")).alias("b")).distinct()
        small = _beside_least(stage(large) if n > TASK_EDGES else large, n > TASK_EDGES)
        edges = stage(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _beside_least(rows: DataFrame, hot: bool) -> DataFrame:
    """rows (a, b) with m, the least b of each a."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if hot:
        return lookup(rows, stage(least), "a", "n", ["m"])
    return rows.join(least.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).select("a", "b", "m")


# -- the operator ----------------------------------------------------------------------------------


def _cuts(width: int, parts: int) -> list[tuple[int, int]]:
    edges = [width * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def _bits(names: list[str], lo: int, hi: int):
    """Bits lo .. hi - 1 (0: the highest of the first word) as a column; parts of two words are combined."""
    out = None
    for w in range(lo // 64, (hi - 1) // 64 + 1):
        a, b = max(lo - 64 * w, 0), min(hi - 64 * w, 64)
        x = F.shiftrightunsigned(F.col(names[w]), 64 - b).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1))
        out = x if out is None else F.xxhash64(out, x)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, more: int = 1, bands: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """doc_id, fp0 .. (64 bits each), and keys (the bands' keys) if bands = (bands, rows) are asked for.  With distinct a shingle counts once."""
    fields = [("doc_id", pa.int64()), *((f"fp{i}", pa.int64()) for i in range(more)), *([("keys", pa.list_(pa.int64()))] if bands else [])]
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [shingle_hashes(t or "", words, seed) for t in part.column(1).to_pylist()]
            hashes = [np.unique(h) for h in hashes] if distinct else hashes
            fps = np.array([fingerprint(h, more) for h in hashes], np.uint64).view(np.int64)
            columns = [part.column(0), *(pa.array(fps[:, i]) for i in range(more))]
            if bands:
                columns.append(pa.array([sketch_keys(h, *bands) for h in hashes], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    schema = ", ".join(f"{n} {'array<long>' if n == 'keys' else 'long'}" for n, _ in fields)
    return shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, more: int = 1, bands: tuple[int, int] | None = None, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """One row per input row: doc_id, fp0 .., component_id (the smallest doc_id reachable over links of radius bits or fewer).

    Without bands the blocks are the exact ones described above.  With bands, fingerprints meet where
    a band of their shingles' sketch agrees, which allows radii that no exact blocks could serve.
    A text without words has fingerprint zero and is linked like any other.  A null doc_id keeps its
    row and is linked, but never names a component: one without any doc_id has a null component_id.
    Rows that repeat are rows of one component; an empty table gives no rows.  Ids must be below
    NAMELESS, where the names of fingerprints without any doc_id begin (by 40 bits of their hash).
    """
    fps = [f"fp{i}" for i in range(more)]
    rows = stage(fingerprints(docs, words, seed, more, bands, id_col, text_col, distinct))
    names, edges = _candidates(rows, fps, radius, bands, block)
    return _named(rows, fps, names, components(edges))


def _candidates(rows: DataFrame, fps: list[str], radius: int, bands: tuple[int, int] | None, block: int) -> tuple[DataFrame, DataFrame]:
    """(fp0 .., node, n), one row per fingerprint, and the stars (a, b) of linked nodes."""
    # Copies of a fingerprint are one node, named by its smallest doc_id; nodes without any doc_id get a name beyond them.
    node = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.xxhash64(*fps).bitwiseAND(F.lit(2**40 - 1))).alias("node")
    nodes = rows.groupBy(*fps, *(["keys"] if bands else [])).agg(node, F.count(F.lit(1)).alias("n"))
    if bands:
        # One fingerprint may come with several sketches; all its nodes are one by the fingerprint itself.
        nodes = stage(nodes)
        names = nodes.groupBy(*fps).agg(F.min("node").alias("node"), F.sum("n").alias("n"))
        blocks = nodes.select(F.explode("keys").alias("block"), *fps, "n").groupBy("block", *fps).agg(F.sum("n").alias("n"))
        blocks = blocks.join(names.select(*[F.col(f).alias(f"_{f}") for f in fps], "node"), [F.col(f) == F.col(f"_{f}") for f in fps]).select("block", "node", *fps)
    else:
        nodes = names = stage(nodes)
        cuts = _cuts(64 * len(fps), radius + KEPT)
        tables = [tuple(c) for c in combinations(range(len(cuts)), KEPT)]
        keys = F.array(*[F.xxhash64(F.lit(i), *[_bits(fps, *cuts[c]) for c in t]) for i, t in enumerate(tables)])
        blocks = nodes.select(F.explode(keys).alias("block"), "node", *fps)
    return names, _edges(blocks, fps, radius, block)


def _named(rows: DataFrame, fps: list[str], names: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, fp0 .., component_id of each row, from the roots found for the nodes."""
    keyed = stage(names.join(found, "node", "left").select(F.concat_ws(",", *fps).alias("key"), "n", F.coalesce("root", "node").alias("component_id")))
    out = lookup(rows.select("doc_id", *fps, F.concat_ws(",", *fps).alias("key")), keyed, "key", "n", ["component_id"])
    return out.select("doc_id", *fps, F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))


def _edges(blocks: DataFrame, fps: list[str], radius: int, block: int) -> DataFrame:
    width = 64 * len(fps)
    found = []
    for depth in range(16):
        sizes = blocks.groupBy("block").count()
        large = stage(sizes.filter(F.col("count") > (block if depth < 15 else 2**62)).select(F.col("block").alias("_large")))
        some = large.count()
        small = blocks.join(large, blocks.block == large._large, "left_anti") if some else blocks
        # Rows of a block are neighbours after the sort; a block has at most `block` rows here.
        found.append(small.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _runs(it, len(fps), radius), "a long, b long"))
        if not some:
            break
        # Too large: the same blocks, split by agreement in one of radius + 1 groups of bits, ever other cuts of them.
        cuts = _cuts(width, (radius + 1) * (depth + 2))
        part = [F.xxhash64("block", F.lit(i), *[_bits(fps, *c) for c in cuts[i :: radius + 1]]) for i in range(radius + 1)]
        blocks = stage(blocks.join(large, blocks.block == large._large, "left_semi").select(F.explode(F.array(*part)).alias("block"), "node", *fps))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# -- near-duplicates by the shingle sets themselves ------------------------------------------------


def alike(ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> list[tuple[int, int]]:
    """Stars (id, smaller id) that connect the sets whose Jaccard similarity is at least `least`; sets are sorted, fps within radius + SLACK."""
    order = np.argsort(ids, kind="stable")
    ids, fps, sets = ids[order], fps[order], [sets[i] for i in order.tolist()]
    size = np.array([len(x) for x in sets])
    of = np.arange(len(ids))
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(of[i + 1 :] != of[i]) + i + 1
        low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[low >= least * high - 1e-9]
        rest = rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1) <= radius + SLACK]
        for at in range(0, len(rest), 256):
            some = rest[at : at + 256]
            some = some[of[some] != of[i]]
            if not len(some):
                continue
            if size[i]:
                flat = np.concatenate([sets[j] for j in some.tolist()])
                hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(size[some])[:-1]])
            else:
                both = np.zeros(len(some), np.int64)
            # Equal sets are alike, empty ones too.
            near = some[both >= least * (size[some] + size[i] - both) - 1e-9]
            if len(near):
                joined = np.unique(np.r_[of[i], of[near]])
                of[np.isin(of, joined)] = joined[0]
    return [(int(ids[x]), int(ids[r])) for x, r in enumerate(of.tolist()) if x != r]


def _sets(docs: DataFrame, nodes: DataFrame, words: int, more: int, id_col: str, text_col: str) -> DataFrame:
    """key (of the fingerprint) and set (its sorted shingle hashes) of the documents that name nodes, and of those without an id if any node is nameless."""
    out = pa.schema([("key", pa.string()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [np.unique(shingle_hashes(t or "", words, 42)) for t in part.column(1).to_pylist()]
            keys = [",".join(map(str, np.array(fingerprint(h, more), np.uint64).view(np.int64).tolist())) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([h.tobytes() for h in own], pa.binary())], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = nodes.filter(F.col("node") < NAMELESS).select(F.col("node").alias("_node"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_node"), "left_semi")
    if nodes.filter(F.col("node") >= NAMELESS).limit(1).count():
        own = own.unionByName(rows.filter("doc_id is null"))
    return shipped(own).mapInArrow(run, "key string, set binary")


def _confirmed(docs: DataFrame, fps: list[str], names: DataFrame, edges: DataFrame, words: int, radius: int, least: float, piece: int, id_col: str, text_col: str) -> DataFrame:
    """Stars (a, b) over the pairs of each set of candidates whose shingle sets are alike.

    Candidates that are linked, directly or not, meet with their sets.  If those take more than `piece`
    bytes they are dealt into pieces, each two of which meet in a task of their own.
    """
    found = stage(components(edges))
    roots = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    nodes = stage(names.join(roots, "node").select("node", "root", *fps, F.concat_ws(",", *fps).alias("key")))
    sets = _sets(docs, nodes, words, len(fps), id_col, text_col).groupBy("key").agg(F.max("set").alias("set"))
    rows = stage(nodes.join(sets, "key").select("node", "root", *fps, "set"))
    parts = rows.groupBy("root").agg(F.ceil((F.sum(F.length("set")) + F.lit(64) * F.count(F.lit(1))) / piece).cast("int").alias("parts")).withColumnRenamed("root", "_root")
    dealt = rows.join(parts, F.col("root") == F.col("_root")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") > 1, F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("p"))).otherwise(F.array(F.lit(0)))
    tasks = dealt.withColumn("q", F.explode(others)).select("root", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node", *fps, "set")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        bits = np.stack([group.column(f).to_numpy().view(np.uint64) for f in fps], axis=1)
        got = alike(group.column("node").to_numpy(), bits, [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()], radius, least)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], schema=out) if got else out.empty_table()

    return tasks.groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, more: int = 4, radius: int = 56, bands: tuple[int, int] = (15, 4), least: float = 0.8, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, the one of the smallest doc_id.

    Two texts are near-duplicates when their sets of five-word shingles have a Jaccard similarity of
    `least` or more; groups are the components over such pairs.  Candidates are found by 256-bit
    fingerprints of those sets that differ in 56 bits at most (a similarity of 0.8 differs in 39 on
    average, of 0.7 in 49) and meet in blocks by bands of a sketch: at 0.8 all but one pair in two
    thousand do.  What is linked so is compared by the sets themselves, and only pairs that pass make
    groups.  Equal fingerprints count as equal sets.  Rows with a null doc_id stay.
    """
    fps = [f"fp{i}" for i in range(more)]
    rows = stage(fingerprints(docs, words, 42, more, bands, id_col, text_col, distinct=True))
    names, edges = _candidates(rows, fps, radius, bands, BLOCK)
    links = _confirmed(docs, fps, names, edges, words, radius, least, piece, id_col, text_col)
    found = _named(rows, fps, names, components(links))
    return without_ids(docs, stage(found.filter("doc_id <> component_id").select("doc_id")), id_col)
