"""Operator 9: nearest neighbours by cosine with a vantage-point tree per shard.

Index.  A tree of vantage points over a bounded sample (SAMPLE vectors, the first by a hash of their id)
cuts the space into regions of about `shard` vectors; each vector walks down to its region, so a shard
holds neighbours.  A region that grows beyond that is cut further by a hash of the ids.  In each shard a
vantage-point tree is built once, over unit vectors under the chord distance (a metric that orders like
the cosine); vectors and tree are kept as one row.

Search.  Queries of the index's own rows are answered first where they live, by the task that builds the
tree.  The distance of the k-th best found there bounds the rest of the search: by the triangle inequality
each query goes on only to regions that can hold anything nearer, and meets the kept trees there.  Both
the choice of regions and the walk through a tree skip what is further than `factor` times the bound, so 1
is exact and less skips more.  How many regions are left to a query is the data's affair: few where
vectors cluster, all where distances hardly differ.

Copies.  Equal vectors tie, so of each vector only the smallest ids are indexed (k and as many as a query
may have to leave out for being its own), and each is asked for once.  They are merged in their shard;
if some vector has more than COPIES rows, all are merged by aggregation first, so that a group of copies
is no heavier than another vector.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, shipped, slices, stage

SHARD = 8192
#: Visiting queries that a task holds.
BLOCK = 32_768
#: Vectors of the sample for each region, the most regions and the most numbers of the sample; they bound what reaches the driver and is broadcast.
SAMPLE, REGIONS, NUMBERS = 64, 4096, 1 << 23
COPIES = 1000
LEAF = 256
#: Candidates are ranked by a fast product first.  Rounding moves its squared chords by less than this for each component
#: of a vector; those as close as that to the k-th best are all ranked exactly.
NEAR = 8 * 2.0**-52


class Tree:
    """A vantage-point tree over unit vectors: nodes are (row, radius, inner, outer) or an array of rows."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.near = _near(unit)
        self.nodes: list = []
        self.visited = 0
        self.root = self._build(np.arange(len(unit)), 0)

    def _build(self, rows: np.ndarray, depth: int):
        if len(rows) <= self.leaf or depth > 40:
            self.nodes.append(rows)
            return len(self.nodes) - 1
        best, d = _vantage(self.unit, rows)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        node = len(self.nodes)
        self.nodes.append(None)
        inner = self._build(rows[order[:half]], depth + 1)
        outer = self._build(rows[order[half:]], depth + 1)
        self.nodes[node] = (best, float(d[order[half]]), inner, outer)
        return node

    def search(self, queries: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows within reach of each unit query (the k nearest and whatever is as near as the k-th, but for rounding), and the k-th's squared chord.

        within: squared chords beyond which a query has no use for anything.
        """
        self.queries, self.k, self.factor = queries, k, factor
        self.best = np.full((len(queries), k), np.inf) if within is None else np.repeat(within[:, None], k, axis=1)
        self.tau = self.best.max(axis=1)
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        self._walk(self.root, np.arange(len(queries)))
        out = []
        for tau, parts in zip(self.tau, self.found):
            rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int64)
            d = np.concatenate([d for _, d in parts]) if parts else np.zeros(0)
            out.append(np.unique(rows[d <= tau + self.near]))
        return out, self.tau

    def _walk(self, node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        at = self.nodes[node]
        if isinstance(at, np.ndarray):
            if not len(at):
                return
            self.visited += len(q) * len(at)
            d = _squared(self.queries[q], self.unit[at])
            both = np.concatenate([self.best[q], d], axis=1)
            both.partition(self.k - 1, axis=1)
            self.best[q] = both[:, : self.k]
            self.tau[q] = self.best[q].max(axis=1)
            hit = d <= self.tau[q][:, None] + self.near
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                self.found[q[i]].append((at[hit[i]], d[i][hit[i]]))
            return
        row, radius, inner, outer = at
        d = _squared(self.queries[q], self.unit[row : row + 1])[:, 0]
        near = d < radius * radius
        self._walk(inner, q[near])
        self._walk(outer, q[~near])
        out, back = q[near], q[~near]
        self._walk(outer, out[_gap(radius, d[near], self.near, True) <= _reach(self.tau[out], factor=self.factor, near=self.near)])
        self._walk(inner, back[_gap(radius, d[~near], self.near, False) <= _reach(self.tau[back], factor=self.factor, near=self.near)])


def _near(unit: np.ndarray) -> float:
    return NEAR * (unit.shape[1] + 4)


def _vantage(unit: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """Of a few rows spread over all, the one whose distances vary most, and those distances."""
    some = rows[:: max(1, len(rows) // 8)][:8]
    d = np.sqrt(_squared(unit[some], unit[rows]))
    best = int(np.argmax(d.var(axis=1)))
    return int(some[best]), d[best]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared chords, whose rounding errors are as small near zero as elsewhere."""
    return np.maximum(0, 2 - 2 * (a @ b.T))


def _gap(radius: float, d: np.ndarray, near: float, inside: bool) -> np.ndarray:
    """How far at least a point with squared chord d to a vantage point is from what lies beyond the radius (inside: from within it), as far as rounding may have moved it."""
    least = lambda x: np.sqrt(np.maximum(0, x - near))
    most = lambda x: np.sqrt(x + near)
    r = radius * radius
    return least(r) - most(d) if inside else least(d) - most(r)


def _reach(tau: np.ndarray, factor: float, near: float) -> np.ndarray:
    return factor * np.sqrt(tau + 2 * near)


class Regions:
    """A tree of vantage points that cuts the space of vectors of one length; leaves are numbered from 0."""

    def __init__(self, unit: np.ndarray, count: int):
        self.near = _near(unit)
        self.nodes: list = []
        self.count = 0
        self._cut(unit, np.arange(len(unit)), count)

    def _cut(self, unit: np.ndarray, rows: np.ndarray, count: int) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        if count <= 1 or len(rows) < 2:
            self.nodes[node] = self.count
            self.count += 1
            return node
        best, d = _vantage(unit, rows)
        order = np.argsort(d, kind="stable")
        at = len(rows) * (count // 2) // count
        inner = self._cut(unit, rows[order[:at]], count // 2)
        outer = self._cut(unit, rows[order[at:]], count - count // 2)
        self.nodes[node] = (unit[best].copy(), float(d[order[at]]), inner, outer)
        return node

    def home(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, q = todo.pop()
            at = self.nodes[node]
            if not len(q):
                continue
            if isinstance(at, int):
                out[q] = at
                continue
            point, radius, inner, outer = at
            # Distances beyond any doubt of rounding aren't needed here: a vector lives where this puts it.
            near = _squared(unit[q], point[None])[:, 0] < radius * radius
            todo += [(inner, q[near]), (outer, q[~near])]
        return out

    def others(self, unit: np.ndarray, tau: np.ndarray, factor: float) -> list[list[int]]:
        """For each query the regions that may hold anything within its bound (a squared chord)."""
        out: list[list[int]] = [[] for _ in unit]
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, q = todo.pop()
            at = self.nodes[node]
            if not len(q):
                continue
            if isinstance(at, int):
                for i in q.tolist():
                    out[i].append(at)
                continue
            point, radius, inner, outer = at
            d = _squared(unit[q], point[None])[:, 0]
            reach = _reach(tau[q], factor, self.near)
            todo.append((outer, q[_gap(radius, d, self.near, True) <= reach]))
            todo.append((inner, q[_gap(radius, d, self.near, False) <= reach]))
        return out


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    _, exponent = np.frexp(np.abs(v).max(axis=-1, keepdims=True))
    return np.ldexp(v, -exponent)


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v.astype(np.float64))
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q with each row of x, in double precision, summed from the first component to the last."""
    q, x = scaled(q), scaled(x)
    total = lambda v: np.cumsum(v, axis=-1)[..., -1]
    return total(q * x) / np.sqrt(total(q * q) * total(x * x))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _answers(tree: Tree, vectors: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, k: int, factor: float, within: np.ndarray | None) -> tuple[list[list[tuple[float, int]]], np.ndarray]:
    """(negative score, vec_id) of the k best rows for each query, best first, ties by id; and the bound on squared chords."""
    rows, tau = tree.search(units(queries), k, factor, within)
    out = []
    for q, own in zip(queries.astype(np.float64), rows):
        scores = cosine(q, vectors[own].astype(np.float64))
        out.append(sorted((-s, int(v)) for s, r in zip(scores.tolist(), own.tolist()) for v in ids[r])[:k])
    return out, tau


def _rows(vectors: DataFrame, is_query: str, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec, h (its hash) and asks (whether it is a query) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = "float" if "float" in dict(vectors.dtypes)[vec_col] else "double"
    rows = shipped(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    )
    # Zeros of either sign are one number.
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))
    return rows.withColumn("h", F.xxhash64("vec"))


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """One row per different vector: vec, ids (the smallest, `most` of them) and asks (how many rows of it do)."""
    pairs = rows.groupBy("h", "vec", "vec_id").agg(F.count_if("asks").alias("asks"))
    # Window limits keep `most` rows of a vector in each task before the shuffle, so copies don't meet in one.
    least = pairs.withColumn("r", F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))).filter(F.col("r") <= most)
    ids = least.groupBy("h", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = pairs.filter("asks > 0").groupBy("h", "vec").agg(F.sum("asks").alias("asks"))
    return ids.join(asked, ["h", "vec"], "left").select("h", "vec", "ids", F.coalesce("asks", F.lit(0).cast("long")).alias("asks"))


def _cut(rows: DataFrame, counts: dict[int, int], shard: int) -> dict[int, tuple[Regions | None, int]]:
    """For each length of vectors their regions and how many parts each region has."""
    out: dict[int, tuple[Regions | None, int]] = {}
    for dim, n in counts.items():
        want = -(-n // shard)
        out[dim] = (None, want)
        count = min(want, REGIONS)
        if want > 1 and (some := min(count * SAMPLE, NUMBERS // dim)) > 1:
            near = F.col("h").cast("double") / 2.0**64 + 0.5 < F.lit(some / n)
            got = rows.filter((F.size("vec") == dim) & near).orderBy("h").limit(some).select("vec").toArrow()
            if got.num_rows > 1:
                own = Regions(units(_matrix(got.column("vec"))), count)
                out[dim] = (own, -(-want // own.count))
    return out


def _local(group: pa.Table, most: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Different vectors of a shard, the smallest ids of each and how many rows of it ask."""
    x, asks = _matrix(group.column("vec")), group.column("asks").to_numpy()
    ids = [np.array(i, np.int64) for i in group.column("ids").to_pylist()]
    _, first, of = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    if len(first) == len(x):
        return x, ids, asks
    by = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
    return x[first], [np.unique(np.concatenate([ids[i] for i in own.tolist()]))[:most] for own in by], np.bincount(of, asks).astype(np.int64)


_FOUND = pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())]))
_INDEX = "dim int, region long, part long, tree binary, vec array<{0}>, asks long, tau double, found array<struct<s:double,v:long>>"


def nearest(vectors: DataFrame, is_query: str, k: int = 5, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the SQL condition is_query its k nearest other rows.

    Rows whose id or vector is null, or whose vector is empty, zero or holds a null or a non-finite
    component, take no part.  Vectors are compared with those of the same length only.  Rows that
    repeat both id and vector are one candidate; rows that repeat an id alone are candidates each, but
    never of a query with that id.  Fewer than k candidates give fewer rows; an empty table gives none.
    Other columns are not looked at.
    """
    rows = _rows(vectors, is_query, id_col, vec_col)
    # As many rows as a query's id has may have to be left out of its neighbours.
    own = rows.filter("asks").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    most = k + (own or 1)
    sizes = rows.groupBy("h", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("each"), F.max("n").alias("copies")).collect()
    hot = max((c.copies for c in counts), default=0) > COPIES
    each = stage(_merged(rows, most)) if hot else rows.select("h", "vec", F.array("vec_id").alias("ids"), F.col("asks").cast("long").alias("asks"))
    regions = _cut(each, {c.dim: c["each"] if hot else c.n for c in counts}, shard)
    shared = vectors.sparkSession.sparkContext.broadcast(regions)  # REGIONS vectors for each length at most
    kind = "float" if "array<float>" in dict(each.dtypes)["vec"] else "double"
    arrow = pa.float32() if kind == "float" else pa.float64()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            dims = part.column(0).to_numpy()
            region, piece = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.int64)
            own = part.column(1)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cut, parts = shared.value[dim]
                if cut is not None:
                    region[at] = cut.home(units(_matrix(own.take(pa.array(at)))))
                piece[at] = part.column(4).to_numpy()[at] % parts
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(region), pa.array(piece), own, part.column(2), part.column(3)], names=["dim", "region", "part", "vec", "ids", "asks"])

    placed = each.select(F.size("vec").alias("dim"), "vec", "ids", "asks", F.pmod("h", F.lit(2**31 - 1)).alias("deal")).mapInArrow(place, f"dim int, region long, part long, vec array<{kind}>, ids array<long>, asks long")
    made = pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("part", pa.int64()), ("tree", pa.binary()), ("vec", pa.list_(arrow)), ("asks", pa.int64()), ("tau", pa.float64()), ("found", _FOUND)])

    def build(group: pa.Table) -> pa.Table:
        """The shard's tree, and what its own queries find in it."""
        x, ids, n = _local(group, most)
        tree = Tree(units(x))
        asks = np.flatnonzero(n)
        found, tau = _answers(tree, x, ids, x[asks], most, factor, None) if len(asks) else ([], np.zeros(0))
        key = [group.column(c)[0].as_py() for c in ("dim", "region", "part")]
        blob = pickle.dumps((tree.nodes, tree.root, x, ids))
        out = [(*key, blob, None, 0, None, None)]
        # No squared chord is above 4.  Copies count: enough ids found bound the search before as many vectors are.
        bound = [min(t, 4.0, 2 + 2 * f[-1][0] + tree.near if len(f) >= most else 4.0) for t, f in zip(tau.tolist(), found)]
        out += [(*key, None, q, a, t, [{"s": -s, "v": v} for s, v in f]) for q, a, t, f in zip(x[asks].tolist(), n[asks].tolist(), bound, found)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

    index = stage(placed.groupBy("dim", "region", "part").applyInArrow(build, _INDEX.format(kind)))
    at_home = index.filter("asks > 0")
    found = at_home.select("vec", F.col("asks").alias("n"), "found")
    if any(cut is not None or parts > 1 for cut, parts in regions.values()):
        found = found.unionByName(_visits(index, at_home, shared, kind, most, factor, block).withColumn("n", F.lit(0).cast("long")))
        # At most `most` of each shard that a vector was sent to.
        lists = found.groupBy(F.xxhash64("vec").alias("h"), "vec").agg(F.max("n").alias("n"), F.flatten(F.collect_list("found")).alias("found"))
        nearer = lambda a, b: F.when((a["s"] > b["s"]) | ((a["s"] == b["s"]) & (a["v"] < b["v"])), -1).when((a["s"] == b["s"]) & (a["v"] == b["v"]), 0).otherwise(1)
        found = lists.select("vec", "n", F.slice(F.array_sort("found", nearer), 1, most).alias("found"))
    asked = rows.filter("asks").select("vec_id", "vec")
    if hot:
        return _ranked(lookup(asked, stage(found), "vec", "n", ["found"]), k)
    return _ranked(asked.join(found.select("vec", "found"), "vec"), k)


def _visits(index: DataFrame, at_home: DataFrame, shared, kind: str, most: int, factor: float, block: int) -> DataFrame:
    """vec and found: what queries find in shards other than their own."""
    arrow = pa.float32() if kind == "float" else pa.float64()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the shards, other than their own, that may hold anything nearer."""
        for part in slices(batches, 256):
            out = []
            dims, home, piece = (part.column(i).to_numpy() for i in range(3))
            tau = part.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cut, parts = shared.value[dim]
                own = part.column(3).take(pa.array(at))
                x = _matrix(own)
                to = cut.others(units(x), tau[at], factor) if cut is not None else [[0]] * len(at)
                for i, regions_of, v in zip(at.tolist(), to, x.tolist()):
                    out += [(dim, r, p, v, float(tau[i])) for r in regions_of for p in range(parts) if (r, p) != (home[i], piece[i])]
            for lo in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 4096]), (pa.int32(), pa.int64(), pa.int64(), pa.list_(arrow), pa.float64()))], names=["dim", "region", "part", "vec", "tau"])

    sent = stage(at_home.select("dim", "region", "part", "vec", "tau").mapInArrow(send, f"dim int, region long, part long, vec array<{kind}>, tau double"))
    # A shard that many queries visit has its tree in several tasks.
    keys = ["dim", "region", "part"]
    shard_key = F.concat_ws("/", *keys).alias("at")
    loads = stage(sent.groupBy(shard_key).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long")))
    sent = lookup(sent.select(*keys, "vec", "tau", shard_key), loads, "at", "n", ["blocks"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")))
    trees = index.filter("tree IS NOT NULL").select(*keys, "tree", shard_key).join(loads, "at").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of the queries that come to a shard."""
        schema = pa.schema([("vec", pa.list_(arrow)), ("found", _FOUND)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        nodes, root, x, ids = pickle.loads(left.column("tree")[0].as_py())
        tree = Tree.__new__(Tree)
        tree.unit, tree.nodes, tree.root, tree.visited = units(x), nodes, root, 0
        tree.near = _near(tree.unit)
        q, tau, out = _matrix(right.column("vec")), right.column("tau").to_numpy(), []
        for lo in range(0, len(q), 4096):
            found, _ = _answers(tree, x, ids, q[lo : lo + 4096], most, factor, tau[lo : lo + 4096])
            out += [(v, [{"s": -s, "v": i} for s, i in f]) for v, f in zip(q[lo : lo + 4096].tolist(), found) if f]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return trees.select(*keys, "block", "tree").groupBy(*keys, "block").cogroup(sent.select(*keys, "block", "vec", "tau").groupBy(*keys, "block")).applyInArrow(visit, f"vec array<{kind}>, found array<struct<s:double,v:long>>")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    own: Column = F.slice(F.filter("found", lambda x: x["v"] != F.col("vec_id")), 1, k)
    return found.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.v").alias("vec_id"), F.col("x.s").alias("score"))
