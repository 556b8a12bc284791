from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import chunk_dedup, common, exact_dedup, simhash, suffix_dedup

SPACE = "[\x20\x09-\x0d]"


def as_bytes(text):
    return (text or "").encode()


# -- exact ---------------------------------------------------------------------------------------


def test_exact_groups(docs, texts, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for d, t in texts:
        by[re.sub(SPACE, "", t or "")].append((-len(t or ""), float("inf") if d is None else d))
    want = []
    for d, t in texts:
        own = by[re.sub(SPACE, "", t or "")]
        n, keep = min(own)
        keep = None if keep == float("inf") else keep
        want.append((d, keep, len(own), d == keep and -len(t or "") == n, sha256(re.sub(SPACE, "", t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).columns == none.columns


def test_digests_of_several_texts_meet_by_the_text(spark, docs, texts, monkeypatch):
    """With a digest that many texts share the results are the same."""
    want = sorted(str(tuple(r)) for r in exact_dedup.exact_groups(docs).collect())
    kept = sorted(str(tuple(r)) for r in exact_dedup.one_of_each(docs).select("text").collect())
    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.substring(norm, 1, 1))
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_groups(docs).collect()) == want
    assert sorted(str(tuple(r)) for r in exact_dedup.one_of_each(docs).select("text").collect()) == kept


def test_names_that_clash(spark, texts):
    """Columns named like those that the operators make pass through every stage that keeps columns."""
    names = ["doc_id", "text", "_gone", "gone", "_runs", "runs", "cut_of", "_cut_of", "_n_bytes", "_n_removed", "_n_spans", "hot", "of_hot", "cold", "of_cold", "away", "near_by", "key", "norm", "best", "size", "row", "met", "_k", "a", "b", "kept"]
    rows = [(d, t, *[f"{c}{i}" for c in names[2:]]) for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names)).repartition(3)
    slim = docs.select("doc_id", "text")
    for stay in (exact_dedup.exact_dedup, exact_dedup.one_of_each, simhash.near_dedup):
        got = stay(docs)
        assert got.columns == names
        own = got.collect()
        assert {tuple(r) for r in own} <= set(rows) and sorted(str(r.text) for r in own) == sorted(str(r.text) for r in stay(slim).collect())
    cut = chunk_dedup.dedup_substrings(docs)
    assert cut.columns == [*names, "__n_bytes", "__n_removed", "__n_spans"]
    own, plain = cut.collect(), chunk_dedup.dedup_substrings(slim).collect()
    assert sorted(str((r.doc_id, r.text)) for r in own) == sorted(str((r.doc_id, r.text)) for r in plain) and {tuple(r)[2:-3] for r in own} == {r[2:] for r in rows}
    tuple_of = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert tuple_of(suffix_dedup.remove_repeats(docs, digests=True)) == tuple_of(suffix_dedup.remove_repeats(slim, digests=True))
    assert tuple_of(exact_dedup.exact_groups(docs)) == tuple_of(exact_dedup.exact_groups(slim))
    assert tuple_of(simhash.simhash_components(docs)) == tuple_of(simhash.simhash_components(slim))


def test_exact_dedup_keeps_one(spark):
    df = spark.createDataFrame([(i, f"t {i % 7}") for i in range(5000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df).collect()) == list(range(7))


def test_exact_dedup_of_repeated_ids(spark, docs, none):
    rows = [(1, "a"), (1, "b"), (2, "b"), (3, "b "), (4, "c"), (4, "c"), (None, "a"), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    out = exact_dedup.exact_dedup(df)
    # 3 has the longest text of the group b, 5 is the smallest of the empty ones; 1 stays for its other row.
    assert out.columns == df.columns and sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, [(1, "a"), (1, "b"), (3, "b "), (4, "c"), (4, "c"), (None, "a"), (5, None)]))


def test_negative_and_large_ids(spark):
    rows = [(-5, "a"), (3, "a"), (2**62, "b"), (-(2**63), "b"), (None, "b")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-5: -5, 3: -5, 2**62: -(2**63), -(2**63): -(2**63), None: -(2**63)}


# -- near ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps: list[int], radius: int) -> list[int]:
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(fps))]


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_simhash(docs, texts, none, block):
    got = simhash.simhash_components(docs, block=block).collect()
    fps = [plain_fingerprint(t) for _, t in texts]
    assert sorted((r.doc_id is None, r.doc_id, r.fp0 % 2**64) for r in got if r.doc_id is not None) == sorted((False, d, f) for (d, _), f in zip(texts, fps) if d is not None)
    of = classes(fps, 3)
    least = defaultdict(list)
    for (d, _), c in zip(texts, of):
        if d is not None:
            least[c].append(d)
    want = sorted(str((d, f, min(least[c], default=None))) for (d, _), f, c in zip(texts, fps, of))
    assert sorted(str((r.doc_id, r.fp0 % 2**64, r.component_id)) for r in got) == want
    assert simhash.simhash_components(none).count() == 0


def test_bit_sliced_links():
    rng = np.random.default_rng(5)
    for radius, words in ((0, 1), (3, 1), (7, 2), (44, 4)):
        blocks = np.sort(rng.integers(0, 40, 700)).astype(np.uint64)
        blocks[300:500] = blocks[300]
        blocks.sort()
        fps = rng.integers(0, 2**64, (60, words), dtype=np.uint64)[rng.integers(0, 60, 700)] ^ (np.uint64(1) << rng.integers(0, 64, (700, words), dtype=np.uint64))
        got = simhash.links(blocks, fps, np.arange(700), radius)
        parent = list(range(700))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(700):
            for b in range(a):
                if blocks[a] == blocks[b] and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= radius:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        assert sorted(got) == sorted((x, root(x)) for x in range(700) if root(x) != x)


@pytest.mark.parametrize("most", [simhash.TASK_EDGES, 0])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    monkeypatch.setattr(simhash, "TASK_EDGES", most)
    rng = random.Random(1)
    # A root and a node of the largest id that many hang on, chains and chance.
    edges = [(5000, 5001 + i) for i in range(60)] + [(9000, 8000 + i) for i in range(60)]
    if most:
        edges += [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if root(x) != x}


def test_near_dedup(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(40):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        groups.append(len(rows))
        rows.append((len(rows), " ".join(words)))
        for _ in range(g % 3):
            near = [*words]
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(near)))
    kept = sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == groups


def shingle_set(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.mark.parametrize("piece", [simhash.PIECE, 20_000])
def test_near_dedup_decides_by_the_sets(spark, piece):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows: list[tuple[int | None, str]] = []
    for g in range(150):
        words = rng.choices(vocabulary, k=rng.randint(100, 300))
        rows.append((len(rows), " ".join(words)))
        for _ in range(1 + 30 * (g == 0)):  # one block of changed words; the first group is a large one
            n = round(len(words) * rng.choice([0.03, 0.06, 0.13, 0.17, 0.2, 0.25]))
            at = rng.randrange(len(words) - n)
            rows.append((len(rows), " ".join(words[:at] + rng.choices(vocabulary, k=n) + words[at + n :])))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    seen = []
    for a in range(len(rows)):
        for b in range(a):
            if both := len(sets[a] & sets[b]):
                j = both / len(sets[a] | sets[b])
                seen.append(j)
                if j >= 0.8:
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
    assert sum(0.6 <= j < 0.8 for j in seen) > 50 and sum(0.8 <= j < 0.95 for j in seen) > 50
    got = simhash.near_dedup(spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3), piece=piece)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(set(root)) and got.filter("doc_id is null").count() == 1


# -- chunks --------------------------------------------------------------------------------------


def test_cuts_fall_into_step():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(5000))
    ends = chunk_dedup.cuts(data)
    sizes = np.diff(np.r_[0, ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_dedup.MAX_CHUNK and sizes[1:-1].min() >= chunk_dedup.MIN_CHUNK
    moved = chunk_dedup.cuts(b"inserted" + data)
    assert len(set(ends.tolist()) - {e - 8 for e in moved.tolist()}) <= 3
    assert chunk_dedup.cuts(b"").size == 0 and chunk_dedup.cuts(b"x").tolist() == [1]


def test_substrings(docs, texts, none):
    out = chunk_dedup.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "_n_bytes", "_n_removed", "_n_spans"]
    got = out.collect()
    assert len(got) == len(texts) and chunk_dedup.dedup_substrings(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[5].text is None and by[6].text == "" and by[0]._n_removed == 0 and by[1].text == "" and by[None]._n_removed == 0
    whole = dict(texts)
    for i in range(21, 26):
        # The passage of 70 words goes but for the ends of less than a chunk.
        assert by[i]._n_removed > 150 and by[i]._n_spans >= 1 and whole[i].startswith(by[i].text[:40])
    assert by[20]._n_removed == 0 and all(by[i]._n_removed == 0 for i in range(30, 60))
    for r in got:
        assert r._n_bytes - r._n_removed == len(as_bytes(r.text))


def plain_substrings(texts):
    """Chunks by a rolling hash from byte to byte, looked up in a dictionary; runs of MIN_RUN bytes go."""
    first: dict[bytes, int] = {}
    parts = []
    for d, t in texts:
        data, h, cands = as_bytes(t), 0, []
        for i, c in enumerate(data):
            h = (h << 1) + int(chunk_dedup.GEAR[c]) & 0xFFFF
            if i >= 15 and h >> 16 - chunk_dedup.CUT_BITS == 0 and i + 1 < len(data):
                cands.append(i + 1)
        marks = [0, *[x for i, x in enumerate(cands) if not i or x - cands[i - 1] >= chunk_dedup.MIN_CHUNK], len(data)]
        ends = [e for a, b in zip(marks, marks[1:]) for e in [*range(a + chunk_dedup.MAX_CHUNK, b, chunk_dedup.MAX_CHUNK), b]] if data else []
        own = list(zip([0, *ends], ends))
        parts.append((d, data, own))
        for a, b in own if d is not None else ():
            first[data[a:b]] = min(first.get(data[a:b], d), d)
    dups = {}  # rows that repeat an id are one document
    for d, data, own in parts:
        if d is not None:
            dups.setdefault(d, set()).update((a, b) for a, b in own if first[data[a:b]] < d)
    for d, data, _ in parts:
        runs: list[list[int]] = []
        for a, b in sorted(dups.get(d, ())):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out, at = b"", 0
        for a, b in runs:
            if b - a < chunk_dedup.MIN_RUN:
                continue
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            out, at = out + data[at:a], max(at, b)
        yield d, (out + data[at:]).decode()


def test_substrings_by_brute_force(spark, docs, texts):
    rng = random.Random(21)
    passages = ["".join(rng.choices("abcdefgh äöü漢", k=rng.randint(60, 400))) for _ in range(8)]
    rows = [*texts, *[(1000 + i, "".join(rng.choice(passages) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijkl ", k=rng.randint(1, 80))) for _ in range(12))) for i in range(60)]]
    got = chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), t) for d, t in plain_substrings(rows))
    assert sum(r._n_removed > 0 for r in got) > 30


def test_substrings_without_broadcast(docs, monkeypatch):
    want = sorted(str(r) for r in chunk_dedup.dedup_substrings(docs).collect())
    monkeypatch.setattr(chunk_dedup, "BROADCAST_SPANS", 0)
    assert sorted(str(r) for r in chunk_dedup.dedup_substrings(docs).collect()) == want


# -- suffix arrays -------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(800):
        n, k = rng.randint(1, 50), rng.choice([1, 2, 3, 200])
        s = [rng.randint(1, k) for _ in range(n)]
        assert suffix_dedup.suffix_array(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:])


def plain_repeats(texts, width=50):
    first: dict[bytes, int] = {}
    for d, t in texts:
        b = as_bytes(t)
        for i in range(len(b) - width + 1 if d is not None else 0):
            w = b[i : i + width]
            first[w] = min(first.get(w, d), d)
    for d, t in texts:
        b = as_bytes(t)
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1 if d is not None else 0):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats(docs, texts, none, hot):
    got = suffix_dedup.remove_repeats(docs, digests=True, hot=hot).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, plain_repeats(texts)))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_in_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(60 + i, rows[rng.randrange(60)][1] + "c" * i + rows[rng.randrange(60)][1]) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(df, digests=True).collect()) == sorted(map(str, plain_repeats(rows)))


def test_arrays_that_would_overflow_are_refused(docs):
    with pytest.raises(ValueError):
        suffix_dedup.suffix_array(np.ones(suffix_dedup.LONGEST + 1, np.int64))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, hot=100_000)


def test_anchors_agree():
    rng = random.Random(6)
    text = bytes(rng.choice(b"abc ") for _ in range(4000))
    key, first, last = suffix_dedup.anchors(text)
    assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
    part, a, b = suffix_dedup.anchors(text[1000:1400])
    of = {}
    for k, x, y in zip(key.tolist(), first.tolist(), last.tolist()):
        of.update({i: k for i in range(x, y + 1)})
    for k, x, y in zip(part.tolist(), a.tolist(), b.tolist()):
        assert all(of[1000 + i] == k for i in range(x, y + 1))
