"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from the labelled sample: all whole words and word beginnings of four and five
bytes that at least LEAST toxic documents hold (or the share LEAST_SHARE of them) and that are by
LEVELS[0] in log odds more frequent in those than in others.  Features of a text are rates of lexicon
hits by strength, their nearness to second-person words, capitals, punctuation and obfuscation.  The one
bound is `sample`: at most so many labelled documents are fitted on, the first by a hash of their id.
Only their features (`sample` rows of about 30 numbers) and the counts of their frequent terms reach the
driver.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, stage

SAMPLE = 20_000
LEAST, LEAST_SHARE = 4, 0.004
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
FOLDS = 5

#: Words that address a reader, in the languages of the tables.
SECOND = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in _LOWER)
_PUNCT = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_DIGIT = bytes(x for x in range(256) if not 48 <= x <= 57)
_MIXED = re.compile(rb"[a-z\x80-\xff]+[0-9@$!|+*][a-z0-9@$!|+*\x80-\xff]*[a-z\x80-\xff]")
_SPACED = re.compile(rb"(?<![a-z\x80-\xff])(?:[a-z][.\-_*]){3,}[a-z](?![a-z\x80-\xff])")
_LONG_RUN = re.compile(rb"(.)\1{3,}", re.S)
LEVELS = (2.0, 3.5, 5.0)


def terms(word: bytes) -> tuple[bytes, ...]:
    """The lexicon's entries that a word may match, longest first; beginnings end in a star."""
    if len(word) < 4:
        return (word,)
    return (word, word[:5] + b"*", word[:4] + b"*") if len(word) > 5 else (word, word[:4] + b"*") if len(word) > 4 else (word,)


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    raw = text.encode("utf-8", "replace")
    low = raw.translate(_LOWER)
    words = low.translate(_LETTERS).split()
    n, size = max(1, len(words)), max(1, len(raw))
    get = lexicon.get
    hits: list[tuple[int, float]] = []
    for i, w in enumerate(words):
        s = get(w)
        if s is None and len(w) > 4:
            s = get(w[:5] + b"*") if len(w) > 5 else None
            if s is None:
                s = get(w[:4] + b"*")
        if s is not None:
            hits.append((i, s))
    second = [i for i, w in enumerate(words) if w in SECOND]
    close = 0
    if second and hits:
        at = np.array(second)
        for i, _ in hits:
            j = int(np.searchsorted(at, i))
            if min((abs(int(at[x]) - i) for x in (j - 1, j) if 0 <= x < len(at)), default=99) <= 4:
                close += 1
    mixed = _MIXED.findall(low)
    spaced = _SPACED.findall(low)
    hidden = 0
    for w in mixed:
        hidden += any(t in lexicon for t in terms(w.translate(DISGUISE).replace(b"*", b"")))
    for w in spaced:
        hidden += any(t in lexicon for t in terms(re.sub(rb"[^a-z]", b"", w)))
    level = [sum(1 for _, s in hits if a <= s < b) for a, b in zip(LEVELS, (*LEVELS[1:], math.inf))]
    strong = sorted((s for _, s in hits), reverse=True)[:3]
    distinct = len({words[i] for i, _ in hits})
    upper = len(raw.translate(None, _NOT_UPPER))
    punct = size - len(raw.translate(None, _PUNCT))
    digits = len(raw.translate(None, _NOT_DIGIT))
    loud = sum(1 for w in raw.split() if len(w) > 2 and w.isupper())
    return [
        math.log1p(len(hits)), len(hits) / n, *(math.log1p(x) for x in level), *(x / n for x in level),
        strong[0] if strong else 0.0, sum(strong), sum(s for _, s in hits) / n, math.log1p(distinct),
        len(second) / n, close / n, math.log1p(close),
        upper / size, loud / n, punct / size, raw.count(b"!") / size, raw.count(b"?") / size, digits / size,
        len(mixed) / n, len(spaced) / n, hidden / n, math.log1p(hidden), len(_LONG_RUN.findall(raw)) / n,
        math.log1p(n), size / n, len(set(words)) / n,
    ]


# -- trees -----------------------------------------------------------------------------------------


class Boosted:
    """Binary classification by boosted trees of equal depth on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(rate / (1 - rate))
        self.trees = []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            tree = []
            for depth in range(DEPTH):
                k = 1 << depth
                gs = np.stack([np.bincount(node * BINS + c, g, k * BINS).reshape(k, BINS) for c in b.T])
                hs = np.stack([np.bincount(node * BINS + c, h, k * BINS).reshape(k, BINS) for c in b.T])
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                flat = gain.transpose(1, 0, 2).reshape(k, -1)
                best = flat.argmax(1)
                column, cut = best // BINS, best % BINS
                cut = np.where(flat[np.arange(k), best] > 1e-9, cut, BINS)
                tree.append((column, cut))
                node = node * 2 + (b[np.arange(len(y)), column[node]] > cut[node])
            k = 1 << DEPTH
            leaf = RATE * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for column, cut in tree:
                node = node * 2 + (b[rows, column[node]] > cut[node])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x, p) of the best monotone fit of y, to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    px, py = [], []
    for s, w, a, b in blocks:
        # A little smoothing keeps certainty out of small pools.
        px += [a, b] if b > a else [a]
        py += [(s + 0.1) / (w + 0.2)] * (2 if b > a else 1)
    return np.array(px), np.maximum.accumulate(np.array(py))


class Model:
    """Lexicon, trees and calibration; with too few labels of either kind the score is the base rate."""

    def __init__(self, lexicon: dict[bytes, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon = lexicon
        self.rate = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        self.trees = None
        if 5 <= y.sum() <= len(y) - 5:
            # Scores for the calibration come from trees that haven't seen the row.
            out = np.zeros(len(y))
            for f in range(3):
                away = fold % 3 == f
                if away.any() and y[~away].sum() and not y[~away].all():
                    out[away] = Boosted().fit(x[~away], y[~away]).margin(x[away])
            self.map = isotonic(out, y)
            self.trees = Boosted().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        # A trace of the margin keeps the order within the steps of the calibration, and never crosses a half.
        m = self.trees.margin(x)
        p = np.interp(m, *self.map)
        fine = p + (1 / (1 + np.exp(-m)) - p) * 1e-3
        return np.clip(np.where(p >= 0.5, np.maximum(fine, 0.5), np.minimum(fine, np.nextafter(0.5, 0))), 0, 1)


# -- on tables -------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows whose crc32(id as text) mod FOLDS isn't 0, at most `sample` of them."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 1).alias("toxic")).dropna()
    known = known.filter(crc % FOLDS != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most `sample` ids and flags, so that the texts are met where they are read.
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    both = known.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    toxic, clean = both[0], both[1]

    def count(only: frozenset[bytes] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: Counter = Counter()
            for part in slices(batches):
                for text in part.column(0).to_pylist():
                    found = {t for w in set(text.encode("utf-8", "replace").translate(_LETTERS).split()) for t in terms(w)}
                    got.update(found if only is None else found & only)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["term", "n"])

        return run

    least = max(LEAST, int(LEAST_SHARE * toxic))
    totals = lambda df, only: df.select("text").mapInArrow(count(only), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # The frequent terms of the sample's toxic documents; then how many of its other documents hold those.
    often = totals(rows.filter("toxic"), None).filter(F.col("n") >= least).collect()
    held = {bytes(r.term): r.n for r in often}
    # One term in both counts: the same rule for all labelled rows of the sample.
    other = {bytes(r.term): r.n for r in totals(rows.filter("not toxic"), frozenset(held)).collect()} if held else {}
    odds = {t: math.log((n + 0.5) / (toxic + 1)) - math.log((other.get(t, 0) + 0.5) / (clean + 1)) for t, n in held.items()}
    lexicon = {t: odds[t] for t in sorted(odds) if odds[t] >= LEVELS[0]}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [features(t, lexicon) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    # One row for each labelled id, also where rows repeat an id: of its texts the one of the least features.
    measured = rows.mapInArrow(measure, "doc_id long, toxic boolean, x array<double>")
    got = measured.groupBy("doc_id").agg(F.min(F.struct("toxic", "x")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, len(features("", {})))
    y = got.column("toxic").to_numpy().astype(np.float64)
    return Model(lexicon, x, y, np.array([zlib.crc32(str(i).encode()) // FOLDS % 3 for i in got.column("doc_id").to_pylist()], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None) -> DataFrame:
    """doc_id and score for each row; or, with keep, the rows of docs whose score is less than that, as they are.

    Null and empty texts are scored like any text, by features of nothing.  Null and repeated ids
    pass through; an empty table gives no rows.
    """
    text, doc = docs.columns.index(text_col), docs.columns.index(id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred terms and TREES small trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            if not part.num_rows:
                continue
            s = own.score(np.array([features(t or "", own.lexicon) for t in part.column(1 if keep is None else text).to_pylist()]))
            if keep is None:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])
            else:
                yield part.filter(pa.array(s < keep))

    if keep is not None:
        return shipped(docs).mapInArrow(run, docs.schema)
    return shipped(docs).select(F.col(docs.columns[doc]).cast("long").alias("doc_id"), F.col(docs.columns[text]).cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text mod FOLDS is 0; never for a null id), score, predicted."""
    out = score(docs, fit(docs, labels))
    away = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", away.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
