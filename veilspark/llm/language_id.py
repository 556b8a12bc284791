"""Operator 4: language identification by Bayesian fusion of evidence.

Three kinds of evidence meet in one posterior per row, as sums of logarithms:
- the text: multinomial likelihoods of hashed byte trigrams, tempered, since trigrams aren't independent;
- the language that the markup declares, by how often it goes with each language over all rows (grouped
  sums of the texts' own posteriors, smoothed);
- the prior of the host: the mean of its other rows' posteriors, smoothed towards that of its address's
  suffix, which is smoothed towards the mean of all rows.
So a suffix counts once, as the host's parent, and a row's own text is no evidence for its own prior.
The trigram model is fitted on at most SAMPLE labelled documents per language, the first by a hash of
their id.  The sums cover all rows.  Rows look up what their host, suffix and declared language have by
common.lookup, so a host with a third of all rows is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, shipped, slices, stage
from .html_extraction import Page, host

SAMPLE = 1500
#: Languages whose trigrams are added up at a time.
BLOCK = 64
CELLS = 1 << 15
#: The text's evidence counts as so many trigrams at most.
TEMPER = 60.0
#: Pseudo-rows of a parent in a child's prior, and of each value in the counts of declared languages.
HOST_ROWS = 5.0
VALUE_ROWS = 1.0
_DECLARED = re.compile(r"<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)


def two_letters(spark) -> dict[str, str]:
    """The two-letter code of each language whose three-letter code the Java library knows."""
    locale = spark._jvm.java.util.Locale
    return {locale.forLanguageTag(x).getISO3Language(): x for x in locale.getISOLanguages()}


def cells(data: bytes) -> np.ndarray:
    """Hashed trigrams of the text in lower case, with everything but letters as one space."""
    words = data.translate(_LETTERS).split()
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(17)).astype(np.int64)


_LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def counts(data: bytes) -> np.ndarray:
    out = np.zeros(CELLS, np.int64)
    for at in range(0, max(1, len(data)), 1 << 16):
        out += np.bincount(cells(data[at : at + (1 << 16)]), minlength=CELLS)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each trigram cell in each, for every label that occurs (128 KB each)."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(lang_col)).alias("lang")).dropna()
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return ["und"], np.zeros((1, CELLS))
    # For each language its own first rows by a hash; both steps keep at most `sample` rows of each language and task.
    share = known.withColumn("h", F.xxhash64("doc_id"))
    least = share.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (F.lit(2.0 * sample) / F.col("n")).alias("part"))
    near = share.join(F.broadcast(least), "lang").filter((F.col("part") >= 1) | ((F.col("h").cast("double") / 2.0**64 + 0.5) < F.col("part")))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= sample)
    chosen = stage(first.select("doc_id", F.col("lang").alias("_lang")))
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts((text or "").encode("utf-8", "replace"))
                total[index[lang]] = total[index[lang]] + own if index[lang] in total else own
        for i, own in total.items():
            some = np.flatnonzero(own)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i)), pa.array(some), pa.array(own[some])], names=["l", "c", "n"])

    rows = shipped(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("text", "_lang").mapInArrow(run, "l long, c long, n long")
    got = rows.groupBy("l", "c").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows for each language at most
    table = np.full((len(langs), CELLS), 0.5)
    table[got.column("l").to_numpy(), got.column("c").to_numpy()] += got.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows(doc_id, page_id, url, host, body, is_html) with declared and p (the text's own posterior under equal priors) for the last two.

    A declared language is its code of two letters, or of three where there is none of two.
    """
    langs, table = model
    short = two_letters(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # CELLS numbers for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            declared, posts = [], []
            for body, is_html in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                body = body or ""
                said = _DECLARED.search(body) if is_html else None
                declared.append(short.get(said[1].lower(), said[1].lower()) if said else None)
                if is_html:
                    page = Page(body)
                    body = " ".join([t for x, t in page.blocks if page.says[x] != 2])
                data = body.encode("utf-8", "replace")
                score, n = np.zeros(len(langs)), 0
                for at in range(0, len(data), 1 << 16):
                    c = cells(data[at : at + (1 << 16)])
                    for lo in range(0, len(langs), BLOCK):
                        score[lo : lo + BLOCK] += own[lo : lo + BLOCK, c].sum(axis=1, dtype=np.float64)
                    n += len(c)
                score *= min(1.0, TEMPER / n) if n else 0.0
                p = np.exp(score - score.max())
                posts.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(5), pa.array(declared, pa.string()), pa.array(posts, pa.list_(pa.float64()))], names=["doc_id", "page_id", "url", "host", "is_html", "declared", "p"])

    return shipped(rows).mapInArrow(run, "doc_id long, page_id long, url string, host string, is_html boolean, declared string, p array<double>")


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows(host, suffix, declared, p, ..) with lang, confidence and text_lang in the place of p.

    Missing evidence is neutral, and ties go to the language that comes first.  A row's own p is taken
    out of the sums of its host, its suffix and all rows before they become its prior.
    """
    k = len(langs)
    mean = [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias("s")]
    n_all, s_all = (lambda base: (base.n, [x or 0.0 for x in base.s]))(rows.agg(*mean).first())
    # Hosts of documents and of pages are different things, whatever their names.
    kind = F.when(F.col("is_html"), "host ").otherwise("source ")
    keyed = rows.withColumns({"_host": F.concat(kind, "host"), "_suffix": F.concat(kind, F.coalesce("suffix", F.lit("")))})
    hosts, suffixes = (stage(keyed.groupBy(c).agg(*mean).select(c, "n", F.struct("n", "s").alias(f"of{c}"))) for c in ("_host", "_suffix"))
    values = stage(rows.filter("declared IS NOT NULL").groupBy("declared").agg(*mean))
    n_values = values.count() + 1
    total = values.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s")).first().s
    like = F.array(*[F.log((F.col("s")[i] + VALUE_ROWS) / F.lit((total[i] or 0.0) + VALUE_ROWS * n_values)) for i in range(k)])
    out = lookup(keyed, hosts, "_host", "n", ["of_host"])
    out = lookup(out, suffixes, "_suffix", "n", ["of_suffix"])
    out = lookup(out, values.select("declared", "n", like.alias("like")), "declared", "n", ["like"])

    def score(i: int) -> Column:
        p = F.col("p")[i]
        all_rows = (F.lit(s_all[i]) - p + 1.0) / (n_all - 1 + k)
        parent = (F.col("of_suffix.s")[i] - p + HOST_ROWS * all_rows) / (F.col("of_suffix.n") - 1 + HOST_ROWS)
        prior = (F.col("of_host.s")[i] - p + HOST_ROWS * parent) / (F.col("of_host.n") - 1 + HOST_ROWS)
        # Sums of doubles may fall a trace short of a term of theirs.
        return F.log(F.greatest(p, F.lit(1e-30))) + F.coalesce(F.col("like")[i], F.lit(0.0)) + F.log(F.greatest(prior, F.lit(1e-12)))

    out = out.withColumn("score", F.array(*[score(i) for i in range(k)]))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(
        *[c for c in rows.columns if c not in ("p", "is_html")],
        F.element_at(names, F.array_position("score", F.array_max("score")).cast("int")).alias("lang"),
        (1 / F.aggregate(F.transform("score", lambda x: F.exp(x - F.array_max("score"))), F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"),
    )


def identify(docs: DataFrame | None, pages: DataFrame | None, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row per document and page: doc_id or page_id, url, host, declared, suffix, lang, confidence, text_lang.

    A document's host is its source; it declares nothing and has no suffix.  Missing evidence is neutral:
    an empty or null text leaves the priors to decide, a null url belongs to the host ''.  Ties go to
    the language that comes first in the alphabet.  Repeated rows give repeated rows; an empty table none.
    Other columns, whatever their names, are not looked at.
    """
    parts = []
    if docs is not None:
        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("body"), F.lit(False).alias("is_html")))
    if pages is not None:
        parts.append(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("body"), F.lit(True).alias("is_html")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    suffix = F.when(F.col("is_html"), F.regexp_extract("host", r"\.([a-z][a-z0-9\-]*)$", 1))
    scored = likelihoods(rows, model).withColumn("suffix", F.when(suffix != "", suffix))
    return fuse(stage(scored), model[0])
