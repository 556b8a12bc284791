from __future__ import annotations

import os
import random
import re
from collections import defaultdict

import duckdb

import numpy as np
import pytest
from test_dedup import plain_substrings, shingle_set
from test_tokens import FILE, check
from tokenizers import Tokenizer

import corpus_pipeline
from veilspark.llm import common, queries, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            after = docs.count()
            assert before * 0.6 < after <= before
            before = after
    assert docs.select("doc_id").distinct().count() == before


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    source = {"op3_main_text": ["pages"], "op4_language_id": ["documents", "pages"], "op2_packing": None, "op9_nearest": None}.get(name, ["documents"])
    out = queries.QUERIES[name](spark, DATA)
    if source:
        assert out.count() == sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in source)


def test_one_row_of_each_text_stays(spark, docs, texts, none):
    """Whole files loaded twice, rows without ids and ids with several texts."""
    extra = [(300, "twice"), (300, "twice"), (300, "other"), (301, "other "), (None, "no id"), (None, "no id"), (None, " no id"), (302, "single")]
    rows = [*texts, *texts, *extra]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = defaultdict(list)
    for d, t in rows:
        by[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), float("inf") if d is None else d))
    got = corpus_pipeline.drop_copies(spark, df, "").collect()
    want = [min(own) for own in by.values()]
    assert sorted((-len(r.text or ""), float("inf") if r.doc_id is None else r.doc_id) for r in got) == sorted(want)
    assert corpus_pipeline.drop_copies(spark, docs, "").columns == docs.columns and corpus_pipeline.drop_copies(spark, none, "").count() == 0


def test_stages_against_plain_versions(spark, texts, tmp_path):
    """Each stage on all that the one before has kept, against plain Python on the same rows."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    for g in range(30):
        words = rng.choices(names, k=rng.randint(40, 120))
        insult = "you are an utter idiot clown" if g % 3 == 0 else "on a fine day"
        rows += [(1000 + 10 * g + j, f"{' '.join(words)} {insult}{' again' * j}") for j in range(3)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    labels = [(1000 + 10 * g + j, 1, int(g % 3 == 0)) for g in range(30) for j in range(3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir = str(tmp_path)
    pairs = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    want = [(d, t or "") for d, t in rows if model.score(np.array([toxicity.features(t or "", model.lexicon)]))[0] < corpus_pipeline.TOXIC]
    assert pairs(kept) == sorted(want) and not any("idiot" in t for _, t in want) and len(want) >= len(rows) - 30

    groups = defaultdict(list)
    for d, t in want:
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), d, t))
    want = [min(own)[1:] for own in groups.values()]
    kept = corpus_pipeline.drop_copies(spark, common.stage(kept), sf_dir)
    assert pairs(kept) == sorted(want)

    own = sorted(want)
    sets = [shingle_set(t.lower()) if t.split() else set() for _, t in own]
    root = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1.0) >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    want = [own[r] for r in sorted(set(root))]
    kept = corpus_pipeline.drop_near_copies(spark, common.stage(kept), sf_dir)
    assert pairs(kept) == sorted(want) and len(want) < len(own)

    want = list(plain_substrings(want))
    kept = corpus_pipeline.cut_passages(spark, common.stage(kept), sf_dir)
    assert pairs(kept) == sorted(want) and all(r.n_chars == len(r.text or "") for r in kept.collect())

    encode = Tokenizer.from_file(FILE)
    got = corpus_pipeline.pack(spark, common.stage(kept), sf_dir).collect()
    check([tuple(r) for r in got], {d: np.array([*encode.encode(t, add_special_tokens=False).ids, 0], np.uint32) for d, t in want})


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", {"m": i}) for i in range(300)] + [(400, None, None), (401, "unknown", None)], "i int, away string, m map<string,int>")
    by = spark.createDataFrame([("hot", 200, 1.5), *[(f"k{i}", 15 - i, float(i)) for i in range(7)]], "away string, n long, v double")
    got = {r.i: r.v for r in common.lookup(rows, by, "away", "n", ["v"]).collect()}
    assert got == {**{i: 1.5 if i % 3 else float(i % 7) for i in range(300)}, 400: None, 401: None}
