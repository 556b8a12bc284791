from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import mask as M

SPANS = "array<struct<start:int,end:int,category:string,source:string>>"


def merged(spark, spans):
    row = spark.createDataFrame([(spans,)], f"s {SPANS}").select(M.merge(F.col("s")).alias("m")).first()
    return [(x.start, x.end, x.category, x.source) for x in row.m]


def test_merge_prefers_detectors(spark):
    assert merged(spark, [(18, 32, "person", "model"), (21, 32, "email", "deterministic")]) == [(21, 32, "email", "deterministic")]
    assert merged(spark, [(0, 4, "person", "model"), (0, 9, "person", "model"), (9, 12, "date", None)]) == [(0, 9, "person", "model"), (9, 12, "date", "unknown")]
    assert merged(spark, [(-1, 4, "person", "model"), (5, 5, "person", "model"), (1, 2, " ", "model"), (None, 3, "date", "model")]) == [(0, 3, "date", "model")]
    assert merged(spark, []) == []


def test_mask(spark):
    text = "Kontakt: Max Mustermann, max@test.de"
    spans = [[("B-private_person", 9, 23, 0.9), ("nonsense", 0, 2, 0.9)]]
    df = spark.createDataFrame([(1, text, spans[0])], "doc_id long, text string, spans array<struct<label:string,start:int,end:int,score:double>>")
    r = M.mask(df, spans_col="spans").first()
    assert r.output_text == "Kontakt: <PRIVATE_PERSON>, <PRIVATE_EMAIL>" and r.n_entities == 2 and r.categories == {"person": 1, "email": 1} and r.has_pii


def test_masks_every_copy_and_its_own_output(spark):
    df = spark.createDataFrame([("a@b.de und a@b.de",), (None,), ("nichts",)], "text string")
    out = [r.output_text for r in M.mask(df).collect()]
    assert out == ["<PRIVATE_EMAIL> und <PRIVATE_EMAIL>", None, "nichts"]
    again = [r.output_text for r in M.mask(spark.createDataFrame([(out[0],)], "text string")).collect()]
    assert again == out[:1]


def test_fails_closed_without_a_model(spark):
    df = spark.createDataFrame([("a@b.de", None), ("a@b.de", [])], "text string, spans array<struct<label:string,start:int,end:int,score:double>>")
    rows = M.mask(df, spans_col="spans", require_model=True).collect()
    assert [(r.output_text, r.manual_decision_reason) for r in rows] == [(None, "simple_model_unavailable"), ("<PRIVATE_EMAIL>", None)]
