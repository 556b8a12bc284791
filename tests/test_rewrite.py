from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import people as N
from veilspark.functions import synthetic as X
from veilspark.operators import anonymize as A
from veilspark.operators import model
from veilspark.operators import resolve as R
from veilspark.operators import rewrite as W

PAIRS = "array<struct<from:string,to:string>>"


@pytest.mark.parametrize(
    ("text", "pairs", "want"),
    [
        ("Mail me at a@b.de now.", [("a@b.de", "x@y.de")], "Mail me at x@y.de now."),
        ("Webers Vertrag wurde geprüft.", [("Weber", "Mustermann")], "Mustermanns Vertrag wurde geprüft."),
        ("Maximilian ist ein Name.", [("Max", "Tim")], "Maximilian ist ein Name."),
        ("Thomas Weber und Weber.", [("Thomas Weber", "Max Mustermann")], "Max Mustermann und Mustermann."),
        ("Weber und Mustermann.", [("Weber", "Mustermann"), ("Mustermann", "Schmidt")], "Mustermann und Schmidt."),
        ("Über Kai Spriestersbach und Kai spriestersbach.", [("Kai Spriestersbach", "Alex Walker")], "Über Alex Walker und Alex Walker."),
        (r"a\Eb.*c stays", [(r"a\Eb.*c", "X")], "X stays"),
        ("leer", [("", "x"), ("leer", "")], "leer"),
    ],
)
def test_rewrite(spark, text, pairs, want):
    assert spark.createDataFrame([(text, pairs)], f"t string, p {PAIRS}").select(W.rewrite(F.col("t"), F.col("p")).alias("o")).first().o == want


def test_entries(spark):
    rows = [([("Li Ma", "Xu Ye")],), ([("Anna Maria Koch", "Eva Klein")],), ([("Thomas Weber", "Max Mustermann")],)]
    got = [[(e["from"], e["to"]) for e in r.e] for r in spark.createDataFrame(rows, f"p {PAIRS}").select(W.entries(F.col("p")).alias("e")).collect()]
    assert got == [[("Li Ma", "Xu Ye")], [("Anna Maria Koch", "Eva Klein")], [("Thomas Weber", "Max Mustermann"), ("Thomas", "Max"), ("Weber", "Mustermann")]]


GOLDEN = [
    ("max@test.de", "email", "person-1s21dt@example.invalid"),
    ("192.168.1.100", "ip_address", "203.0.113.159"),
    ("15.03.1985", "date", "22.06.1988"),
    ("DE89 3704 0044 0532 0130 00", "iban", "DE62 5001 0517 1531 4230 51"),
    ("4111 1111 1111 1111", "credit_card", "4404 5613 5680 0008"),
    ("+49 170 1234567", "phone", "+49 511 7064928"),
]


def test_golden_values(spark):
    rows = spark.createDataFrame(GOLDEN, "o string, c string, w string").select("o", "c", "w", X.replacement(F.col("o"), F.col("c")).alias("r")).collect()
    assert all(r.r == r.w == N.fallback(r.o, r.c) for r in rows)
    assert N.seed("Müller") == 1071134547 and N.fallback("max@test.de", "email", "email:max@test.de") == "person-0p088y@example.invalid"


def test_columns_and_python_agree(spark):
    values = [o for o, _, _ in GOLDEN] + ["A-12345xyZ", "", "2024-01-02", "1:2:3:4:5:6:7:8", "030 1234567", "01.02.99", "+998 12 3456789", "+1 23", "99", "DE89370400440532013000", "1" * 60, "zZ" * 40]
    rows = [(o, c) for o in values if o for c in (*X.STRUCTURED, "other")]
    got = spark.createDataFrame(rows, "o string, c string").select("o", "c", X.replacement(F.col("o"), F.col("c"), F.concat("c", F.lit(":"), "o")).alias("r")).collect()
    assert [(r.o, r.c, r.r) for r in got if r.r != N.fallback(r.o, r.c, f"{r.c}:{r.o}")] == []


def test_names():
    same = ["Kai spriestersbach 2026 square", "Kai Spriestersbach.png", "Kai Spriestersbach SEO"]
    assert [N.normalize_name(x) for x in same] == ["Kai spriestersbach", "Kai Spriestersbach", "Kai Spriestersbach"]
    assert len({N.name_key(x) for x in same}) == 1 and len({N.fallback(x, "name") for x in same}) == 1
    made = N.fallback("Frau Anna Schmidt", "name").split()
    assert made[0] == "Frau" and made[1] in N.P.NAMES["de"][1] and made[2] in N.P.NAMES["de"][3]
    assert N.legal_form("X UG (haftungsbeschränkt)") is None and N.fallback("Beispiel GmbH", "company").endswith(" GmbH")
    assert N.fallback("Musterstraße 12", "address").count(",") == 0 and N.normalize_name("2024") == ""


def test_unique_replacements():
    text = "+49 170 1234567 und +49 171 7654321"
    out = N.resolve(text, [{"original": t, "category": "phone", "source": "deterministic", "start": text.index(t), "end": text.index(t) + len(t), "confidence": 1.0} for t in ("+49 170 1234567", "+49 171 7654321")])
    assert len({e["replacement"] for e in out}) == 2
    best = N.resolve("max Max", [{"original": "max", "category": "name", "source": "ai", "start": 0, "end": 3, "confidence": 0.9}, {"original": "Max", "category": "name", "source": "ai", "start": 4, "end": 7, "confidence": 0.1}])
    assert [e["original"] for e in best] == ["Max"]


def test_parse_response(spark):
    good = '{"entities":[{"original":"Max","replacement":"Tim","category":"name","confidence":0.9}]}'
    bad = [good.replace('"name"', '"person"'), good.replace("0.9", '"0.9"'), good.replace("0.9", "null"), good.replace('"replacement":"Tim",', ""), "[]", "x", ""]
    rows = spark.createDataFrame([(r,) for r in [good, '{"entities":[]}', *bad]], "r string").select(R.parse_response(F.col("r")).alias("p")).collect()
    assert [r.p.error for r in rows] == [None, None] + ["parse_failed"] * len(bad) and rows[0].p.entities[0].original == "Max"


def detectors():
    """Detectors that time out, take short texts only, or fail; defined here so that workers get them by value."""

    class Slow(model.KnownNames):
        def detect(self, text, timeout_ms):
            raise model.Timeout

    class Small(model.KnownNames):
        def detect(self, text, timeout_ms):
            if len(text) > 3000:
                raise model.Quota
            return model.KnownNames.detect(self, text, timeout_ms)

    class Broken(model.KnownNames):
        def detect(self, text, timeout_ms):
            raise ValueError

    return Slow, Small, Broken


def test_long_texts():
    Slow, Small, _ = detectors()
    text = ("Anna Koch kam. " + "wort " * 900) * 2
    whole, halves = model.analyse(model.KnownNames(), text), model.analyse(Small(), text)
    assert whole["status"] == halves["status"] == "complete" and halves["quota_retries"] > 0 and halves["chunks"] > whole["chunks"]
    assert {(e["start"], e["end"]) for e in whole["entities"]} == {(e["start"], e["end"]) for e in halves["entities"]} == {(m, m + 9) for m in (0, text.rindex("Anna"))}
    assert model.analyse(Slow(), text)["reason"] == "timeout" and model.analyse(model.KnownNames(), text, budget_ms=0)["reason"] == "analysis_budget_exceeded"


def test_anonymize(spark):
    Slow, _, Broken = detectors()
    texts = ["Contact max@test.de before sending the final answer.", "Max Mustermann", "Please summarize this.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in A.anonymize(df, model.KnownNames).collect()}
    assert out[0].output_text == "Contact person-0p088y@example.invalid before sending the final answer." and out[1].has_pii and out[2].output_text == texts[2]
    for make, status, error in ((None, "error", "ai_unavailable"), (Broken, "error", "detection_failed")):
        blocked = {r.doc_id: r for r in A.anonymize(df, make).collect()}
        assert (blocked[0].output_text, blocked[0].analysis_status, blocked[0].error, blocked[0].has_pii) == (None, status, error, False)
    late = {r.doc_id: r for r in A.anonymize(df, Slow).collect()}
    assert late[0].analysis_status == "partial" and "max@test.de" not in late[0].output_text and late[1].error == "timeout"


def test_round_trip_and_dispatch(spark):
    texts = ["Tel: +49 170 1234567, max@test.de.", "max@test.de und MAX@test.de", "nichts", "ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    own = A.anonymize_structured(df)
    store = A.mappings(own, "doc_id", F.lit("2024-01-01").cast("timestamp"))
    back = A.restore(own.select("doc_id", F.col("output_text").alias("text")), store, "doc_id").collect()
    assert {r.doc_id: r.restored_text for r in back} == dict(enumerate(texts))
    rows = [("complete", None, None, True, "x"), ("partial", None, None, True, "x"), ("error", "timeout", None, False, "x"), ("complete", None, "simple_model_missing", False, "x"), ("complete", None, None, False, "x"), (None, None, None, None, "x")]
    got = A.dispatch(spark.createDataFrame(rows, "analysis_status string, error string, manual_decision_reason string, has_pii boolean, output_text string")).collect()
    assert [(r.outcome, r.output_text) for r in got] == [("replaced", "x"), ("partial", "x"), ("error", None), ("manual_decision", None), ("identity", "x"), ("blocked", None)]
