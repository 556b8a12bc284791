"""The query catalogue: each operator over the driver's tables, as (spark, sf_dir) -> DataFrame with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import control, people
from ..functions import patterns as P
from ..functions import spans as S
from ..functions import synthetic as X
from ..functions import triage as T
from ..functions.validators import micros
from ..operators import anonymize as A
from ..operators import chunk as C
from ..operators import detect as D
from ..operators import engine as E
from ..operators import gates as G
from ..operators import mask as M
from ..operators import model
from ..operators import resolve as R
from ..session import spread
from ..sources import tables
from ..streaming import mappings as L
from ..streaming.texts import read_files
from . import corpus, report

#: Texts of every pass and edge of the detector; the tables hold no IBAN and no IPv6 address.
FIXTURE = (
    "Bitte max.mustermann@firma.de kontaktieren.",
    "IBAN DE89 3704 0044 0532 0130 00 ist korrekt.",
    "IBAN DE00 3704 0044 0532 0130 00 ist falsch.",
    "DE89370400440532013000 und GB82 WEST 1234 5698 7654 32",
    "Karte 4111 1111 1111 1111.",
    "Server 192.168.1.100 antwortet, 300.1.1.1 nicht.",
    "Tel: +49 170 1234567, Karte: 4111 1111 1111 1111.",
    "Geboren am 15.03.1985.",
    "a@b.de und a@b.de",
    "am 15.03.1985 und 15.03.1985",
    "on 03/15/1985",
    "host 2001:db8:1:2:3:4:5:6 up, 1:2:3 not",
    "am 31.02.2020 und 29/02/2020 und 2024-01-15 und 1-2.1999",
    "nichts",
    "",
    "😀 Max schreibt an max@😀.de und an eva@firma.de, Telefon 030 1234567.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its timestamps without a zone are taken as UTC, whatever the session's zone."""
    return _instants(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _instants(df: DataFrame) -> DataFrame:
    instant = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{}`))"
    bare = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.expr(instant.format(c)) for c in bare}) if bare else df


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(id, text) of a table of texts, over all cores."""
    return spread(_plain_texts(spark, sf_dir, name))


def _plain_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pages":
        return table(spark, sf_dir, name).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    if name == "conversations":
        return table(spark, sf_dir, name).select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "text")
    return table(spark, sf_dir, name).select("doc_id", "text")


def _fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(FIXTURE)], "doc_id long, text string")


def _with_fixture(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """texts and, under negative ids, the fixture."""
    return texts.unionByName(_fixture(spark).withColumn("doc_id", -1 - F.col("doc_id")))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "category", "original", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


def _pass(number: int, name: str = "documents"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = D.with_candidates(_with_fixture(spark, _texts(spark, sf_dir, name)), number).select("doc_id", F.inline("found"))
        return found.select("doc_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "value")

    return query


def entities(name: str, fixture: bool = False):
    return lambda spark, sf_dir: _flat(D.detect(_with_fixture(spark, _texts(spark, sf_dir, name)) if fixture else _texts(spark, sf_dir, name)))


def entities_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(D.detect(_fixture(spark)))


def mask(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = M.mask(_texts(spark, sf_dir, name))
        return out.select("doc_id", "output_text", F.col("n_entities").cast("long").alias("n_entities"), "has_pii")

    return query


def mask_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking with spans of a model as well; here spans at fixed places stand for a model's."""
    docs = _texts(spark, sf_dir)
    spans = docs.filter(F.length("text") >= 60).select("doc_id", F.inline(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("start"), F.lit(c).alias("end"), F.lit(d).alias("score")) for a, b, c, d in MODEL_SPANS])))
    out = M.mask(tables.spans_of(docs, spans), spans_col="model_spans")
    return out.select("doc_id", "output_text", F.col("n_entities").cast("long").alias("n_entities"))


#: label, start, end, score of the stand-in spans.
MODEL_SPANS = (("B-private_person", 3, 17, 0.9), ("private_address", 10, 30, 0.8), ("private_url", 40, 48, 0.7), ("unknown", 50, 55, 0.9))


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    own = D.with_entities(docs, dedupe=False).select("lang", F.explode("entities").alias("e"))
    return own.groupBy("lang", M.mask_category(F.col("e.category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.mask(_texts(spark, sf_dir)).select("doc_id", F.explode("categories").alias("category", "n"))
    return out.select("doc_id", "category", F.col("n").cast("long").alias("n"))


def pii_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.with_entities(spread(table(spark, sf_dir, "documents").select("source", "text")))
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.size("entities") > 0).alias("docs_with_pii"), F.sum(F.size("entities")).cast("long").alias("n_entities"))


def scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", G.should_scan(F.col("text")).alias("should_scan"), G.should_restore(F.col("text")).alias("should_restore"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fixture(spark, _texts(spark, sf_dir)).select("doc_id", X.seed(F.col("text")).alias("seed"), X.hash36(F.col("text")).alias("hash36"))


def fake_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.once(D.with_entities(_with_fixture(spark, _texts(spark, sf_dir))), made=R.structured(F.col("entities")))
    return own.select("doc_id", F.inline("made")).select("doc_id", "category", "original", "replacement")


def fake_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.once(D.with_entities(_texts(spark, sf_dir)), made=R.structured(F.col("entities"), keyed=True))
    return own.select("doc_id", F.inline("made")).select("doc_id", "category", "original", "replacement", F.col("key").alias("entity_key"))


def fake_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.pattern(F.col("c_name"), F.col("c_name")).alias("id_value"), X.generic(F.col("c_name"), F.col("c_name")).alias("other_value"))


def anonymize_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.anonymize_structured(_texts(spark, sf_dir))
    return out.select("doc_id", "output_text", "has_pii", F.col("n_entities").cast("long").alias("n_entities"))


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymised documents turned back by their own mappings."""
    own = A.anonymize_structured(_texts(spark, sf_dir))
    # Written mappings and texts are two reads of one result; a store would be a table.
    store = A.mappings(own, "doc_id", F.lit("2024-01-01").cast("timestamp"))
    out = A.restore(own.select("doc_id", F.col("output_text").alias("text")), store, "doc_id")
    return out.select("doc_id", "restored_text")


def triage(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = T.with_decision(D.with_entities(_texts(spark, sf_dir, name)))
        return out.select("doc_id", "decision", "reason", F.array_join("risk_signals", ",").alias("risk_signals"))

    return query


def triage_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = T.strip(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", F.length(own).cast("long").alias("n_chars"), T.lines(own).cast("long").alias("n_lines"), ((F.length(own) > P.BYPASS_CHARS) | (T.lines(own) > P.BYPASS_LINES)).alias("too_large"))


def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reversible path with the stand-in detector."""
    out = A.dispatch(A.anonymize(_texts(spark, sf_dir), model.KnownNames, telemetry=True).withColumn("manual_decision_reason", F.lit(None).cast("string")))
    return out.select("doc_id", "output_text", "has_pii", "n_entities", "decision", "reason", "analysis_status", "fallback_reason", "error", "outcome", "emit", "chunk_count")


def anonymize_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails closed: what triage sends to a model has no output without one."""
    out = A.anonymize(_texts(spark, sf_dir))
    return out.select("doc_id", "decision", "analysis_status", "error", F.col("output_text").isNull().alias("blocked"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(C.chunks(_texts(spark, sf_dir)))


def chunk_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(C.chunks(_texts(spark, sf_dir), limit=1000, least=300, overlap=40))


def chunk_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(C.chunks(_texts(spark, sf_dir), retry=True)).withColumn("piece", F.col("chunk"))


def _chunks(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"), "boundary", F.sha2("text", 256).alias("text_sha256"))


#: context window, input quota, usage, overhead, ratio
LIMITS = ((6144.0, None, 512.0, 256.0, 0.65), (None, None, None, None, 0.65), (None, 1024.0, 0.0, 0.0, 0.45), (100.0, None, 200.0, 0.0, 0.65), (1e9, None, 0.0, 0.0, 0.65), (2000.0, 9.0, -5.0, 10.0, 0.65))


def chunk_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(LIMITS)], "id int, w double, q double, u double, o double, ratio double")
    return rows.select("id", C.char_limit(F.col("w"), F.col("q"), F.col("u"), F.col("o"), F.col("ratio")).alias("char_limit"))


def _records(spark: SparkSession) -> DataFrame:
    return corpus.simulated(corpus.corpus(spark), repetitions=2)


def bench_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = corpus.corpus(spark, largest=True)
    bad = corpus.violations(cases).select(F.col("case_id").alias("_bad"))
    out = cases.join(bad, F.col("case_id") == F.col("_bad"), "left")
    return out.select("case_id", "size_label", "variant", "target_chars", F.length("text").alias("actual_chars"), F.size("expected").alias("n_expected"), F.col("_bad").isNotNull().alias("violates"))


def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latency(_records(spark))


def latency_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), report.percentile("value", 0.5).alias("p50"), report.percentile("value", 0.95).alias("p95"), F.max("value").alias("slowest"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.coverage(_records(spark))
    return out.select("type", F.col("expected").cast("long").alias("expected"), F.col("protected").cast("long").alias("protected"))


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recommend(_records(spark))


def copy_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user that a click of theirs precedes by two hours at most (the tables are too sparse for two seconds)."""
    out = G.honoured_writes(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "click", "view", 7_200_000)
    return out.select("event_id", "user_id", "honoured")


def mapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return out.select("user_id", F.col("session").cast("long").alias("session"), micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "n_events")


def _mapping_events(events: DataFrame) -> DataFrame:
    """Events as writes and clearings of mappings: purchases clear a user's, errors count for nothing."""
    e = events.filter("event_type <> 'error'")
    kind = F.when(F.col("event_type") == "purchase", "clear").otherwise("write")
    return e.select(F.col("user_id").cast("string").alias("key"), "ts", kind.alias("kind"), F.concat(F.lit("fake"), (F.col("event_id") % 5).cast("string")).alias("fake"), F.col("event_id").cast("string").alias("original"))


MOMENT = "2024-01-20 12:00:00"


def mapping_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store when some errors clear everything."""
    events = table(spark, sf_dir, "events")
    every = events.filter("event_type = 'error' AND event_id % 50 = 0").select(F.lit("").alias("key"), "ts", F.lit("clear_all").alias("kind"), F.lit("").alias("fake"), F.lit("").alias("original"))
    out = L.state_at(_mapping_events(events).unionByName(every), F.lit(MOMENT + "Z").cast("timestamp"), 3 * 24 * 60)
    return out.select("key", "fake", "original", micros("touched_at").alias("touched_us"))


#: kind, value, allowed
CONTROL_EVENTS = (("set_enabled", "false", True), ("set_mode", "simple", False), ("set_mode", "simple", True), ("set_enabled", "true", True), ("set_mode", "other", True), ("set_enabled", "x", True), ("set_mode", "reversible", False), ("set_mode", "simple", True))


def engine_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(CONTROL_EVENTS)], "id int, kind string, value string, allowed boolean")
    return E.settings(rows, "id").select("id", "enabled", "mode", "clears", "error")


def engine_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.Engine(enabled=False).transform(_texts(spark, sf_dir))
    return out.select("doc_id", "output_text", "has_pii", F.col("n_entities").cast("long").alias("n_entities"))


def engine_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.Engine().with_mode("simple").transform(_texts(spark, sf_dir, "conversations"))
    return out.select("doc_id", "output_text", "has_pii", F.col("n_entities").cast("long").alias("n_entities"))


def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.Engine().with_enabled("").with_mode("simple").status(spark).unionByName(E.Engine().status(spark, model_ready=True))


def runtime_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.runtime_info(spark)


def mapping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds at a moment, with a time to live of three days for these sparse events."""
    out = L.state_at(_mapping_events(table(spark, sf_dir, "events")), F.lit(MOMENT + "Z").cast("timestamp"), 3 * 24 * 60)
    return out.select("key", "fake", "original", micros("touched_at").alias("touched_us"))


def mapping_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store as a stream over the events, run to its end: how many mappings each write or clearing leaves a key."""
    path = f"{sf_dir}/events.parquet"
    # The files of a table are in no order of time, so they are one batch, however many.
    events = _mapping_events(_instants(read_files(spark, path, spark.read.parquet(path).schema, 2**31 - 1)))
    out = L.run_to_end(L.stream(events, 3 * 24 * 60))
    return out.filter("action <> 'expired'").select("key", F.unix_micros("ts").alias("us"), "action", F.col("n").cast("long").alias("n"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that aren't overdrawn stand for the keys that live."""
    return table(spark, sf_dir, "customer").filter("c_acctbal >= 0")


def orphan_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "events").select("user_id", "event_id")
    return L.orphans(store, _live(spark, sf_dir), "user_id", "c_custkey").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def kept_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "events").select("user_id", "event_id")
    return L.kept(store, _live(spark, sf_dir), "user_id", "c_custkey").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def best_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all matches of a document with one key the preferred; cards count as proposals of a model here."""
    found = D.with_candidates(_texts(spark, sf_dir), *range(len(P.PASSES)))
    flat = found.select("doc_id", F.inline("found"))
    keyed = flat.withColumns({"entity_key": F.lower("value"), "source": F.when(F.col("category") == "credit_card", "ai").otherwise("deterministic"), "confidence": F.when(F.col("category") == "credit_card", 0.5)})
    best = R.best_per_key(keyed, "doc_id", "entity_key", "source", "confidence", "start", arrival="pass")
    return best.select("doc_id", "entity_key", "category", F.col("start").cast("long").alias("span_start"))


def unique_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, needle = F.col("text"), F.lit("Apache License")
    return _texts(spark, sf_dir).select("doc_id", G.occurs_once(text, needle).alias("unique"), F.sha2(G.replace_unique(text, needle, F.lit("<X>")), 256).alias("text_sha256"))


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a dimension of messages; those of region 3 are missing and fall back."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.lit("en").alias("locale"), F.col("n_nationkey").cast("string").alias("key"), F.concat(F.col("n_name"), F.lit(" has $1 of $2")).alias("message"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("k"), "c_mktsegment")
    out = tables.messages(rows, n, F.lit("en"), F.col("k"), F.when(F.col("k") != "7", F.concat(F.lit("nation "), "k")))
    return out.select("c_custkey", tables.substitute(F.col("message"), F.array(F.col("c_mktsegment"), F.lit("x"))).alias("message"))


#: message, has_gpu
ERRORS = (("QuotaExceededError: full", True), ("Failed to fetch model", True), ("HTTP 404", True), ("no WebGPU adapter", True), ("boom", True), ("quota", False), (None, True), ("CORS denied", True))


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ERRORS)], "id int, message string, has_gpu boolean")
    return rows.select("id", control.error_code(F.col("message"), F.col("has_gpu"), F.lit("simple_analysis_failed")).alias("code"), G.is_quota_error(F.lit("Error"), F.lit(None).cast("string"), F.col("message")).alias("is_quota"))


#: progress, loaded, total, default_k, max_k, default_t, max_t
NUMBERS = ((50.0, None, None, 3.0, 8.0, 1.0, 2.0), (0.25, 1.0, 2.0, 0.2, 8.0, 1.0, 0.1), (None, 1.0, 4.0, 9.4, 8.9, 0.0, 0.0), (None, 1.0, 0.0, None, 8.0, 1.0, 2.0), (float("nan"), 3.0, 4.0, 2.5, 0.5, 1.0, 2.0), (100.0, None, None, 2.5, 4.0, 1.0, -1.0))


def model_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(NUMBERS)], "id int, p double, l double, t double, dk double, mk double, dt double, mt double")
    params = control.session_params(*[F.col(c) for c in ("dk", "mk", "dt", "mt")])
    return rows.select("id", control.progress(F.col("p"), F.col("l"), F.col("t")).alias("progress"), F.coalesce(params["top_k"], F.lit(-1)).alias("top_k"), params["temperature"].alias("temperature"))


#: responses of a model
RESPONSES = (
    '{"entities":[]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"name","confidence":0.9}]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"name"},{"original":"x","replacement":"y","category":"other"}]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"person"}]}',
    '{"entities":[{"original":"Max","category":"name"}]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"name","confidence":"high"}]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"name","confidence":"0.5"}]}',
    '{"entities":[{"original":"Max","replacement":"Tim","category":"name","confidence":null}]}',
    '{"spans":[]}',
    "not json",
    "",
)


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(RESPONSES)], "id int, response string")
    got = S.once(rows, got=R.parse_response(F.col("response")))
    return got.select("id", F.col("got.error").alias("error"), F.size(F.col("got.entities")).alias("n"))


#: category, original of values that only a model finds
PEOPLE = (
    ("name", "Kai spriestersbach 2026 square"), ("name", "Kai Spriestersbach.png"), ("name", "Kai Spriestersbach SEO"), ("name", "Frau Anna Schmidt"), ("name", "ANNA-LENA VON MÜLLER"),
    ("name", "J. Smith"), ("name", "Max"), ("name", "2024"), ("name", "Dr. Max"), ("address", "Musterstraße 12, 10115 Berlin, Germany"), ("address", "742 Evergreen Terrace, Portland, OR 97205 USA"),
    ("address", "Rue de Rivoli 5"), ("address", "10 Downing Street\nLondon SW1A 2AA\nUK"), ("address", "Via Roma 1, 00100 Roma"), ("company", "Beispiel GmbH"), ("company", "Acme Inc."), ("company", "Foo GmbH & Co. KG"),
    ("company", "Café SARL"), ("company", "Plain"), ("passport", "C01X00T47"), ("national_id", "12-345.678 a"), ("other", "secret"),
)


def people_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and synthetic values for names, addresses, companies and ids, by the stand-in for a model's findings."""
    rows = spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(PEOPLE)], "id int, category string, original string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([people.normalize_name(o) if c == "name" else o for c, o in own]), pa.array([people.fallback(o, c) for c, o in own])], names=["id", "category", "original", "normalized", "replacement"])

    return rows.mapInArrow(run, "id int, category string, original string, normalized string, replacement string")


#: label, title, key, ctrl, meta, alt
CONTROLS = (("Copy response", None, "c", True, False, False), ("Antwort kopieren", "", "C", False, True, False), (None, "Send", "Insert", True, False, False), ("photocopying", None, "c", True, False, True), ("", "Copiar", "x", True, False, False))


def copy_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(CONTROLS)], "id int, label string, title string, k string, ctrl boolean, meta boolean, alt boolean")
    return rows.select("id", G.is_copy_control(F.col("label"), F.col("title")).alias("is_control"), G.is_copy_shortcut(F.col("k"), F.col("ctrl"), F.col("meta"), F.col("alt")).alias("is_shortcut"))


def remask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After partial results: pseudonymised passages in an editor's text are masked instead."""
    own = A.anonymize_structured(_texts(spark, sf_dir)).select("doc_id", "text", "output_text", F.lit("partial").alias("analysis_status"), F.concat(F.lit("> "), "output_text").alias("shown_text"))
    out = A.remask(own)
    return out.select("doc_id", "remasked", "remasked_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_email": _pass(0),
    "detect_iban": _pass(1),
    "detect_card": _pass(2),
    "detect_ipv4": _pass(3),
    "detect_ipv6": _pass(4),
    "detect_date": _pass(5),
    "detect_phone": _pass(6),
    "entities_documents": entities("documents"),
    "entities_pages": entities("pages"),
    "entities_conversations": entities("conversations", fixture=True),
    "entities_fixture": entities_fixture,
    "mask_documents": mask("documents"),
    "mask_pages": mask("pages"),
    "mask_conversations": mask("conversations"),
    "mask_with_model": mask_with_model,
    "category_summary": category_summary,
    "document_categories": document_categories,
    "pii_by_source": pii_by_source,
    "scan_gate": scan_gate,
    "seeds": seeds,
    "fake_structured": fake_structured,
    "fake_keyed": fake_keyed,
    "fake_ids": fake_ids,
    "people_values": people_values,
    "anonymize_structured": anonymize_structured,
    "restore_roundtrip": restore_roundtrip,
    "triage_documents": triage("documents"),
    "triage_conversations": triage("conversations"),
    "triage_limits": triage_limits,
    "anonymize": anonymize,
    "anonymize_without_model": anonymize_without_model,
    "remask": remask,
    "engine_settings": engine_settings,
    "engine_disabled": engine_disabled,
    "engine_simple": engine_simple,
    "engine_status": engine_status,
    "runtime_info": runtime_info,
    "chunk_documents": chunk_documents,
    "chunk_short": chunk_short,
    "chunk_retry": chunk_retry,
    "chunk_limit": chunk_limit,
    "bench_corpus": bench_corpus,
    "latency_report": latency_report,
    "latency_by_event": latency_by_event,
    "coverage_report": coverage_report,
    "recommendations": recommendations,
    "copy_intent": copy_intent,
    "copy_controls": copy_controls,
    "mapping_sessions": mapping_sessions,
    "mapping_state": mapping_state,
    "mapping_cleared": mapping_cleared,
    "mapping_stream": mapping_stream,
    "orphan_mappings": orphan_mappings,
    "kept_mappings": kept_mappings,
    "best_entity": best_entity,
    "unique_replace": unique_replace,
    "text_digests": text_digests,
    "message_lookup": message_lookup,
    "error_codes": error_codes,
    "model_numbers": model_numbers,
    "parse_responses": parse_responses,
}
