"""A synthetic corpus of long texts with known identifiers, and simulated runs over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let

# Sizes, the optional largest one, variants, identifiers, filler words and sentences of the corpus.
SIZES = (("1k", 1000), ("2k", 2000), ("4k", 4000), ("8k", 8000), ("12k", 12000), ("20k", 20000))
LARGEST = ("40k", 40000)
VARIANTS = ("prose-pii", "no-punctuation", "pii-start", "pii-middle", "pii-end", "pii-boundary", "safe")
VALUES = {
    "name": "Max Mustermann",
    "email": "max.mustermann@example.com",
    "phone": "+49 170 1234567",
    "iban": "DE89 3704 0044 0532 0130 00",
    "credit_card": "4111 1111 1111 1111",
    "ip_address": "192.0.2.45",
    "date": "1985-03-15",
    "address": "Musterstrasse 42, 10115 Berlin",
    "company": "Muster GmbH",
}
PLAIN_TYPES = ("name", "email", "phone", "company", "iban", "address")
FILLER = "project review draft policy workflow context summary analysis quality timeline planning handoff notes iteration proposal research document customer support internal privacy prompt benchmark local browser "
SENTENCE = "Please prepare the contract note for {name} at {company} using {email} and {phone} registered at {address} with IBAN {iban} card {credit_card} login IP {ip_address} and birth date {date}.".format(**VALUES)
BLOCK = "please review account for {name} email {email} phone {phone} company {company} iban {iban} address {address}".format(**VALUES)
INTRO = "Summarize this customer escalation and produce a neutral response."
BOUNDARY = 3920


def _filler(n: Column) -> Column:
    """Filler words until the text has n characters or more, each with a space."""
    whole = F.repeat(F.lit(FILLER), F.ceil(F.greatest(n, F.lit(0)) / len(FILLER)).cast("int") + 1)
    # The word that reaches n ends at the first space at or after it; a text of n <= 0 is empty.
    return F.when(n <= 0, "").otherwise(F.substring(whole, F.lit(1), F.call_function("locate", F.lit(" "), whole, n)))


def _fit(text: Column, n: Column) -> Column:
    """text cut to n characters, or filled up to them with pieces of filler of up to 575 characters."""

    def fill(x: Column) -> Column:
        # Each round adds a space, unless the text ends in one, and up to as much as is missing but one.
        rounds = F.sequence(F.lit(0), F.lit(120))

        def step(t: Column, _: Column) -> Column:
            missing = n - F.length(t)
            piece = F.substring(_filler(F.least(missing + 64, F.lit(512))), F.lit(1), F.greatest(F.lit(0), missing - 1))
            return F.when(missing <= 0, t).otherwise(F.concat(t, F.when(t.endswith(" "), "").otherwise(" "), piece))

        return F.aggregate(rounds, x, step, lambda t: F.substring(t, F.lit(1), n))

    return let(text, lambda t: F.when(F.length(t) > n, F.substring(t, F.lit(1), n)).otherwise(fill(t)))


def corpus(spark: SparkSession, largest: bool = False) -> DataFrame:
    """case_id, size_label, target_chars, variant, text, expected (array of type, value): sizes times variants."""
    sizes = spark.createDataFrame([*SIZES, LARGEST] if largest else list(SIZES), "size_label string, target_chars int")
    own = sizes.select("*", F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant"))
    n, v = F.col("target_chars"), F.col("variant")
    base = _filler(F.greatest(n, F.lit(1024)))
    pii = F.lit(SENTENCE)
    half = F.greatest(F.lit(0), F.floor((n - len(SENTENCE)) / 2).cast("int"))
    edge = F.greatest(F.lit(0), F.least(n - len(SENTENCE) - 1, F.lit(BOUNDARY)))
    ahead = F.greatest(F.lit(0), n - len(SENTENCE) - 1)
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    cut = lambda size: F.substring(_filler(size), F.lit(1), size)
    parts = (
        F.when(v == "prose-pii", joined(F.lit(INTRO), pii, base))
        .when(v == "no-punctuation", joined(_filler(F.floor(n / 3).cast("int")), F.lit(BLOCK), base))
        .when(v == "pii-start", joined(pii, base))
        .when(v == "pii-middle", joined(F.substring(base, F.lit(1), half), pii, base))
        .when(v == "pii-end", joined(cut(ahead), pii))
        .when(v == "pii-boundary", joined(cut(edge), pii, base))
        .otherwise(base)
    )
    text = _fit(parts, n)
    pairs = lambda types: F.array(*[F.struct(F.lit(t).alias("type"), F.lit(VALUES[t]).alias("value")) for t in types])
    none = F.array().cast("array<struct<type:string,value:string>>")
    expected = F.when(v == "safe", none).when(v == "no-punctuation", pairs(PLAIN_TYPES)).otherwise(pairs(tuple(VALUES)))
    return own.select(
        F.concat_ws("-", "size_label", "variant").alias("case_id"),
        "size_label",
        "target_chars",
        "variant",
        F.when(v == "no-punctuation", F.regexp_replace(text, "[!?;]", " ")).otherwise(text).alias("text"),
        expected.alias("expected"),
    )


def violations(cases: DataFrame) -> DataFrame:
    """Cases whose length isn't what it should be or that lack an expected value; of a good corpus none."""
    lacking = F.filter("expected", lambda e: ~F.contains(F.col("text"), e["value"]))
    return cases.filter((F.length("text") != F.col("target_chars")) | (F.size(lacking) > 0))


def quality(expected: Column, text: Column, output: Column) -> Column:
    """What of the expected values an output still holds."""
    left = F.filter(expected, lambda e: F.contains(output, e["value"]))
    gone = F.filter(expected, lambda e: ~F.contains(output, e["value"]))
    types = lambda a: F.transform(a, lambda e: e["type"])
    return F.struct(
        F.size(expected).alias("expected_count"),
        (F.size(left) == 0).alias("all_removed"),
        types(gone).alias("protected_types"),
        types(left).alias("present_types"),
        F.when(F.size(expected) == 0, output == text).alias("safe_unchanged"),
    )


def simulated(cases: DataFrame, measurements: tuple[str, ...] = ("background", "paste"), repetitions: int = 1) -> DataFrame:
    """Records of a dry run: latencies by formula, every value replaced by its type."""
    output = F.aggregate("expected", F.col("text"), lambda t, e: F.replace(t, e["value"], F.concat(F.lit("<"), F.upper(e["type"]), F.lit(">"))))
    kilo = F.col("target_chars") / 1000
    long = F.col("target_chars") >= 4000
    rows = cases.withColumn("output_text", output)
    rows = rows.select("*", F.explode(F.array(*[F.lit(m) for m in measurements])).alias("measurement"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    return rows.select(
        "measurement",
        "repetition",
        "case_id",
        "size_label",
        "target_chars",
        F.length("text").alias("actual_chars"),
        "variant",
        F.sha2("text", 256).alias("input_sha256"),
        F.array_distinct(F.transform("expected", lambda e: e["type"])).alias("expected_types"),
        F.lit(False).alias("discarded"),
        F.floor(F.when(F.col("measurement") == "background", 70).otherwise(110) + kilo * 15 + 0.5).cast("double").alias("roundtrip_ms"),
        quality(F.col("expected"), F.col("text"), F.col("output_text")).alias("quality"),
        F.struct(
            (F.size("expected") > 0).alias("has_pii"),
            F.lit("complete").alias("analysis_status"),
            F.lit(None).cast("string").alias("fallback_reason"),
            F.size("expected").alias("replacement_count"),
            F.floor(50 + kilo * 12 + 0.5).cast("double").alias("duration_ms"),
            F.greatest(F.lit(1), F.ceil(F.col("target_chars") / 8000).cast("int")).alias("chunk_count"),
            F.when(long, 8000.0).alias("char_limit"),
            F.when(long, 1).otherwise(0).alias("measure_count"),
            F.lit(0).alias("quota_retry_count"),
            F.lit(0).alias("timeout_count"),
        ).alias("result"),
    )
