"""Entity resolution for the reversible path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import people
from ..functions import spans as S
from ..functions import synthetic as X
from ..functions import validators as V

RESOLVED = "struct<original:string,replacement:string,category:string,key:string,source:string,start:int,end:int,confidence:double>"
PROPOSED = "struct<original:string,replacement:string,category:string,source:string,start:int,end:int,confidence:double>"
RESPONSE = "struct<entities:array<struct<original:string,replacement:string,category:string,confidence:string>>>"
_KIND = pa.list_(pa.struct([("original", pa.string()), ("replacement", pa.string()), ("category", pa.string()), ("key", pa.string()), ("source", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def parse_response(response: Column) -> Column:
    """(entities, error) of a model's JSON answer: one bad entity spoils the whole answer."""
    got = F.from_json(F.trim(response), RESPONSE, {"mode": "PERMISSIVE"})
    raw = F.from_json(F.trim(response), "struct<entities:array<map<string,string>>>")
    number = lambda v: v.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
    # A quoted number isn't one: compare with how the text writes it.
    text_number = F.trim(response).rlike(r'"confidence"\s*:\s*"')
    good = F.forall(got["entities"], lambda e: e["original"].isNotNull() & e["replacement"].isNotNull() & V.known_category(e["category"]) & (e["confidence"].isNull() | number(e["confidence"])))
    nulls = F.exists(raw["entities"], lambda m: F.map_contains_key(m, "confidence") & F.element_at(m, F.lit("confidence")).isNull())
    ok = F.coalesce(got["entities"].isNotNull() & good & ~text_number & ~F.coalesce(nulls, F.lit(False)), F.lit(False))
    made = F.transform(got["entities"], lambda e: F.struct(e["original"].alias("original"), e["replacement"].alias("replacement"), e["category"].alias("category"), F.lit("ai").alias("source"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), e["confidence"].try_cast("double").alias("confidence")))
    return F.struct(F.when(ok, made).alias("entities"), F.when(~ok, F.lit("parse_failed")).alias("error"))


def proposed(entities: Column) -> Column:
    """Detector entities in the shape of proposals."""
    return F.transform(entities, lambda e: F.struct(e["original"].alias("original"), F.lit(None).cast("string").alias("replacement"), e["category"].alias("category"), e["source"].alias("source"), e["start"].alias("start"), e["end"].alias("end"), e["confidence"].alias("confidence")))


def resolve(df: DataFrame, text_col: str, entities_col: str, asks_col: str | None = None) -> DataFrame:
    """df with a column resolved: one entity per key with its own replacement, longest first; null where asks_col isn't true.

    The steps of a document depend on one another, so they run in Python, in Arrow batches.
    """
    names = df.columns
    text, own = names.index(text_col), names.index(entities_col)
    asks = None if asks_col is None else names.index(asks_col)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"resolved array<{RESOLVED}>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [True] * batch.num_rows if asks is None else batch.column(asks).to_pylist()
            got = [people.resolve(t or "", e or []) if ask else None for t, e, ask in zip(batch.column(text).to_pylist(), batch.column(own).to_pylist(), asked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, _KIND)], names=[*names, "resolved"])

    return df.mapInArrow(run, schema)


@S.build_once
def structured(entities: Column, keyed: bool = False) -> Column:
    """Detector entities with synthetic values, without Python; the seed is the value, or with keyed category:value."""

    def made(e: Column) -> Column:
        own = F.when(e["category"] == "email", F.lower(e["original"])).otherwise(e["original"])
        key = F.concat(e["category"], F.lit(":"), own)
        return F.struct(
            e["original"].alias("original"),
            X.replacement(e["original"], e["category"], key if keyed else None, ("email", "iban", "credit_card", "ip_address", "date", "phone")).alias("replacement"),
            e["category"].alias("category"),
            key.alias("key"),
            e["source"].alias("source"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["confidence"].alias("confidence"),
        )

    return F.transform(entities, made)


def best_per_key(rows: DataFrame, doc: str, key: str, source: str, confidence: str, start: str, case_score: Column | None = None, arrival: str | None = None) -> DataFrame:
    """The preferred row of each document's key: deterministic, better case, more confident, earlier."""
    score = case_score if case_score is not None else F.lit(0)
    order = [F.when(F.col(source) == "deterministic", 2).otherwise(1).desc(), score.desc(), F.coalesce(F.col(confidence), F.lit(0.0)).desc(), F.col(start).asc()]
    w = Window.partitionBy(doc, key).orderBy(*order, *([F.col(arrival)] if arrival else []))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def name_case_score(name: Column) -> Column:
    """Two points for a capitalised part, one for another part of letters (of names that are normalised already)."""
    parts = F.split(F.trim(name), r"\s+")
    point = lambda p: F.when(p.rlike(r"^[A-ZÄÖÜ][\p{L}'’-]*$"), 2).when(p.rlike(r"^[\p{L}'’-]+$"), 1).otherwise(0)
    return F.aggregate(parts, F.lit(0), lambda a, p: a + point(p))
