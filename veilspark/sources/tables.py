"""Sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = "doc_id bigint, text string"
MAPPINGS = "key string, fake string, original string, touched_at timestamp"
MODEL_SPANS = "doc_id bigint, label string, start int, end int, score double"
RECORDS = (
    "run_id string, timestamp string, measurement string, repetition int, case_id string, size_label string, target_chars int, "
    "actual_chars int, variant string, input_sha256 string, expected_types array<string>, discarded boolean, roundtrip_ms double, "
    "quality struct<expected_count:int,all_removed:boolean,protected_types:array<string>,present_types:array<string>,safe_unchanged:boolean>, "
    "result struct<has_pii:boolean,analysis_status:string,fallback_reason:string,replacement_count:int,duration_ms:double,chunk_count:int,char_limit:double,measure_count:int,quota_retry_count:int,timeout_count:int>"
)


def texts(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """Texts from Parquet, ORC, JSON lines, CSV with a header, or plain text files (one text per file)."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    reader = spark.read.schema(schema or TEXTS) if kind in ("json", "csv") or schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(kind).load(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def mapping_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPINGS).parquet(path)


def spans_of(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column model_spans, the array of a model's spans of each; null where the model has said nothing."""
    lists = spans.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("model_spans"))
    return docs.join(lists, docs[id_col] == F.col("_id"), "left").drop("_id")


def messages(rows: DataFrame, dimension: DataFrame, locale: Column, key: Column, fallback: Column) -> DataFrame:
    """rows with message: the dimension's text (locale, key, message), else the fallback, else the key.

    The dimension is a few locales of a few hundred keys, so Spark broadcasts it by its size.
    """
    d = dimension.select(F.col("locale").alias("_l"), F.col("key").alias("_k"), F.col("message").alias("_m"))
    blank = lambda c: F.when(c != "", c)
    return rows.join(d, (locale == F.col("_l")) & (key == F.col("_k")), "left").withColumn("message", F.coalesce(blank(F.col("_m")), blank(fallback), key)).drop("_l", "_k", "_m")


def substitute(message: Column, values: Column) -> Column:
    """$1, $2, ... replaced by the values."""
    pairs = F.transform(values, lambda v, i: F.struct((i + 1).cast("string").alias("i"), v.alias("v")))
    # From the last on, so that $1 doesn't take the beginning of $10.
    return F.aggregate(F.reverse(pairs), message, lambda m, p: F.replace(m, F.concat(F.lit("$"), p["i"]), p["v"]))
