"""Operator 10: exact deduplication by skew-safe combining.

Rows are combined within their input partition, then by digest, text and a salt taken from the input
partition, then the salts' winners by digest and text: each stage compares the whole normalised text,
which is part of its grouping key.  A group of copies that holds a third of all rows reaches a task as
one row per input partition, spread over the salts.

Each row then learns its group.  The last stage has met every text with every other of its digest, so
it knows which digests stand for one text; rows of those look the group up by the digest alone, and the
texts needn't travel once more.  Rows of a digest that stands for several texts meet by the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stage, with_ids, without_ids

SALTS = 16
#: The white space that normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"
_TWO_64 = "18446744073709551616"
_TWO_63 = "9223372036854775808"


def _dec(text: str) -> Column:
    return F.expr(f"cast('{text}' as decimal(20,0))")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that is larger for more code points and, among equals, for a smaller doc_id; a null doc_id comes last."""
    last = F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)).cast("decimal(20,0)") + _dec(_TWO_63)
    return (n_chars.cast("decimal(10,0)") * _dec(_TWO_64) + (_dec(_TWO_64) - 1 - last)).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    u = _dec(_TWO_64) - 1 - F.pmod(rank, _dec(_TWO_64).cast("decimal(38,0)"))
    u = (u - _dec(_TWO_63)).cast("long")
    return F.when(u != 2**63 - 1, u)


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, n, norm and key (the digest) of each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.length(text).alias("n"), F.translate(text, SPACES, "").alias("norm"), *more)
    return rows.withColumn("key", _digest(F.col("norm")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space.  The row with the most code
    points stays, then the smallest doc_id.  Null text counts as empty; a null doc_id loses every tie
    and, if a whole group has no other, keep_id is null.  Rows that repeat both doc_id and text as it
    stands can't be told apart: each counts in group_size and shares the flag of the first.
    Empty tables give empty results; other columns, whatever their names, are not looked at.
    """
    rows = _keyed(docs, id_col, text_col)
    return _flagged(rows, *_winners(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _winners(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key, best (rank of the row that stays) and size of each group; those of digests that stand for several texts apart, with norm."""
    best, size = F.max(_rank(F.col("n"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("size")
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("key", "norm", "salt").agg(best, size)
    # Dealt by the digest, so that the grouping and the count of a digest's texts need no further shuffle.
    merged = salted.repartition("key").groupBy("key", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    counted = merged.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("key")))
    found = stage(counted.select("key", "best", "size", F.when(F.col("texts") > 1, F.col("norm")).alias("norm")))
    several = found.filter("norm IS NOT NULL")
    return found.filter("norm IS NULL").select("key", "best", "size"), several if several.limit(1).count() else None


def _found(rows: DataFrame, groups: DataFrame, several: DataFrame | None) -> DataFrame:
    """rows without norm, with best and size of their group."""
    slim = [c for c in rows.columns if c != "norm"]
    out = lookup(rows.select(*slim), groups, "key", "size", ["best", "size"])
    if several is None:
        return out
    shared = several.select(F.col("key").alias("_k")).distinct()
    out = out.join(shared, F.col("key") == F.col("_k"), "left_anti")
    met = lookup(rows.join(shared, F.col("key") == F.col("_k"), "left_semi"), several.drop("key"), "norm", "size", ["best", "size"])
    return out.unionByName(met.select(*out.columns))


def _flagged(rows: DataFrame, groups: DataFrame, several: DataFrame | None) -> DataFrame:
    found = _found(rows.withColumn("text_sha256", F.sha2("norm", 256)), groups, several)
    return found.select(
        "doc_id",
        _id_of(F.col("best")).alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (_rank(F.col("n"), F.col("doc_id")) == F.col("best")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that exact_groups drops.

    Rows that repeat a doc_id are one document, which stays if one of its rows does.  Rows without a
    doc_id can't be named and stay.  All columns pass through, whatever their names; an empty table
    gives an empty one.
    """
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter(~F.col("kept")).select("doc_id")
    return without_ids(docs, stage(gone), id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, whatever the ids: rows that repeat an id or have none are rows like others.

    The row that stays is the one of exact_groups; of rows that share its id and length, any one.
    All columns pass through, whatever their names.
    """
    rows = _keyed(docs, id_col, text_col)
    groups, several = _winners(rows)
    ids = stage(_flagged(rows, groups, several).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1 or doc_id is null"))
    # An id of one row names that row.
    named = without_ids(docs.filter(F.col(f"`{id_col}`").isNotNull()), ids.select("doc_id"), id_col)
    if ids.filter("kept or doc_id is null").limit(1).count() == 0:
        return named
    shared = ids.filter("doc_id is not null and kept").select("doc_id")
    rest = with_ids(docs, shared, id_col).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
    keyed = _keyed(rest, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _found(keyed, groups, several).filter(_rank(F.col("n"), F.col("doc_id")) == F.col("best"))
    # A rank within a digest names the text's id and length, not the text: digests of several texts are told apart by it as well.
    one = found.withColumn("norm", F.translate(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), SPACES, "")) if several is not None else found.withColumn("norm", F.lit(""))
    return named.unionByName(one.groupBy("key", "norm").agg(F.first("row").alias("row")).select("row.*"))
