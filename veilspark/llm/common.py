"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread

#: A key is hot when it holds at least this share of all rows, so there are at most 1 / HOT_SHARE hot keys to broadcast.
#: A key below it is a small part of a task's rows as long as a job has fewer than 1 / HOT_SHARE tasks.
HOT_SHARE = 1e-5
HOT_LEAST = 1000
#: Ids that a filter may broadcast (8 bytes each); beyond it the filter is a shuffled join.
BROADCAST_IDS = 1_000_000


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, so many at a time at most: whole texts can be long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shipped(df: DataFrame) -> DataFrame:
    """df, whose executors find this package."""
    ship(df.sparkSession)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; documents and pages over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a session that runs on this machine alone may do without it."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, where the loss of an executor can't reach it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with so many underscores in front that it is none of those taken (whose case Spark ignores)."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, by: DataFrame, key: str, size: str, values: list[str]) -> DataFrame:
    """rows left-joined with by, which has one row for each value of the key column and, in size, how many rows share it.

    Keys that hold HOT_SHARE of the rows or more are at most 1 / HOT_SHARE in number; those alone are
    broadcast, and their rows go anywhere in the shuffle in which all others meet their key.  Null keys
    find nothing.
    """
    total = by.agg(F.sum(size)).first()[0] or 0
    hot_from = max(HOT_LEAST, total * HOT_SHARE)
    hot_key, of_hot, cold_key, of_cold, away, near_by = fresh([*rows.columns, *values], "hot", "of_hot", "cold", "of_cold", "away", "near_by")
    hot = by.filter(F.col(size) >= hot_from).select(F.col(key).alias(hot_key), F.struct(*values).alias(of_hot))
    cold = by.filter(F.col(size) < hot_from).select(F.col(key).alias(cold_key), F.struct(*values).alias(of_cold), F.lit(0).cast("long").alias(near_by))
    own = [F.col(f"`{c}`") for c in rows.columns]
    near = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    # A task that is run again gives its rows the same places.
    plain = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    spread_out = F.when(F.col(hot_key).isNotNull() | F.col(key).isNull(), F.xxhash64(F.spark_partition_id(), *plain).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    both = near.withColumn(away, spread_out).join(cold, (F.col(key) == F.col(cold_key)) & (F.col(away) == F.col(near_by)), "left")
    found = F.coalesce(of_hot, of_cold)
    return both.select(*own, *[found[v].alias(v) for v in values])


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs but for the rows whose id is in ids.  ids is broadcast if it has BROADCAST_IDS rows at most."""
    return _met(docs, ids, id_col, "left_anti")


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is in ids, which is broadcast in the same way."""
    return _met(docs, ids, id_col, "left_semi")


def _met(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    (name,) = fresh(docs.columns, "met")
    own = ids.select(F.col(ids.columns[0]).alias(name))
    return docs.join(F.broadcast(own) if few else own, docs[id_col].cast("long") == F.col(name), how)
