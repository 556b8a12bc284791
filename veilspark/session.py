"""Makes this package importable where Python workers run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """spark, whose executors from now on find this package, on any machine; done once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(file))
        _SHIPPED.add(sc.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files make fewer: a file of one row group is one task.

    Inputs with more partitions than cores, all large ones, pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
