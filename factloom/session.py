"""Reading tables and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows between the JVM and Python, unless the session asks for smaller ones.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context; modules stay loaded there. Batches are bounded by bytes, since a
    bound on rows says nothing about texts."""
    sc = spark.sparkContext
    asked = spark.conf.get(BATCH_SETTING).lower().removesuffix("b")
    if not asked.isdigit() or not 0 < int(asked) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if getattr(sc, "_factloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "factloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".npz")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._factloom_shipped = True
