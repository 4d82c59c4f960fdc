"""Scratch tables in the folder that all executors share: lineage is cut by writing there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Copies of the smaller side of a join that is not broadcast, so that a hot key of the larger side is dealt over as many tasks.
SALTS = 16
_OWN: dict[str, str] = {}
_TRAILS: list[list[str]] = []
#: Bytes of a table that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16_000_000


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, a local master uses a temporary folder of its own, as in tests;
    on a cluster there is no folder that all executors share, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN["base"] = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    for trail in _TRAILS:
        trail.append(path)
    return path


@contextlib.contextmanager
def trail():
    """The paths given out inside the block, for ``delete`` when nothing reads them any more."""
    paths: list[str] = []
    _TRAILS.append(paths)
    try:
        yield paths
    finally:
        _TRAILS.remove(paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of scratch tables."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, row_bytes: Column | int = 16, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` stored, and whether its measured size is within ``limit`` (``BROADCAST_BYTES`` unless said)."""
    kept = stored(df, name)
    size = kept.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return kept, size <= (BROADCAST_BYTES if limit is None else limit)


def sized(df: DataFrame, name: str, row_bytes: Column | int = 16, limit: int | None = None) -> DataFrame:
    """``df`` stored, and marked for broadcast only if its measured size is within ``limit``."""
    kept, small = measured(df, name, row_bytes, limit)
    return F.broadcast(kept) if small else kept


def hot_join(left: DataFrame, right: DataFrame, key: Column, right_key: str, spread: Column, name: str, row_bytes: Column | int = 16, how: str = "left") -> DataFrame:
    """``left`` joined null-safely to ``right``, whose rows are few a key; any key may hold much of ``left``.

    ``right`` is broadcast if its measured size allows; beyond that it is repeated ``SALTS`` times and ``left`` is dealt by
    ``spread`` too, so a hot key is no hot task.
    """
    side, small = measured(right, name, row_bytes)
    if small:
        return left.join(F.broadcast(side), key.eqNullSafe(F.col(right_key)), how)
    salt, own = column_like("_salt", [*left.columns, *right.columns]), column_like("_own_salt", [*left.columns, *right.columns])
    side = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn(own, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(side, key.eqNullSafe(F.col(right_key)) & (F.col(own) == F.col(salt)), how).drop(salt, own)


def column_like(name: str, taken: list[str]) -> str:
    """A helper column's name that clashes with none of ``taken``, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
