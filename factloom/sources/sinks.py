"""Sinks: splits as JSON lines, verified archives, and the pointer to the active build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a digest that does not depend on their order but on how often each is there."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    n, one, two = df.agg(F.count(F.lit(1)), F.sum(h), F.sum((h % 1000003) * (h % 1000003))).first()
    return n, f"{one or 0}/{two or 0}"


def write_splits(df: DataFrame, path: str, split: str = "split") -> DataFrame:
    """JSON lines below a folder for each split; gives the manifest of rows by split."""
    df.write.partitionBy(split).json(path)
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))


def archive(df: DataFrame, path: str) -> tuple[int, str]:
    """Write ZSTD Parquet, read it again, and compare; only then may the source be dropped."""
    df.write.option("compression", "zstd").parquet(path)
    before, after = digest(df), digest(df.sparkSession.read.schema(df.schema).parquet(path))
    if before != after:
        raise ValueError(f"the archive at {path} is not what was written")
    return after


def write_build(df: DataFrame, path: str, build_id: str) -> None:
    """A build's rows; the pointer is a new small file in a folder of its own, named after them when they are all there.

    Pointers are only added, never rewritten, so a crash leaves the build before in force.
    """
    df.write.mode("overwrite").parquet(f"{path}/build_id={build_id}")
    spark = df.sparkSession
    seen = [r[0] for r in _pointers(spark, path).select("turn").collect()]
    turn = max(seen, default=0) + 1
    spark.createDataFrame([(turn, build_id)], "turn long, build_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_active/turn-{turn:09d}")


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    """(turn, build_id) of every pointer that was written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_active")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [str(x.getPath()) for x in fs.listStatus(at)] if fs.exists(at) else []
    whole = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    return spark.read.schema("turn long, build_id string").parquet(*whole) if whole else spark.createDataFrame([], "turn long, build_id string")


def read_active(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the build that the last pointer names."""
    last = _pointers(spark, path).agg(F.max(F.struct("turn", "build_id")).alias("last")).first()["last"]
    if last is None:
        raise ValueError(f"no active build at {path}")
    return spark.read.parquet(f"{path}/build_id={last['build_id']}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes and edges as JSON lines in a folder each; gives (part, rows, bytes_crc) of what was written, read back from there."""
    out = None
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("errorifexists").json(f"{path}/{name}")
        found = df.sparkSession.read.text(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.crc32("value").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("bytes_crc"))
        out = found if out is None else out.unionByName(found)
    return out


def combine_exports(frames: list[DataFrame], path: str, order: list[str], split: str = "split") -> DataFrame:
    """Several exports as one, each split's rows in order; gives the manifest (split, rows, exports, ids_sha256) of all.

    Columns that an export lacks are null. An id that two exports carry stays twice, and the manifest's ``rows`` above ``ids`` shows it.
    The digest is of the sorted digests of 4,096 id buckets, so no split's ids meet in one task.
    """
    out = None
    for k, f in enumerate(frames):
        one = f.withColumn("export", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out.repartitionByRange(split, *order).sortWithinPartitions(split, *order).write.mode("errorifexists").partitionBy(split).json(path)
    key = F.sha2(F.to_json(F.struct(*order)), 256)
    buckets = out.select(split, "export", key.alias("k")).groupBy(split, F.pmod(F.xxhash64("k"), F.lit(4096)).alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("ids"), F.collect_set("export").alias("e"), F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("d")
    )
    return buckets.groupBy(split).agg(
        F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.size(F.array_distinct(F.flatten(F.collect_list("e")))).alias("exports"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("ids_sha256"),
    )


def write_report(rows: DataFrame, path: str, title: str, most: int = 1000) -> int:
    """A small table as JSON lines and as Markdown, below a folder; more than ``most`` rows are an error, since a report is read whole."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in found)]
    spark = rows.sparkSession
    spark.createDataFrame(found, rows.schema).coalesce(1).write.mode("overwrite").json(f"{path}/json")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
    return len(found)
