"""Token counts through a digest cache.

``token_counts`` joins the digest of each normalised content and the digest of the tokenizer file to
a table of stored counts, encodes only the distinct contents that the table lacks, appends them, and
gives every document its count. Copies of a content meet as partial aggregates, so a hot one is sent
once by each task and encoded once.

The cache is a folder that outlives the run. The query takes it from the setting ``CACHE`` of the
session; where that is unset each call begins a new one.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` and repeated rows
are kept, one result row each, and encoded once; other columns are ignored whatever their names; an empty table gives
an empty result with the same columns. Very long texts are counted whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import scratch
from . import memory, tokens

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Session setting that names the folder of stored counts.
CACHE = "spark.factloom.tokenCache"


def normalised(text):
    """Null becomes empty. Folding case or white space as well would be wrong for some tokenizers."""
    return F.coalesce(text, F.lit(""))


def _cache(spark, path: str) -> DataFrame:
    """The stored counts, one row a key; empty before the first append."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("version", "digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = 2048
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    ``tokenizer``: place of a tokenizer file, on every machine. ``cache``: folder of stored counts
    that all executors share; that of the setting ``CACHE`` where it is not given, else a fresh one.
    """
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    version = tokens.version(path)
    cache = cache or spark.conf.get(CACHE, None) or scratch.folder(spark, "token-cache")
    text = normalised(F.col("text"))
    digest = F.unhex(F.sha2(text, 256))
    keys = scratch.stored(docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")

    known = _cache(spark, cache).where(F.col("version") == version).select("digest")
    texts, once = docs.select(text.alias("text"), digest.alias("digest")), F.any_value("text").alias("text")
    if known.isEmpty():
        texts = texts.groupBy("digest").agg(once)
    else:
        missing, few = scratch.measured(keys.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses", 32)
        if few:  # the texts that are known stay where they are
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(once)
        else:  # one row a digest by now, so no key is hot
            texts = texts.groupBy("digest").agg(once).join(missing, "digest", "left_semi")

    def count(batches):
        enc = tokens.encoder(path)
        for b in batches:
            n = enc.counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    fresh = texts.select("digest", "text").mapInArrow(memory.by_task(count), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)

    counts = _cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")
    return scratch.hot_join(keys, counts.withColumnRenamed("digest", "counted"), F.col("digest"), "counted", F.monotonically_increasing_id(), "token-counts", 48, "inner").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
