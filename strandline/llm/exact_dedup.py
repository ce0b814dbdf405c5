"""Exact deduplication as a stateful stream whose keyed state lies on disk and never expires.

A streaming aggregation in a RocksDB state store keeps, for the digest of each normalised text, the
count of rows, the smallest identifier and the locator (file and row) of the content that stays. The
aggregation combines rows before its shuffle, so a group of copies that holds a third of all rows sends
one row from each task. Hits are then held against the bytes that the locator names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import SPACE_CLASS, cut, release, shared_dir

#: Copies of one text that are held against one copy of the kept text.
HITS_PER_COPY = 500

#: Groups of copies, counted, up to which their table (some 200 bytes each) is broadcast.
BROADCAST_GROUPS = 100_000

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(df: DataFrame, digest) -> DataFrame:
    """Rows with their identifier, digest, locator and normalised text."""
    return df.select(
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        normalised(F.col("text")).alias("norm"),
    ).withColumn("digest", digest(F.col("norm")))


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _streamable(spark: SparkSession, path: str) -> str:
    """A file stream reads folders or patterns: one file is named by a pattern that only it matches."""
    fs, at = _fs(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(at).isFile() else path


def stream_groups(spark: SparkSession, path: str, folder: str, digest=sha256, files_per_batch: int | None = None, bytes_per_batch: int = 512 << 30) -> DataFrame:
    """(digest, at, n) of every distinct text under ``path``, from a stream that runs until it has read all of it.

    ``at`` is the identifier and locator of the row that stays. State and groups lie in ``folder`` on shared
    storage. Batches write their changed groups there, one folder for each, so a batch that is run again
    replaces its own output.
    """
    session = spark.newSession()
    for k, v in (STATE_CONF | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        session.conf.set(k, v)
    schema = session.read.parquet(path).select("doc_id", "text").schema
    source = session.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    if files_per_batch:
        source = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    groups = _keyed(source.parquet(_streamable(spark, path)), digest).groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n"))

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={k}")

    query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = f"digest string, at struct<none boolean, id {schema['doc_id'].dataType.simpleString()}, file string, row bigint>, n bigint"
    fs, at = _fs(spark, f"{folder}/groups")
    if not fs.exists(at):
        return spark.createDataFrame([], kinds)
    # counts only grow and the least only falls: the last state of a digest is its largest count and its least place
    states = spark.read.schema(kinds).parquet(f"{folder}/groups")
    return states.groupBy("digest").agg(F.min("at").alias("at"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of the Parquet table at ``path``.

    Null text is empty. The row with the smallest doc_id stays; of rows that share it, or have none, the
    one that comes first by file and row. A null doc_id counts after all others, and keep_id is null only
    in a group of nulls. Other columns are not read; an empty table gives no rows.

    Digests that coincide for different texts do not merge them: every hit is compared with the whole
    text that its group's locator names, and what differs is grouped by text.
    """
    folder = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    groups = stream_groups(spark, path, folder, digest, files_per_batch)
    shared = cut(groups.filter("n > 1").select("digest", F.col("at").alias("first"), "n"))
    del groups
    release(spark, folder)  # the groups that matter are kept; a text of its own needs none
    if shared.count() <= BROADCAST_GROUPS:
        shared = F.broadcast(shared)  # then only texts of groups move; beyond, all texts meet the groups by shuffle
    rows = _keyed(spark.read.parquet(path), digest)
    # each copy of a kept text meets at most HITS_PER_COPY hits on average, so no group lands in one task
    parts = F.expr(f"cast((n + {HITS_PER_COPY - 1}) div {HITS_PER_COPY} as int)")
    members = rows.join(shared, "digest").withColumn("salt", F.pmod(F.xxhash64("at"), parts).cast("int"))
    kept = members.filter("at = first").select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("norm").alias("kept_norm"))
    hits = members.filter("at != first").join(kept, ["digest", "salt"])
    differ = hits.filter("norm != kept_norm").select("digest").distinct()
    wrong = [r[0] for r in differ.limit(1).collect()]
    slim = rows.select("at", "digest", F.sha2("norm", 256).alias("text_sha256"))
    out = slim.join(shared, "digest", "left").select("at", F.coalesce("first", "at").alias("first"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), "text_sha256", "digest")
    if wrong:
        bad = rows.join(differ, "digest", "left_semi")
        again = bad.groupBy("norm").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        fixed = bad.join(again, "norm").select("at", "first", "n", F.sha2("norm", 256).alias("text_sha256"), "digest")
        out = out.join(differ, "digest", "left_anti").unionByName(fixed)
    return out.select(F.col("at.id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), (F.col("at") == F.col("first")).alias("kept"), "text_sha256")
