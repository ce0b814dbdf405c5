"""Shared pieces of the corpus operators: Arrow maps over whole texts, shared-storage checkpoints, bounded caches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows converted to Python objects at once inside an Arrow batch.
SLICE_ROWS = 256

#: All white space of the word rules: space and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, a local one for tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept on shared storage, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a compressed table on shared storage, and its path: for wide rows that resemble each other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str | None = None) -> None:
    """Delete a table of ``written``, and let Spark delete shuffles and checkpoints that nothing refers to any more.

    Spark does the latter when the driver's JVM collects garbage, which on a large heap may be after the job's end.
    """
    jvm = spark.sparkContext._jvm
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def row_key(df: DataFrame) -> Column:
    """struct(a, b): 128 bits of hashes of a whole row, in which a null is a value like any other wherever it stands."""
    flags = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    plain = [F.to_json(F.struct(f"`{f.name}`"), {"ignoreNullFields": "false"}) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema]
    return F.struct(F.xxhash64(flags, *plain).alias("a"), F.xxhash64(F.lit(1), flags, *plain).alias("b"))


def map_texts(
    df: DataFrame,
    outputs: str,
    make: Callable[[], Callable[[list], Sequence]],
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    where: str | None = None,
) -> DataFrame:
    """The carried columns of every row beside columns made from its whole text.

    ``make`` runs once for each task and returns a function from a list of texts (null: None)
    to one value list or array for each field of ``outputs``. ``where`` names a boolean output
    that is dropped and keeps only the rows where it is true.
    """
    fields = T._parse_datatype_string(outputs).fields
    kept = [f for f in fields if f.name != where]
    schema = T.StructType([df.schema[c] for c in carry] + kept)
    cols = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        kinds = {f.name: f.type for f in to_arrow_schema(T.StructType(fields))}
        work = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                work = work or make()
                made = work(part.column(len(cols)).to_pylist())
                made = {f.name: x if isinstance(x, pa.Array) else pa.array(x, kinds[f.name]) for f, x in zip(fields, made, strict=True)}
                arrays = [part.column(i) for i in range(len(cols))] + [made[f.name] for f in kept]
                arrays = [a.cast(t.type) if a.type != t.type else a for a, t in zip(arrays, arrow, strict=True)]
                out = pa.RecordBatch.from_arrays(arrays, names=arrow.names)
                yield out.filter(made[where]) if where else out

    return df.select(*cols, F.col(text).alias("__text")).mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that computes missing values and forgets them all, but for its start, when it holds ``most``."""

    def __init__(self, compute: Callable, most: int = 500_000, start: dict | None = None):
        super().__init__(start or {})
        self._compute, self._most, self._start = compute, most, start or {}

    def __missing__(self, key):
        value = self._compute(key)
        if len(self) >= self._most:
            self.clear()
            self.update(self._start)
        self[key] = value
        return value


def running_offsets(df: DataFrame, group: str, bucket: str, amount: Column, name: str) -> DataFrame:
    """(group, bucket, name): the sum of ``amount`` over the earlier buckets of the group.

    The sums of the buckets form a table that is smaller than the input by the rows of a bucket,
    so that no task orders a whole group.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(amount).alias("__sum"))
    return sums.select(group, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias(name))
