"""Sources and sinks: panels, codebooks, registries, caches, manifests and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.checks import ensure_unique_key, require_columns
from strandline.operators.oracle import union_caches
from strandline.operators.panel import first_items
from strandline.operators.sampling import keep_last

CODEBOOK_SCHEMA = "official_cluster_code int, official_tsf_cell string"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by way of Hadoop's file systems, so that it lands where the tables are."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_panel(spark: SparkSession, folder: str, subsets: Sequence[str], items: int | None = None) -> DataFrame:
    """The union of the subsets' Parquet files (``test_<subset>-*.parquet``), of the first items by id if asked."""
    parts = [spark.read.parquet(f"{folder}/test_{s}-*.parquet").withColumn("subset", F.lit(s)) for s in subsets]
    panel = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return first_items(panel, items) if items else panel


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; only the two columns that the codebook needs, by name."""
    raw = require_columns(spark.read.csv(path, header=True), ["official_cluster_code", "official_tsf_cell"], "codebook")
    return raw.select(F.col("official_cluster_code").cast("int"), "official_tsf_cell")


def read_registry(spark: SparkSession, path: str, head: int | None = None, order: Sequence[str] = ("subset", "item_id", "split", "target_start_idx", "channel"), sample=None) -> DataFrame:
    """A registry, its first rows in its order, or a sample by a function of the registry; not both."""
    if head and sample:
        raise ValueError("head and sample exclude each other")
    registry = ensure_unique_key(spark.read.parquet(path), ["physical_window_id"], "registry")
    if head:
        return registry.orderBy(*order).limit(head)
    return sample(registry) if sample else registry


def read_caches(spark: SparkSession, folders: Sequence[str], table: str = "errors", experts: Sequence[str] | None = None) -> DataFrame:
    return union_caches([spark.read.parquet(f"{f}/{table}") for f in folders], experts)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An earlier result, or an empty table of that schema."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_registry(registry: DataFrame, path: str, full: bool = True, overwrite: bool = False) -> str:
    """Parquet by subset and split; a registry that is not full goes beside, under a suffix."""
    path = path if full else f"{path}_partial"
    registry.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("subset", "split").parquet(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", one_file: bool = False, overwrite: bool = True) -> None:
    """Parquet or CSV; one file only for reports, which are small."""
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    (out.option("header", True) if fmt == "csv" else out).save(path)


def write_cache(folder: str, predictions: DataFrame, errors: DataFrame, profiling: DataFrame | None = None, manifest: dict | None = None) -> None:
    """An expert cache: predictions and errors as Parquet, profiling as CSV, and its manifest."""
    found = sorted(r[0] for r in errors.select("expert_id").distinct().collect())
    if manifest and manifest.get("experts") not in (None, found):
        raise ValueError(f"the manifest names {manifest['experts']}, the errors hold {found}")
    write_table(predictions, f"{folder}/predictions")
    write_table(errors, f"{folder}/errors")
    if profiling is not None:
        write_table(profiling, f"{folder}/profiling", "csv", one_file=True)
    write_manifest(errors.sparkSession, f"{folder}/manifest.json", {"experts": found} | (manifest or {}))


def append_batch(df: DataFrame, path: str, columns: Sequence[str], keys: Sequence[str], order: str) -> None:
    """Adds a batch in a fixed order of columns, missing ones null; readers take the last row of each key."""
    have = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
    keep_last(have, keys, order).write.mode("append").parquet(path)


def wide(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """An array as numbered columns, for files that want them."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)])


def write_manifest(spark: SparkSession, path: str, data: dict) -> None:
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def yaml(data: dict, depth: int = 0) -> str:
    """A dict of scalars, lists and dicts as plain YAML."""
    pad, out = "  " * depth, []
    for k, v in data.items():
        if isinstance(v, dict):
            out += [f"{pad}{k}:", yaml(v, depth + 1)]
        elif isinstance(v, (list, tuple)):
            out += [f"{pad}{k}:", *[f"{pad}  - {json.dumps(x, ensure_ascii=False)}" for x in v]]
        else:
            out.append(f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(out)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small table as Markdown."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(rows).collect()]])


def merged(base: dict, change: dict) -> dict:
    """Nested dicts merged, the change winning."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in change.items()}


def last_json_line(text: str) -> dict:
    """The last line that is a JSON object."""
    for line in reversed(text.splitlines()):
        try:
            if isinstance(found := json.loads(line), dict):
                return found
        except ValueError:
            continue
    raise ValueError("no line is a JSON object")


def best_trial(results: DataFrame, metric: str = "best_metric") -> DataFrame:
    """The row with the least metric."""
    return results.filter(F.col(metric).isNotNull()).orderBy(metric).limit(1)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, the oldest first by modification time."""
    fs, p = _path(spark, pattern)
    return [path for _, path in sorted((s.getModificationTime(), s.getPath().toString()) for s in (fs.globStatus(p) or []))]


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The newest path that matches, by modification time."""
    return (found(spark, pattern) or [None])[-1]
