"""What a step leaves behind: tables, their manifests, small reports and sample pictures, in one folder."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.checks import ensure_unique_key, require_columns
from strandline.operators.images import HEIGHT, WIDTH
from strandline.operators.registry import RegistryConfig, audit_tables, base_registry_id, config_hash, registry_audit, sample_set_id
from strandline.sources.tables import exists, markdown, read_manifest, read_text, write_manifest, write_registry, write_table, write_text, yaml


def _one(df: DataFrame) -> dict:
    """The row of a table of one row."""
    return df.first().asDict(recursive=True)


def registry_folder(registry: DataFrame, folder: str, config: RegistryConfig, full: bool = True, overwrite: bool = False, prefix: str = "reg") -> str:
    """A registry with its configuration (YAML) and its ids, settings and counts (JSON); one that is not full goes beside, under a suffix."""
    spark = registry.sparkSession
    path = write_registry(registry, f"{folder}/registry", full, overwrite)
    settings = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()}
    write_text(spark, f"{folder}/config.yaml", yaml(settings) + "\n")
    ids = {"base_registry_id": base_registry_id(config, prefix), "sample_set_id": sample_set_id(config, prefix), "config_hash": config_hash(config)}
    write_manifest(spark, f"{folder}/manifest.json", ids | {"config": settings, "full": full, "counts": _one(registry_audit(spark.read.parquet(path)))})
    return path


def registry_subset(sample: DataFrame, source: str, folder: str, overwrite: bool = False, **about) -> str:
    """A sample of a registry's folder, which must not be there unless ``overwrite``; the configuration is copied and the manifest says where it is from."""
    spark = sample.sparkSession
    if exists(spark, f"{folder}/registry") and not overwrite:
        raise FileExistsError(folder)
    path = write_registry(ensure_unique_key(sample, ["physical_window_id"], "subset"), f"{folder}/registry", True, overwrite)
    write_text(spark, f"{folder}/config.yaml", read_text(spark, f"{source}/config.yaml"))
    parent = read_manifest(spark, f"{source}/manifest.json")
    kept = {k: parent.get(k) for k in ("base_registry_id", "sample_set_id", "config_hash", "config")}
    write_manifest(spark, f"{folder}/manifest.json", kept | about | {"source": source, "counts": _one(registry_audit(spark.read.parquet(path)))})
    return path


def proxy_folder(proxy: DataFrame, folder: str, fmt: str = "auto") -> dict:
    """A table of features with its manifest. ``auto`` is Parquet, or CSV where Parquet cannot be written. All rows must be of one sample set."""
    if fmt not in ("auto", "parquet", "csv"):
        raise ValueError(f"unknown format {fmt}")
    require_columns(proxy, ["physical_window_id"], "proxy")
    sets = [r[0] for r in proxy.select("sample_set_id").distinct().limit(2).collect()] if "sample_set_id" in proxy.columns else [None]
    if len(sets) > 1:
        raise ValueError("the table holds several sample sets")
    table = ensure_unique_key(proxy, ["physical_window_id"], "proxy")
    done = "csv" if fmt == "csv" else "parquet"
    try:
        write_table(table, f"{folder}/proxy.{done}", done)
    except Exception:
        # a key that repeats fails in either format; a column that Parquet cannot hold may do as CSV
        if fmt != "auto" or proxy.groupBy("physical_window_id").count().filter("count > 1").limit(1).count():
            raise
        done = "csv"
        write_table(table, f"{folder}/proxy.csv", "csv")
    made = {"output_file": f"proxy.{done}", "format": done, "columns": proxy.columns, "sample_set_id": sets[0] if sets else None}
    write_manifest(proxy.sparkSession, f"{folder}/manifest.json", made)
    return made


def read_proxy(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame | None:
    """The features of a folder, or only some columns of them; None without a manifest."""
    if not exists(spark, f"{folder}/manifest.json"):
        return None
    m = read_manifest(spark, f"{folder}/manifest.json")
    raw = spark.read.csv(f"{folder}/{m['output_file']}", header=True) if m["format"] == "csv" else spark.read.parquet(f"{folder}/{m['output_file']}")
    return raw.select(*columns) if columns else raw


def tables_folder(tables: Mapping[str, DataFrame], summary: DataFrame | Mapping, folder: str, title: str | None = None, rows: int = 50) -> None:
    """An audit's or a comparison's bundle: its small tables as CSV, its summary as JSON, and a report of them as Markdown."""
    found = _one(summary) if isinstance(summary, DataFrame) else dict(summary)
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.csv", "csv", one_file=True)
    write_text(spark, f"{folder}/summary.json", json.dumps(found, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    if title:
        write_text(spark, f"{folder}/report.md", report(title, found, tables, rows))


def report(title: str, summary: Mapping, tables: Mapping[str, DataFrame], rows: int = 50) -> str:
    """A Markdown report: the summary as a list, then the first rows of each table."""
    lines = [f"# {title}", "", *[f"* {k}: {v}" for k, v in summary.items()], ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", markdown(df, rows), ""]
    return "\n".join(lines)


def registry_report(registry: DataFrame, folder: str, title: str = "Registry") -> None:
    """The audit of a registry: its five tables of counts and its summary."""
    tables_folder(audit_tables(registry), registry_audit(registry), folder, title)


def png(pixels: np.ndarray) -> bytes:
    """A picture of grey values from 0 to 1."""
    grey = np.clip(pixels * 255 + 0.5, 0, 255).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in grey)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def views_folder(made: DataFrame, folder: str, pictures: int = 0, **about) -> None:
    """Views as a Parquet table of arrays, their index as CSV, a manifest, and the first ``pictures`` windows as PNG, one for each view."""
    spark = made.sparkSession
    write_table(made.select("physical_window_id", "view"), f"{folder}/views")
    index = made.drop("view")
    write_table(index.select([c for c, t in index.dtypes if not t.startswith(("array", "struct", "map"))]), f"{folder}/index.csv", "csv", one_file=True)
    for r in made.orderBy("physical_window_id").limit(pictures).select("physical_window_id", "view").collect():
        for k, pixels in enumerate(np.array(r.view, np.float32).reshape(-1, HEIGHT, WIDTH)):
            _write_bytes(spark, f"{folder}/pictures/{r.physical_window_id}_{k}.png", png(pixels))
    write_manifest(spark, f"{folder}/manifest.json", {"shape": [3, HEIGHT, WIDTH], "windows": made.count()} | about)


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


def embeddings_folder(made: DataFrame, folder: str, latency: DataFrame | None = None, **about) -> None:
    """Embeddings as Parquet with columns z_0, z_1, ..., their index as CSV, timings as CSV and a manifest. A repeated window raises."""
    from strandline.sources.tables import wide

    dims = made.select(F.max(F.size("z"))).first()[0] or 0
    unique = ensure_unique_key(made.select("physical_window_id", "z"), ["physical_window_id"], "embeddings")
    write_table(wide(unique, "z", "z_", dims), f"{folder}/embeddings")
    index = made.drop("z")
    write_table(index.select([c for c, t in index.dtypes if not t.startswith(("array", "struct", "map"))]), f"{folder}/index.csv", "csv", one_file=True)
    if latency is not None:
        write_table(latency, f"{folder}/latency.csv", "csv", one_file=True)
    write_manifest(made.sparkSession, f"{folder}/manifest.json", {"embedding_dim": dims, "written": datetime.now(UTC).isoformat(timespec="seconds")} | about)


def search_space(result: Mapping, params: Mapping | None = None) -> dict:
    """The search space of a trial, from its result or else from its parameters; without one this raises."""
    for at in (result.get("config"), params, (params or {}).get("config")):
        if isinstance(at, Mapping) and isinstance(at.get("search_space"), Mapping):
            return dict(at["search_space"])
    raise FileNotFoundError("no search space in the trial")


def patched_datasets(config: dict, ids: Mapping[str, Sequence[int]], at: Sequence[str] = ("data", "datasets")) -> dict:
    """A configuration whose datasets hold only the items given; a dataset without items goes, as an empty list would mean all of them."""
    out = json.loads(json.dumps(config))
    node = out
    for k in at:
        node = node[k]
    for name in list(node):
        if name in ids:
            if ids[name]:
                node[name]["ids"] = list(ids[name])
            else:
                del node[name]
    if not node:
        raise ValueError("no dataset is left")
    return out
