"""Flow tables from CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.functions.numeric import coerce_numeric
from flowlake.sources.files import list_files

MERGED = "merged_flows.csv"
TEXT_COLUMNS = ("src_ip", "dst_ip", "scenario", "kind")
MAX_LAYOUTS = 1_000  # distinct header lines; one read per layout goes into the plan


def _csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("ignoreCorruptFiles", True).option("mode", "PERMISSIVE").csv(paths))


def typed_flows(raw: DataFrame, text_columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Everything but identifiers becomes double; text that is no number becomes null."""
    return raw.select(*[F.col(f"`{c}`") if c in text_columns
                        else coerce_numeric(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, header): first line of each file.

    Only the split at offset 0 of a file can hold it, and one task reads that split in
    order, so ``first`` is exact and the shuffle carries one line per file.
    """
    lines = (spark.read.option("ignoreCorruptFiles", True).text(paths)
             .select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("_at"), "value"))
    return lines.filter("_at = 0").groupBy("path").agg(F.first("value").alias("header"))


def union_flow_files(spark: SparkSession, paths: list[str],
                     text_columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Files of different layouts united by column name; absent columns are null.

    Files are read together per distinct header, so the plan grows with the number of
    layouts and not with the number of files.
    """
    layouts = (file_headers(spark, paths).groupBy("header")
               .agg(F.collect_list("path").alias("paths")).limit(MAX_LAYOUTS + 1).collect())
    if not layouts:
        raise ValueError("all flow files are empty")
    if len(layouts) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} file layouts; unite them by batch first")
    tables = [typed_flows(_csv(spark, sorted(r["paths"]), _names(r["header"])), text_columns)
              for r in sorted(layouts, key=lambda r: r["header"])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _names(header: str) -> list[str]:
    return [n.strip().strip('"') for n in header.lstrip("﻿").split(",")]


def flow_files(spark: SparkSession, path: str) -> list[str]:
    """Paths to read; Spark's own listing leaves out files of zero bytes.

    A non-empty ``merged_flows.csv`` (a file, or a folder of parts) is read alone.
    """
    found = list_files(spark, path).filter(
        F.col("path").contains(f"/{MERGED}") | F.col("file_name").endswith(".csv"))
    # Spark lists every input file on the driver to plan a scan; this is that same list.
    full = [r["path"] for r in found.filter("length > 0").select("path").collect()]
    merged = [p for p in full if f"/{MERGED}" in p]
    return sorted(merged or full)


def read_flows(spark: SparkSession, path: str,
               text_columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Folder of flow CSV files to one flow table."""
    paths = flow_files(spark, path)
    if not paths:
        raise FileNotFoundError(f"no CSV files with content in {path}")
    flows = union_flow_files(spark, paths, text_columns)
    if flows.isEmpty():
        raise ValueError("all flow files are empty")
    return flows
