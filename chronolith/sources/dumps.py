"""Inspection dumps and result files: JSON structure dumps, bundles, CSV, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "key long, insert_worker long, insert_ts long, insert_invalid boolean, delete_worker long, delete_ts long"


def leaves(history: DataFrame, leaf) -> DataFrame:
    """One JSON line for each logical leaf: its key range and its versions."""
    cols = [x.split()[0] for x in VERSION.split(", ")]
    g = history.groupBy(leaf.alias("leaf")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sort_array(F.collect_list(F.struct(*cols))).alias("records"))
    return g.select(F.to_json(F.struct("leaf", "lo", "hi", "records"), {"ignoreNullFields": "false"}).alias("value"))


def read_leaves(lines: DataFrame) -> DataFrame:
    """Versions read back from a dump."""
    parsed = lines.select(F.from_json("value", f"leaf long, lo long, hi long, records array<struct<{VERSION.replace(' long', ':long').replace(' boolean', ':boolean')}>>").alias("x"))
    return parsed.select("x.leaf", F.explode("x.records").alias("r")).select("leaf", "r.*")


def bundle(tables: dict[str, DataFrame], snapshot: int) -> DataFrame:
    """Several tables at one snapshot as (table, snapshot, schema, row): each row
    and its table's schema as JSON, so that a reader needs nothing else."""
    parts = [
        df.select(F.lit(name).alias("table"), F.lit(snapshot).cast("long").alias("snapshot"), F.lit(df.schema.json()).alias("schema"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        for name, df in sorted(tables.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The columns of the result files, in order, with their types.
LAYOUTS = {
    "orders_per_second": "elapsed_sec long, new_order_committed long",
    "operations_per_second": "elapsed_sec long, ops_completed long",
    "latency": "operation string, p50_us double, p95_us double, p99_us double, count long, avg_us double, sample_every long",
    "scan": "mode string, elapsed_secs double, delay_secs double, snapshot long, scanned_tuples long, latency_ns long, tuples_per_sec double, summary string, staleness_versions long",
    "memory": "elapsed_sec double, rss_kb long, jemalloc_allocated_bytes long, jemalloc_active_bytes long, jemalloc_resident_bytes long, jemalloc_mapped_bytes long",
    "suite": "experiment string, gc_enabled boolean, duration_secs double, primary_metric_name string, primary_metric_value double, baseline_metric_value double, peak_rss_mb double, avg_rss_mb double, peak_jemalloc_resident_mb double",
    "allocation": "shard long, local_reuse long, steal long, fresh_alloc long, schema_version long, request_count long, latency_ns long, latency_max_ns long, scan_count long, lists_checked long, lists_checked_max long",
    "manifest": "engine string, workload string, config_label string, threads long, gc_enabled boolean, affinity string, duration_secs double, primary_metric_name string, primary_metric_value double, peak_rss_mb double, scan_p50_us double, scan_p95_us double, scan_p99_us double, scan_avg_us double, scan_count long, notes string, memory_source string",
}


def in_layout(df: DataFrame, layout: str) -> DataFrame:
    """The columns of a result file in its order and types; one that the rows
    have not is empty."""
    fields = [x.split() for x in LAYOUTS[layout].split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in fields))


def write_results(df: DataFrame, path: str, layout: str) -> None:
    in_layout(df, layout).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[layout]).option("header", True).csv(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """One more row (or a few) on a manifest of runs."""
    in_layout(df, "manifest").write.mode("append").option("header", True).csv(path)


def write_catalog(spark: SparkSession, names: list[str], path: str) -> None:
    """Table names, one a line, in order of creation."""
    spark.createDataFrame([("\n".join(names),)], "value string").write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, name): a table's id is its line."""
    text = spark.read.text(path, wholetext=True).where("value <> ''")
    return text.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("table_id", "name"))
