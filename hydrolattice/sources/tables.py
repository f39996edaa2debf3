"""Typed scans and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in any floating column becomes missing, so comparisons and aggregates behave alike everywhere."""
    fixes = {f.name: nan_to_null(f.name) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def read_csv(spark: SparkSession, path, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV (plain or gzip) with a declared schema; columns are matched by name through the header check.

    ``columns`` prunes the scan. Empty text and ``nan`` are missing values.
    """
    df = spark.read.schema(schema).option("nanValue", "nan").option("enforceSchema", False).csv(path, header=True)
    return without_nan(df.select(*columns) if columns else df)


def read_parquet(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return without_nan(df.select(*columns) if columns else df)


def require_types(df: DataFrame, schema: str) -> DataFrame:
    """The table itself; raises where one of its columns has another type than declared. Other columns may come or miss."""
    declared = {f.name: f.dataType for f in T._parse_datatype_string(schema)}
    wrong = [f"{f.name} is {f.dataType.simpleString()}, not {declared[f.name].simpleString()}" for f in df.schema if f.name in declared and f.dataType != declared[f.name]]
    if wrong:
        raise ValueError(f"column types differ from the declared ones: {'; '.join(wrong)}")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), *, replace_partitions: bool = False) -> None:
    """Overwrite a table, or only the partitions present in ``df``.

    Rows are gathered by partition value, with Spark free to split a large one, so files stay few and even.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("overwrite")
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)


def write_observed(df: DataFrame, path: str, aggregates: Sequence[Column], partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table and return one row of named aggregates, collected while it is written, without a second scan."""
    seen = Observation()
    write_parquet(df.observe(seen, *aggregates), path, partition_by)
    return df.sparkSession.createDataFrame([Row(**seen.get)], df.agg(*aggregates).schema)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Store a table hashed into sorted buckets by ``keys``, and read it back. Tables with the same keys and number of buckets
    join, and group, on these keys without moving rows; ``partition_by`` columns are pruned."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, *, gzip: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression="gzip" if gzip else "none")


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Text lines, such as newline-delimited GeoJSON features."""
    df.select(column).write.mode("overwrite").text(path)


def cached_scenes(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The per-scene cache as one table; a cached scene without rows adds nothing."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored Parquet table, or None when nothing is stored there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def extend_scene_cache(scenes: DataFrame, cache_path: str, compute, *, key: str = "scene_id") -> None:
    """Compute the scenes the cache lacks and store them as partitions; a scene is replaced as a whole."""
    cache = stored(scenes.sparkSession, cache_path)
    todo = scenes if cache is None else scenes.join(cache.select(key).distinct(), key, "left_anti")
    write_parquet(compute(todo), cache_path, [key], replace_partitions=True)
