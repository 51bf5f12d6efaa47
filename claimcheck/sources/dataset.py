"""The one fact table: files, caps, schema checks. Any DataFrame can be attached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import Config

MAX_BYTES, MAX_ROWS = 1 << 30, 100_000_000


class LoadError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    columns: dict[str, T.DataType]
    n_rows: int | None


def _size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise LoadError(f"{path}: not found")
    return fs.getContentSummary(p).getLength()


def read(spark: SparkSession, path: str, *, max_bytes: int | None = MAX_BYTES, delimiter: str = ",") -> DataFrame:
    """A Parquet or CSV file (or folder) by its suffix; ``max_bytes=None`` lifts the cap."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv"):
        raise LoadError(f"{path}: only .parquet and .csv can be read")
    size = _size(spark, path)
    if max_bytes is not None and size > max_bytes:
        raise LoadError(f"{path}: the dataset has {size} bytes; the cap is {max_bytes}")
    if suffix == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True, sep=delimiter)


def describe(spark: SparkSession, path: str, **options) -> dict[str, str]:
    """Column names and types; no rows are read from Parquet."""
    return {f.name: f.dataType.simpleString() for f in read(spark, path, **options).schema.fields}


def problems(columns: dict[str, T.DataType], config: Config) -> list[str]:
    out = []
    kind = columns.get(config.time_column)
    if kind is None:
        out.append(f"time column {config.time_column!r} is missing")
    elif not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out.append(f"time column {config.time_column!r} is {kind.simpleString()}, not a date or timestamp")
    for name, metric in config.metrics.items():
        if metric.column is None:
            continue
        kind = columns.get(metric.column)
        if kind is None:
            out.append(f"metric {name}: column {metric.column!r} is missing")
        elif metric.agg in ("sum", "avg") and not isinstance(kind, T.NumericType):
            out.append(f"metric {name}: column {metric.column!r} is {kind.simpleString()}, not a number")
    for name, entity in config.entities.items():
        if entity.column not in columns:
            out.append(f"entity {name}: column {entity.column!r} is missing")
    return out


def attach(df: DataFrame, config: Config, *, max_rows: int | None = MAX_ROWS) -> Dataset:
    """Check a table against the configuration; all problems are reported at once.

    ``max_rows=None`` lifts the cap and saves the count.
    """
    columns = {f.name: f.dataType for f in df.schema.fields}
    if found := problems(columns, config):
        raise LoadError("; ".join(found))
    n = None
    if max_rows is not None:
        n = df.count()
        if n > max_rows:
            raise LoadError(f"the dataset has {n} rows; the cap is {max_rows}")
    return Dataset(df, columns, n)


def load(spark: SparkSession, path: str, config: Config, *, max_bytes: int | None = MAX_BYTES, max_rows: int | None = MAX_ROWS, delimiter: str = ",") -> Dataset:
    return attach(read(spark, path, max_bytes=max_bytes, delimiter=delimiter), config, max_rows=max_rows)
