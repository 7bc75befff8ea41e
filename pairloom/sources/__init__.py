"""Point tables from files and DataFrames, and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(df: DataFrame, row_id: str, vectors: dict[str, list[Column | str] | Column | str], as_id: str = "i", keep: list[str] = ()) -> DataFrame:
    """A point table: a BIGINT id and one DOUBLE array or number for each variable.

    Rows whose id or any component is null are dropped here, as pair queries
    refuse nulls; floats are widened before any arithmetic.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = [col(row_id).cast("long").alias(as_id)]
    for name, v in vectors.items():
        if isinstance(v, list):
            out.append(F.array(*(col(c).cast("double") for c in v)).alias(name))
        else:
            array = isinstance(v, str) and df.schema[v].dataType.typeName() == "array"
            out.append(col(v).cast("array<double>" if array else "double").alias(name))
    made = df.select(*out, *keep)
    whole = F.col(as_id).isNotNull()
    for name in vectors:
        whole = whole & F.col(name).isNotNull()
        if made.schema[name].dataType.typeName() == "array":
            whole = whole & ~F.exists(name, lambda x: x.isNull())
    return made.where(whole)


def components(df: DataFrame, column: str = "value", prefix: str = "v", size: int = 1, digits: int | None = None) -> DataFrame:
    """The array column as one column for each component, rounded for comparison with other engines."""
    part = lambda k: F.col(column)[k] if digits is None else F.round(F.col(column)[k], digits) + F.lit(0.0)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(part(k).alias(f"{prefix}{k + 1}") for k in range(size)))


def write(df: DataFrame, path: str, **options) -> None:
    """A result as Parquet."""
    df.write.options(**options).parquet(path)
