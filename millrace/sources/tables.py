"""Reading tables, byte ranges and request parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a primary or unique key (dotted paths reach into structs)."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def live_by(df: DataFrame, key: str, value: object, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """Rows of a secondary key that have not expired."""
    return df.where((F.col(key) == F.lit(value)) & (F.col(expires) > as_of))


def exists(df: DataFrame, predicate: Column) -> DataFrame:
    """One row, ``found``: whether any row fulfils the predicate; one is enough to stop."""
    return df.where(predicate).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Objects with path, modificationTime, length and content; columns that are not used are not read."""
    return spark.read.format("binaryFile").load(path)


def byte_range(content: Column, header: str | None) -> Column:
    """The bytes that a range header (``bytes=5-9``, ``bytes=5-``) asks for, both ends included; all without one."""
    if not header or not header.startswith("bytes="):
        return content
    first, _, last = header.removeprefix("bytes=").split(",")[0].partition("-")
    size = F.octet_length(content)
    if not first:
        start = F.greatest(size - int(last), F.lit(0))
        return F.substring(content, start + 1, size)
    end = F.least(F.lit(int(last)), size - 1) if last else size - 1
    return F.substring(content, F.lit(int(first) + 1), F.greatest(end - int(first) + 1, F.lit(0)))


def parameters(pairs: Mapping[str, str | list[str]]) -> dict[str, str]:
    """One value a key: the first of several."""
    return {k: v if isinstance(v, str) else v[0] for k, v in pairs.items() if v}
