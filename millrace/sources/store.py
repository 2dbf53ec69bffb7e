"""A store of collections: one folder a key, one numbered version a state.

A new state is written beside the old one and counts once it is complete, so readers of
the old one are not disturbed and a failed write leaves nothing behind that is read.
Single writer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, key: str) -> str:
        if not re.fullmatch(r"[\w-]+", key):
            raise ValueError("a key is letters, digits, _ and -")
        return f"{self.root}/{key}"

    def versions(self, key: str) -> list[int]:
        fs, p = self._fs(self._folder(key))
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(x.getName()) for x in found if x.getName().isdigit() and fs.exists(self._fs(f"{x}/_SUCCESS")[1]))

    def exists(self, key: str) -> bool:
        return bool(self.versions(key))

    def ensure(self, key: str, schema: T.StructType) -> None:
        """An empty collection if there is none."""
        if not self.exists(key):
            self.swap(key, self.spark.createDataFrame([], schema))

    def read(self, key: str) -> DataFrame:
        at = self.versions(key)
        if not at:
            raise KeyError(key)
        return self.spark.read.parquet(f"{self._folder(key)}/{at[-1]}")

    def swap(self, key: str, state: DataFrame) -> None:
        """A new state; the one before stays until the next swap, for readers under way."""
        at = self.versions(key)
        state.write.mode("overwrite").parquet(f"{self._folder(key)}/{(at[-1] if at else 0) + 1}")
        for old in at[:-1]:
            fs, p = self._fs(f"{self._folder(key)}/{old}")
            fs.delete(p, True)

    def drop(self, key: str) -> None:
        fs, p = self._fs(self._folder(key))
        if fs.exists(p):
            fs.delete(p, True)
