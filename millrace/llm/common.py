"""What several operators share: table access, shared storage, word patterns."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session on one machine that names none gets a folder of its own; on a cluster that
    is an error, as executors do not see one another's folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "/tmp/millrace-checkpoints"
    return place.rstrip("/")


class _Written(threading.local):
    """What ``saved`` wrote in this thread and ``forget`` has not deleted yet, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts lineage, and what follows survives the loss of any executor. The size of what
    is read is known, so that a join may broadcast it only if it is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``forget``: what is written from now on comes after it."""
    return len(_WRITTEN.paths)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what ``saved`` wrote since a mark, but for the last ``keep``; frames over it can no longer be read."""
    until = len(_WRITTEN.paths) - keep
    gone, _WRITTEN.paths[since:until] = _WRITTEN.paths[since:until], []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in a form that can be hashed and grouped by: maps and variants as JSON."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    own = lambda f: F.col(f"`{f.name}`")
    return [own(f) if plain(f.dataType) else F.to_json(F.struct(own(f).alias("v"))) for f in df.schema.fields]


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names of its columns and of an operator's own cannot clash."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def unpacked(columns: list[str], at: str, new: dict[str, Column] | None = None) -> list[Column]:
    """The columns again from the struct ``at``, those in ``new`` replaced."""
    return [(new or {}).get(c, F.col(f"{at}.c{i}")).alias(c) for i, c in enumerate(columns)]


def free(df: DataFrame, new: list[str]) -> DataFrame:
    """``df`` without the columns that are named like one of the results in ``new``; results replace them."""
    taken = {c.lower() for c in new}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst inlines a projected expression into every place that uses it; inside a
    lambda that is once an element. A lambda variable is not inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow; at a task's end its worker gives back the memory that is free.

    Spark keeps Python workers for later tasks; what an idle one holds still counts
    against its executor while the JVM works.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return held


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session.

    The driver serves the archive, so executors need neither an installed package nor a
    shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp()) / "millrace_package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((root / "millrace").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(str(path))
    context._millrace_shipped = True
