"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number from its content alone, the number goes through a
keyed permutation of 0..N-1, and ``shard = p mod n`` and ``slot = p div n`` follow.
The sizes of shards differ by one row at most (law ``rows``), slots have no gaps, and
a reader can compute where row ``p`` lies without reading anything.

Global numbers without a global sort: rows are counted by identity (equal rows are
interchangeable, so a row repeated a billion times is one counted row), cut into
chunks of at most ``CHUNK`` copies, hashed into buckets of about ``BUCKET_ROWS`` rows,
and numbered inside a bucket; an array of bucket offsets makes the numbers global (eight
bytes for every ``BUCKET_ROWS`` rows: 800 kB for 100 billion).
"""

from __future__ import annotations

from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import free, hashable, packed, table, unpacked

BUCKETS, BUCKET_ROWS = 4096, 1 << 20
CHUNK = 65536
ROUNDS = 6


def _domain(n: int) -> tuple[int, int]:
    """The smallest a, b with a = ceil(sqrt(n)) and a * b >= n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= n:
        a -= 1
    return a, max(1, -(-n // a))


def _round_seed(seed: int, r: int) -> int:
    return (seed * 1_000_003 + r) % (1 << 62)


def _once_py(x: int, a: int, b: int, seed: int) -> int:
    """One pass of the permutation of 0..a*b-1, as ``_once`` computes it in Spark."""

    def mixed(value: int, r: int, m: int) -> int:
        first = xxhash.xxh64_intdigest(_round_seed(seed, r).to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), first)
        return (h - (1 << 64) if h >> 63 else h) % m

    left, right = x // b, x % b
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + mixed(right, r, a)) % a
        else:
            right = (right + mixed(left, r, b)) % b
    return left * b + right


def walk_bound(n: int, seed: int) -> int:
    """How many passes any row needs at most, exactly.

    Only the a*b - n < sqrt(n) + 1 numbers outside 0..n-1 are walked through again, so
    following each of them until it comes back inside gives the bound; at a trillion
    rows that is a million numbers on the driver.
    """
    a, b = _domain(n)
    most = 1
    for x in range(n, a * b):
        steps, y = 1, x
        while (y := _once_py(y, a, b, seed)) >= n and y != x:
            steps += 1
        most = max(most, 1 + steps if y < n else 1)  # a cycle wholly outside is entered by no row
    return most


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    def mixed(value: Column, r: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(_round_seed(seed, r)).cast("long"), value), F.lit(m).cast("long"))

    def step(r: int):
        if r % 2 == 0:
            return lambda s: F.struct(((s["l"] + mixed(s["r"], r, a)) % F.lit(a).cast("long")).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], r, b)) % F.lit(b).cast("long")).alias("r"))

    # each round is bound by a lambda, so that no round is computed twice
    state = F.array(F.struct(F.floor(x / F.lit(b).cast("long")).cast("long").alias("l"), (x % F.lit(b).cast("long")).alias("r")))
    for r in range(ROUNDS):
        state = F.transform(state, step(r))
    return F.element_at(F.transform(state, lambda s: s["l"] * F.lit(b).cast("long") + s["r"]), 1)


def permuted(x: Column, n: int, seed: int) -> Column:
    """The image of ``x`` under a permutation of 0..n-1; a bijection for every n and seed."""
    a, b = _domain(n)
    walk = F.sequence(F.lit(1), F.lit(walk_bound(n, seed)))
    start = F.lit(-1).cast("long")
    return F.aggregate(walk, start, lambda y, i: F.when((i > 1) & (y < n), y).otherwise(_once(F.when(i == 1, x).otherwise(y), a, b, seed)))


def assign_shards(df: DataFrame, n_shards: int, seed: int = 20_240_229) -> DataFrame:
    """Every row of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0).

    All columns of ``df`` are carried and together are a row's identity; pass a narrow
    frame (ids, sizes, digests) where texts need not move. The result depends on the
    rows, ``n_shards`` and ``seed`` only, not on files, partitions or executors.

    Nulls are values like others. Repeated rows stay repeated, each with a slot of its
    own. Maps and variants are told apart by their JSON. An empty frame gives an empty
    frame. Texts of any length may be carried. Columns called ``shard`` or ``slot`` in
    ``df`` are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    df = free(df, ["shard", "slot"])
    buckets = max(BUCKETS, df.count() // BUCKET_ROWS)
    names = [f"k{i}" for i in range(len(df.columns))]
    keyed = df.select(*[c.alias(n) for c, n in zip(hashable(df), names)], packed(df).alias("row"))
    # equal keys are equal rows, so the first one stands for all
    counted = keyed.groupBy(*names).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n")) if _nested(df) else keyed.drop("row").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long")))
    cut = (
        counted.select("*", chunks.alias("k"))
        .withColumn("m", F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("k") * CHUNK))
        .withColumn("b", F.pmod(F.xxhash64(F.lit(seed).cast("long"), *names, "k"), F.lit(buckets)).cast("int"))
        .drop("n")
    )
    totals = {r["b"]: r["m"] for r in cut.groupBy("b").agg(F.sum("m").alias("m")).collect()}  # one row a bucket at most
    n = sum(totals.values())
    sums = [0, *accumulate(totals.get(b, 0) for b in range(buckets))]
    offsets = F.from_json(F.lit(str(sums[:-1])), "array<bigint>")
    in_bucket = Window.partitionBy("b").orderBy(*names, "k").rowsBetween(Window.unboundedPreceding, -1)
    first = F.element_at(offsets, F.col("b") + 1) + F.coalesce(F.sum("m").over(in_bucket), F.lit(0))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    numbered = cut.withColumn("first", first).select("*", copies.alias("i")).withColumn("p", permuted(F.col("first") + F.col("i"), max(n, 1), seed))
    own = unpacked(df.columns, "row") if _nested(df) else [F.col(x).alias(c) for x, c in zip(names, df.columns)]
    return numbered.select(*own, (F.col("p") % n_shards).cast("int").alias("shard"), F.floor(F.col("p") / n_shards).cast("long").alias("slot"))


def _nested(df: DataFrame) -> bool:
    """Whether a column has to be hashed in another form than its own."""
    return any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in df.schema.fields)


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 20_240_229) -> None:
    """Writes ``df`` with one folder a shard, rows inside in the order of their slots.

    A shard is range-partitioned by slot, so that it may be larger than any task.
    """
    placed = assign_shards(df, n_shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``.

    A null text has size 8 and crc32 null's stand-in, the crc32 of no bytes (0).
    """
    text = F.coalesce("text", F.lit(""))
    digest = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign_shards(digest, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
