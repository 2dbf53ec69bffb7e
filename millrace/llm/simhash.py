"""SimHash near-duplicates, found through vantage-point trees.

Texts get a fingerprint of 64 or more bits; fingerprints that differ in few bits are
linked, and linked documents form components.

Distances between unlike fingerprints crowd around half the bits, where a tree over the
whole fingerprint prunes nothing. So trees are built over projections, subsets of the
bits. With 64 bits and a limit of 4, the three blocks of 21, 21 and 22 bits are enough:
of two fingerprints that differ in 4 bits or fewer, one block differs in one bit or
none, so that three trees of radius 1 find every pair. Wider fingerprints with a larger limit
take random projections, whose number sets the recall.

A tree sends every fingerprint home to one shard, and as a guest to those shards whose
boundary lies within the radius (the triangle bound): |d(x,v) - d(y,v)| <= d(x,y). A
shard is searched by a tree of its own, down to small leaves. It returns a spanning
forest of the links found, never all pairs of a group.

Where a similarity is asked for (``alike``), fingerprints only name candidates; a pair is
a link if the shingle sets themselves are that similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import forget, saved, ship, table, tidy, written
from millrace.llm.components import components

#: Fingerprints that have their home in one shard, about.
SHARD = 40_000
#: Fingerprints that choose vantage points and medians; they decide the balance of shards, never a result.
SAMPLE = 20_000
LEAF = 192
#: From so many fingerprints on, exact plans take blocks in pairs (see Plan.fitted).
WIDE = 1 << 33
#: Shingles of one block of sets that are compared in one task, about.
BLOCK = 1 << 18
#: Sets are alike if they share at least 4 / 5 of their union.
SHARED, UNION = 4, 5

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Plan:
    """What is linked: shingles of ``words`` words, ``bits`` bits, at most ``limit`` of them different."""

    words: int
    bits: int
    limit: int
    projections: tuple[tuple[int, ...], ...]
    radius: int = 1

    @classmethod
    def exact(cls, words: int = 4) -> Plan:
        """64 bits and 4 different ones at most; no pair is missed."""
        return cls(words, 64, 4, (tuple(range(0, 21)), tuple(range(21, 42)), tuple(range(42, 64))))

    def fitted(self, n: int) -> Plan:
        """The plan for ``n`` fingerprints; what is linked stays the same.

        Three blocks with radius 1 compare a fingerprint with n / 95,000 others a tree, which
        grows with n. Beyond WIDE the blocks are taken in pairs: of 4 differing bits one
        pair of blocks holds 2 at most, so three trees of 42 or 43 bits and radius 2 find
        every pair too, and compare with n / 9,000,000,000; their trees send more guests,
        which pays only there.
        """
        if self.bits != 64 or self.limit != 4 or n < WIDE:
            return self
        a, b, c = Plan.exact().projections
        return replace(self, projections=(a + b, a + c, b + c), radius=2)

    @classmethod
    def similar(cls, words: int = 5, bits: int = 256, limit: int = 48, projections: int = 32, size: int = 18, seed: int = 5) -> Plan:
        """A Jaccard similarity of 0.8 changes 39 of 256 bits on average, with a deviation of 6.

        Two fingerprints at that distance meet in one of 32 trees (18 bits, radius 1) with
        a probability of 0.999, and with one of 0.98 at 48 bits; unlike texts differ in 128
        bits, with a deviation of 8.
        """
        rng = np.random.default_rng(seed)
        return cls(words, bits, limit, tuple(tuple(sorted(rng.choice(bits, size, replace=False).tolist())) for _ in range(projections)))

    @classmethod
    def candidates(cls) -> Plan:
        """Candidates for a similarity of 0.8, to be checked exactly: 60 bits leave 3.5 deviations of room."""
        return replace(cls.similar(), limit=60)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in their order; a text of ``words`` words or fewer is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(x) + 1 for x in w])
        starts = [0, *ends[: len(w) - words].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, words: int, bits: int) -> np.ndarray:
    """The fingerprint as bits // 64 unsigned integers; bits beyond the first 64 come from mixing the hashes again."""
    return _folded(shingles(text, words), bits // 64)


def _folded(h: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros(parts, dtype=np.uint64)
    if not len(h):
        return out
    for p in range(parts):
        if p:
            h = _mixed(h)
        counts = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[p] = np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(df: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bytes, most significant first.

    A bit that is set in exactly half the hashes is 0. Null and empty texts have no
    shingles and the fingerprint zero. Texts of any length are read whole; repeated rows
    stay. Other columns are left out.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, plan.words, plan.bits)[::-1].astype(">u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fp"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def _stack(fps: list[bytes], plan: Plan) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(fps), dtype=">u8").reshape(len(fps), plan.bits // 64)[:, ::-1].astype(np.uint64))


def _keys(fps: np.ndarray, projection: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for i, bit in enumerate(projection):
        out |= ((fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(i)
    return out


def _cut(keys: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point among ``keys`` and the distance that halves them best; None if none of a few tried divides them."""
    best = None
    for v in rng.choice(keys, min(4, len(keys)), replace=False).tolist():
        d = np.bitwise_count(keys ^ keys.dtype.type(v))
        below = np.cumsum(np.bincount(d, minlength=65)) / len(d)
        m = int(np.abs(below - 0.5).argmin())
        if 0 < below[m] < 1 and (best is None or abs(below[m] - 0.5) < best[0]):
            best = (abs(below[m] - 0.5), v, m)
    return best[1:] if best else None


def _plant(keys: np.ndarray, levels: int, rng: np.random.Generator) -> list | None:
    """A tree as [vantage point, distance, left, right]; None where the sample ends."""
    if levels == 0 or len(keys) < 32 or (cut := _cut(keys, rng)) is None:
        return None
    left = np.bitwise_count(keys ^ np.uint64(cut[0])) <= cut[1]
    return [*cut, _plant(keys[left], levels - 1, rng), _plant(keys[~left], levels - 1, rng)]


def _divide(v: int, m: int, radius: int, keys: np.ndarray, home: np.ndarray, guest: np.ndarray):
    """(home, guest) on the left and on the right of a vantage point.

    Of a linked pair divided here, the right one is a guest on the left: its distance to
    the vantage point is at most ``radius`` more than that of the left one.
    """
    dh, dg = np.bitwise_count(keys[home] ^ np.uint64(v)).astype(np.int16), np.bitwise_count(keys[guest] ^ np.uint64(v)).astype(np.int16)
    over = home[(dh > m) & (dh <= m + radius)]
    return (home[dh <= m], np.concatenate((guest[dg <= m + radius], over))), (home[dh > m], guest[dg > m - radius])


def _route(tree, keys: np.ndarray, radius: int, levels: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, home, guest) for each leaf that gets something.

    Below the planted nodes a node's number gives its vantage point, and half the bits
    its distance, so that a tree of any depth needs no more memory than the sample.
    """
    todo = [(tree, 1, np.arange(len(keys)), np.zeros(0, dtype=np.int64))]
    while todo:
        node, number, home, guest = todo.pop()
        if not len(home) and not len(guest):
            continue
        if node is None and number.bit_length() > levels:
            yield number, home, guest
            continue
        if node is None:
            node = [int(_mixed(np.array([number], dtype=np.uint64))[0]) & ((1 << bits) - 1), (bits - 1) // 2, None, None]
        left, right = _divide(node[0], node[1], radius, keys, home, guest)
        todo += [(node[2], 2 * number, *left), (node[3], 2 * number + 1, *right)]


def forest(fps: np.ndarray, n_home: int, keys: np.ndarray, limit: int, radius: int) -> np.ndarray:
    """A label for each fingerprint; those linked through ``fps`` have the same. The first ``n_home`` are at home.

    Pairs of which both have the label already are not looked at again, so that a dense
    group costs little more than its members.
    """
    label = np.arange(len(fps))
    rng = np.random.default_rng(len(fps))

    def compare(home: np.ndarray, other: np.ndarray) -> None:
        step = max(1, (1 << 19) // max(1, len(other)))
        y = fps[other]
        for lo in range(0, len(home), step):
            some = home[lo : lo + step]
            d = np.bitwise_count(fps[some, 0][:, None] ^ y[None, :, 0]).astype(np.uint16)
            for p in range(1, fps.shape[1]):
                d += np.bitwise_count(fps[some, p][:, None] ^ y[None, :, p])
            near = (d <= limit) & (label[some][:, None] != label[other][None, :])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                met = np.unique(label[other[near[i]]])
                mine = label[some[i]]
                if len(met) and (len(met) > 1 or met[0] != mine):
                    met = np.append(met, mine)
                    label[np.isin(label, met)] = met.min()

    for home, other in _leaves(n_home, keys, radius, rng):
        compare(home, other)
    return label


def _leaves(n_home: int, keys: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, home and guests) of every leaf of a shard."""
    todo = [(np.arange(n_home), np.arange(n_home, len(keys)))]
    while todo:
        home, guest = todo.pop()
        if not len(home):
            continue
        cut = _cut(keys[home], rng) if len(home) > LEAF else None
        if cut is None:
            yield home, np.concatenate((home, guest))
        else:
            todo += list(_divide(*cut, radius, keys, home, guest))


def pairs(fps: np.ndarray, n_home: int, keys: np.ndarray, size: np.ndarray, limit: int, radius: int) -> np.ndarray:
    """Candidate pairs (rows of two places): a spanning forest of the nearest in each leaf, never all of them.

    Sets whose sizes alone keep them below the similarity are no candidates.
    """
    label = np.arange(len(fps))
    found = [np.zeros((0, 2), dtype=np.int64)]
    for home, other in _leaves(n_home, keys, radius, np.random.default_rng(len(fps))):
        step = max(1, (1 << 19) // len(other))
        y = fps[other]
        for lo in range(0, len(home), step):
            some = home[lo : lo + step]
            d = np.bitwise_count(fps[some, 0][:, None] ^ y[None, :, 0]).astype(np.uint16)
            for p in range(1, fps.shape[1]):
                d += np.bitwise_count(fps[some, p][:, None] ^ y[None, :, p])
            i, j = np.nonzero(d <= limit)
            near, a, b = d[i, j], some[i], other[j]
            fit = (label[a] != label[b]) & (UNION * np.minimum(size[a], size[b]) >= SHARED * np.maximum(size[a], size[b]))
            near, a, b = near[fit], a[fit], b[fit]
            order = np.argsort(near, kind="stable")
            a, b = a[order], b[order]
            while len(a):
                # the nearest pair of every label, until no pair leads from one label to another
                _, first = np.unique(np.column_stack((label[a], label[b])), return_index=True)
                for k in np.unique(first // 2).tolist():
                    x, z = label[a[k]], label[b[k]]
                    if x != z:
                        label[label == max(x, z)] = min(x, z)
                        found.append(np.array([[a[k], b[k]]]))
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    return np.concatenate(found)


def true_links(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Links (rows of two places) between sets of different labels: a spanning forest of all there are.

    Shared shingles are counted through an inverted index, a row of counts for a set. Of
    two sets that end with different labels one is outside the most frequent label, so
    rows are needed for those only; sets whose shingles are the most common come first,
    as they lie in the middle of a group.
    """
    label = np.unique(label, return_inverse=True)[1]
    found = [np.zeros((0, 2), dtype=np.int64)]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    own = np.concatenate(([0], np.cumsum(size)))
    shingle = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.int64)]), return_inverse=True)[1].astype(np.int32)
    holders = np.repeat(np.arange(len(sets), dtype=np.int32), size)[np.argsort(shingle, kind="stable")]
    often = np.bincount(shingle)
    starts = np.concatenate(([0], np.cumsum(often)))
    common = np.add.reduceat(np.append(often[shingle], 0), np.minimum(own[:-1], len(shingle))) / np.maximum(size, 1) if len(sets) else size
    most = np.bincount(label).argmax() if len(sets) else 0
    todo = np.argsort(-common, kind="stable").tolist()
    while todo:
        later = []
        for x in todo:
            if label[x] == most:
                later.append(x)  # a later merge may make another label the most frequent
                continue
            mine = shingle[own[x] : own[x + 1]]
            met = [holders[a:b] for a, b in zip(starts[mine].tolist(), starts[mine + 1].tolist())]
            shared = np.bincount(np.concatenate(met), minlength=len(sets)) if met else np.zeros(len(sets), dtype=np.int64)
            # shared / (x + y - shared) >= SHARED / UNION
            alike = np.flatnonzero(((SHARED + UNION) * shared >= SHARED * (size + size[x])) & (label != label[x]))
            if len(alike):
                parts, first = np.unique(label[alike], return_index=True)
                found.append(np.column_stack((np.full(len(parts), x), alike[first])))
                label[np.isin(label, parts)] = label[x]
                most = np.bincount(label).argmax()
        todo = [x for x in later if label[x] != most]
    return np.concatenate(found)


def _routed(nodes: DataFrame, plan: Plan, n: int) -> DataFrame:
    """``n`` ``nodes`` (rep long, fp binary, and more) dealt to the shards of all trees: tree, leaf, home and their columns."""
    ship(nodes.sparkSession)
    share = min(1.0, SAMPLE / max(1, n))
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").collect()
    sample = _stack(sorted(bytes(r["fp"]) for r in some), plan)
    levels = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    trees = [_plant(_keys(sample, p), levels, np.random.default_rng(i)) for i, p in enumerate(plan.projections)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _stack(batch.column(1).to_pylist(), plan)
            for i, (tree, projection) in enumerate(zip(trees, plan.projections)):
                for leaf, home, guest in _route(tree, _keys(fps, projection), plan.radius, levels, len(projection)):
                    at = pa.array(np.concatenate((home, guest)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(np.full(len(at), leaf, dtype=np.int64)), pa.array(np.arange(len(at)) < len(home)), *[c.take(at) for c in batch.columns]],
                        ["tree", "leaf", "home", *batch.schema.names],
                    )

    return nodes.mapInArrow(route, "tree int, leaf long, home boolean, " + ", ".join(f"{n} {t}" for n, t in nodes.dtypes))


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) that connect what ``plan`` links among ``nodes`` (rep long, fp binary; one row a fingerprint)."""
    n = nodes.count()
    plan = plan.fitted(n)

    def search(key, shard):
        shard = shard.sort_by([("home", "descending"), ("rep", "ascending"), ("fp", "ascending")])
        rep = shard.column("rep").to_numpy()
        fps = _stack(shard.column("fp").to_pylist(), plan)
        label = forest(fps, int(np.count_nonzero(shard.column("home").to_numpy())), _keys(fps, plan.projections[key[0].as_py()]), plan.limit, plan.radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": rep[linked], "b": rep[label[linked]]})

    return _routed(nodes.select("rep", "fp"), plan, n).groupBy("tree", "leaf").applyInArrow(search, "a long, b long")


def _candidates(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b), a < b, that span what ``plan`` finds near each other among ``nodes`` (rep, fp, size)."""

    def search(key, shard):
        shard = shard.sort_by([("home", "descending"), ("rep", "ascending")])
        rep = shard.column("rep").to_numpy()
        fps = _stack(shard.column("fp").to_pylist(), plan)
        n_home = int(np.count_nonzero(shard.column("home").to_numpy()))
        at = rep[pairs(fps, n_home, _keys(fps, plan.projections[key[0].as_py()]), shard.column("size").to_numpy(), plan.limit, plan.radius)]
        return pa.table({"a": at.min(axis=1), "b": at.max(axis=1)})

    return _routed(nodes.select("rep", "fp", "size"), plan, nodes.count()).groupBy("tree", "leaf").applyInArrow(search, "a long, b long").distinct()


def groups(df: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df``.

    Equal fingerprints are one node, named by their smallest id, so copies cost nothing
    in the search. A null or empty text has fingerprint zero and is linked like any
    other. Rows with a null id belong to the component of their fingerprint, null if no
    row with an id has it. An id that occurs with several texts is one document, and
    repeated rows stay repeated. An empty table gives an empty result.
    """
    marked = saved(fingerprints(df, plan, key, text), "fingerprints")
    nodes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes.where(F.col("rep").isNotNull()), plan).unionByName(_same_id(marked, nodes)))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _same_id(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of one id that occurs with several fingerprints."""
    several = marked.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("doc_id")
    held = marked.join(several, "doc_id", "left_semi").join(nodes, "fp").select("doc_id", "rep").distinct()
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def _signatures(df: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """(key, fp, size, digest) of the shingle set of every row: a repeated shingle counts once."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingles(t, plan.words)) for t in batch.column(1).to_pylist()]
            fps = [_folded(h, plan.bits // 64)[::-1].astype(">u8").tobytes() for h in held]
            digests = [xxhash.xxh3_128_digest(h.tobytes()) for h in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array([len(h) for h in held], pa.int64()), pa.array(digests, pa.binary())], ["key", "fp", "size", "digest"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), "key long, fp binary, size long, digest binary")


def _sets(df: DataFrame, plan: Plan) -> DataFrame:
    """(rep, set) of ``df`` (rep, text)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingles(t, plan.words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], ["rep", "set"])

    return df.select("rep", "text").mapInArrow(tidy(run), "rep long, set array<long>")


def _checked(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of ``found`` (a, b) whose sets are alike."""
    met = found.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    # shared / (x + y - shared) >= SHARED / UNION
    return met.where((SHARED + UNION) * F.size(F.array_intersect("x", "y")) >= SHARED * (F.size("x") + F.size("y"))).select("a", "b")


def _rest(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the parts of a group of candidates; ``parts``: node, root (the group), part, size.

    The nodes outside the largest part of a group are compared with all nodes of the
    group, exactly and block against block, so that a group of any size is spread over
    tasks of bounded memory. What comes out of a block is a spanning forest of its links.
    """
    counted = parts.groupBy("root", "part").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("root").agg(F.max(F.struct("n", -F.col("part"))).alias("m"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("kinds"))
    broken = largest.where("kinds > 1").select("root", "all", (-F.col("m.col2")).alias("main"))
    blocks = lambda w: F.floor(w / BLOCK).cast("int") + 1
    shape = counted.join(broken, "root").groupBy("root").agg(
        F.first("main").alias("main"),
        blocks(F.sum(F.when(F.col("part") == F.col("main"), F.col("weight")).otherwise(0))).alias("n_main"),
        blocks(F.sum(F.when(F.col("part") != F.col("main"), F.col("weight")).otherwise(0))).alias("n_out"),
    )
    shape = saved(shape, "shape")
    placed = parts.join(shape, "root").withColumn("out", F.col("part") != F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("n_out")).otherwise(F.col("n_main"))).cast("int"))
    row = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    # tasks are pairs (x, y): block x of the outer nodes against block y of the outer ones (from x on), or against block y - n_out of the main part
    total = F.col("n_out") + F.col("n_main")
    as_left = F.transform(F.sequence(F.col("block"), total - 1), lambda y: row(F.col("block"), y))
    as_right = F.transform(F.sequence(F.lit(0), F.col("block")), lambda x: row(x, F.col("block")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda x: row(x, F.col("block") + F.col("n_out")))
    tasks = F.when(F.col("out"), F.array_distinct(F.concat(as_left, as_right))).otherwise(as_main)
    dealt = placed.join(sets.withColumnRenamed("rep", "node"), "node").select("root", "node", "part", "set", F.explode(tasks).alias("t"))

    def search(key, shard):
        shard = shard.sort_by("node")
        node = shard.column("node").to_numpy()
        held = shard.column("set").combine_chunks()
        values, ends = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
        at = node[true_links([values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], shard.column("part").to_numpy())]
        return pa.table({"a": at.min(axis=1), "b": at.max(axis=1)})

    return dealt.select("root", "t.x", "t.y", "node", "part", "set").groupBy("root", "x", "y").applyInArrow(search, "a long, b long").distinct()


def _stars(tried: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs (a, b): the node of most pairs in each group of candidates, and every other node of the group."""
    degree = tried.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    centre = reached.join(degree, "node").groupBy("root").agg(F.max(F.struct("n", (-F.col("node")).alias("node"))).alias("m")).select("root", (-F.col("m.node")).alias("a"))
    return reached.join(saved(centre, "centres"), "root").select("a", F.col("node").alias("b")).where("a != b")


def alike(df: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component) for every key of ``df``, once: rows are linked if their shingle sets have a similarity of 0.8 or more.

    ``key`` (long) is not null and names one text. Fingerprints only propose pairs, which
    form groups of candidates: first every text of a group is compared with the one that
    has the most pairs, exactly. Where that leaves a group in several parts, its texts
    are compared exactly until no link between the parts is left out. Null and empty texts have empty sets, which are equal.
    Equal sets are one node, so copies cost nothing in the search.
    """
    spark, since = df.sparkSession, written()
    marked = saved(_signatures(df, plan, key, text), "signatures")
    nodes = saved(marked.groupBy("digest").agg(F.min("key").alias("rep"), F.first("fp").alias("fp"), F.first("size").alias("size")), "nodes")
    tried = saved(_candidates(nodes, plan), "candidates")
    reached = saved(components(tried), "reached")
    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("text")).join(reached.select(F.col("node").alias("rep")), "rep", "left_semi").dropDuplicates(["rep"])
    sets = saved(_sets(texts, plan), "sets")
    held = saved(_checked(_stars(tried, reached), sets), "links")
    parts = reached.join(components(held).select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = saved(parts.join(nodes.select(F.col("rep").alias("node"), "size"), "node"), "parts")
    roots = components(saved(held.unionByName(_rest(parts, sets)), "all-links"))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("component"))
    told = saved(marked.select("key", "digest").distinct().join(named, "digest").select("key", "component"), "alike")
    forget(spark, since, 1)
    return told


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4 words, 64 bits, 4 of them different at most."""
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), Plan.exact())
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
