"""SimHash near duplicates by covering locality-sensitive hashing.

Fingerprints: every whole text, 64 bits over the hashes of its four-word shingles.
Linking: 2**(radius+1)-1 masks made from a map of the 64 bit positions into GF(2)**(radius+1).  The
positions in which two fingerprints differ span at most ``radius`` dimensions when they are at most
``radius``, so some non-zero vector is orthogonal to all of them and its mask keeps none of them: the
two collide in that mask's table, always.

Copies are merged before anything is exchanged (one row for each fingerprint); the rows for all masks are
exchanged once.  A bucket gives a spanning forest of its links, never its pairs.  Buckets beyond
``BUCKET`` are never gathered: two words differ in at most r bits if and only if some word is within r/2
of both, so their members meet in aggregated keys of that smaller radius, which needs no comparison and
stays linear in the bucket.  Buckets that a hash-chosen share of the fingerprints shows to be very large go
that way at once, so none of them is sent to one task.

Cases: null and empty texts have fingerprint zero, linked like any other; a row without doc_id gets
the component of its fingerprint, for which ids that are null don't count; repeated rows stay
repeated; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common
from cuboid.llm.components import components, named, spread_join

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket that one task compares at once; larger buckets go another, exact way.
BUCKET = 1024
#: One in SHARE fingerprints is asked for large buckets; those of more than one in LARGE of all aren't exchanged by their key.
SHARE, LARGE = 16, 4096
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit j is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(ends) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _BLOCK):
        counts += _bits_set(np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], np.uint64))
    return _majority(counts, len(starts))


def fingerprint_of(hashed: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already; zero if there are none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), _BLOCK):
        counts += _bits_set(hashed[at : at + _BLOCK])
    return _majority(counts, len(hashed))


def _bits_set(hashed: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int32)


def _majority(counts: np.ndarray, n: int) -> int:
    return sum(1 << j for j in np.flatnonzero(2 * counts > n).tolist())


def masks(radius: int = RADIUS, seed: int = 0x5EED) -> list[int]:
    """The covering code's masks, as signed 64-bit numbers; the map of the positions is balanced and fixed by the seed."""
    size = 1 << (radius + 1)
    images = np.random.default_rng(seed).permutation(np.arange(BITS) % (size - 1) + 1)
    out = []
    for v in range(1, size):
        kept = [j for j in range(BITS) if bin(int(images[j]) & v).count("1") % 2]
        out.append(_signed(sum(1 << j for j in kept)))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [_signed(fingerprint(t.as_py() or b"")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""
    return common.texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values, by search from each of them in turn."""
    rest, out = values, []
    while len(rest) > 1:
        seen, rest = [rest[0]], rest[1:]
        while seen and len(rest):
            x = seen.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(x, y) for y in found]
                seen += list(found)
                rest = rest[~near]
    return out


def _bucket_links(radius: int, bucket: int):
    names = ["t", "key", "a", "b"]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def hot(rows: np.ndarray) -> pa.RecordBatch:
        return batch(rows[:, 0], rows[:, 1], rows[:, 2], pa.nulls(len(rows), pa.int64()))

    def whole(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole buckets, which begin at the cuts; members of those that are too large."""
        sizes = np.diff(np.append(cuts, len(rows)))
        two = cuts[sizes == 2]
        x, y = rows[two, 2], rows[two + 1, 2]
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
        links = [np.column_stack([x[near], y[near]])]
        for a, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n > bucket:
                yield hot(rows[a : a + n])
            elif pairs := forest(rows[a : a + n, 2].view(np.uint64), radius):
                links.append(np.array(pairs, np.uint64).view(np.int64))
        found = np.concatenate(links)
        if len(found):
            none = pa.nulls(len(found), pa.int64())
            yield batch(none, none, found[:, 0], found[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key; a bucket may go on in the next batch, and is passed on once it is too large."""
        held, passed = np.empty((0, 3), np.int64), None
        for new in batches:
            rows = np.column_stack([new.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if passed is not None:
                n = int(np.argmin(np.append((rows[:, :2] == passed).all(axis=1), False)))
                if n:
                    yield hot(rows[:n])
                if n == len(rows):
                    continue
                rows, passed = rows[n:], None
            rows = np.concatenate([held, rows]) if len(held) else rows
            if not len(rows):
                continue
            cuts = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            last = int(cuts[-1])
            yield from whole(np.ascontiguousarray(rows[:last]), cuts[:-1])
            held = rows[last:].copy()
            if len(held) > bucket:
                passed = held[0, :2].copy()
                yield hot(held)
                held = held[:0]
        if len(held):
            yield from whole(held, np.zeros(1, np.int64))

    return run


def _dealt(distinct: DataFrame, radius: int) -> DataFrame:
    """(t, key, fp): each fingerprint's key in every mask's table."""
    tables = F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.lit(m).bitwiseAND(F.col("fp")).alias("key")) for i, m in enumerate(masks(radius))))
    return distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")


def _spread(distinct: DataFrame, parts: int) -> DataFrame:
    """Fingerprints in so many partitions, as each row becomes one for every mask: by another hash than the one they come by, an exchange by which Spark would drop."""
    return distinct.select("fp").repartition(parts, F.xxhash64("fp"))


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that join any two fingerprints within the radius, if not directly then through others.

    ``distinct`` has each fingerprint once, in ``fp``.
    """
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = _spread(distinct, parts)
    some = _dealt(spread.where(F.pmod(F.xxhash64(F.lit("large"), "fp"), F.lit(SHARE)) == 0), radius)
    most = max(bucket, distinct.count() // LARGE)
    # At most LARGE for each mask, as every one has more than one in LARGE of the asked.
    large = F.broadcast(common.checkpointed(some.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") * SHARE > most).select("t", "key")))
    rows = _dealt(spread, radius)
    by_key = rows.join(large, ["t", "key"], "left_anti").repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    found = common.checkpointed(by_key.mapInArrow(common.releasing(_bucket_links(radius, bucket)), "t long, key long, a long, b long"))
    hot = rows.join(large, ["t", "key"]).unionByName(found.where("b IS NULL").select("t", "key", F.col("a").alias("fp")))
    return found.where("b IS NOT NULL").select("a", "b").union(_hot_links(common.checkpointed(hot), radius))


def _hot_links(members: DataFrame, radius: int) -> DataFrame:
    """Members of one large bucket agree on its mask, so they can only differ elsewhere: each goes to the words within half the radius there."""
    half = radius // 2
    flips = []
    for i, m in enumerate(masks(radius)):
        free = [j for j in range(BITS) if not (m >> j) & 1]
        flips.append(F.array(*(F.lit(_signed(sum(1 << j for j in c))) for k in range(half + 1) for c in combinations(free, k))))
    keyed = None
    present = [r["t"] for r in members.select("t").distinct().collect()]  # at most one row for each mask
    for t in present:
        part = members.where(F.col("t") == t).select("key", "fp", F.explode(flips[t]).alias("flip"))
        part = part.select(F.lit(t).alias("t"), "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
        keyed = part if keyed is None else keyed.union(part)
    if keyed is None:
        return members.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("1 = 0")
    least = keyed.groupBy("t", "key", "word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["t", "key", "word"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def grouped(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``fps``, which has doc_id and fp, with component_id and n_same: the smallest doc_id that its fingerprint reaches, and the rows that share it."""
    groups = common.checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")).where("fp IS NOT NULL"))
    found = named(groups, components(links(groups.select("fp"), radius, bucket)), "fp", "rep")
    # A fingerprint that many documents have is brought to them.
    return spread_join(fps, found.select("fp", "component_id", "n_same", F.col("n_same").alias("__n")), "fp", "__n", fps.count())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, n_same): one row for each document."""
    return grouped(common.checkpointed(fingerprints(docs)), radius, bucket).select("doc_id", "fp", "component_id", "n_same")


def deduplicated(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their component, by ``found`` if it is given.

    Rows without doc_id stay, as nothing can name one of them; of rows that share a doc_id one stays.
    """
    found = near_duplicates(docs) if found is None else found
    own, times = (f"__{uuid.uuid4().hex}" for _ in range(2))  # beside any columns of the input
    kept = common.checkpointed(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(times)))
    out = docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left").where(F.col("doc_id").isNull() | F.col(own).isNotNull())
    if not kept.where(F.col(times) > 1).isEmpty():
        once = out.where(F.col(times) > 1).dropDuplicates(["doc_id"])
        out = out.where(F.col("doc_id").isNull() | (F.col(times) == 1)).unionByName(once)
    return out.select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
