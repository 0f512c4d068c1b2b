"""Near duplicates by the similarity of five-word shingles: share of common ones of all, at least 0.8.

Candidates: first the groups that ``simhash`` makes of the fingerprints of these sets, by its covering masks:
texts within ``simhash.RADIUS`` bits always meet.  Most pairs at 0.8 differ in more bits; a radius that covers
them would have to be about 17, with 2**18 - 1 tables.  So the rest goes on with ``BANDS`` keys of each text,
each over ``ROWS`` minima of its hashed shingles; two texts at similarity s share none with probability
(1 - s**ROWS)**BANDS: 3 in a million at 0.8, less above.  Buckets of these keys whose members the
fingerprints have linked already are left out.
Linking: members of a group or bucket are compared by their whole sets of 64-bit shingle hashes; no estimate links.

Copies are merged first by a 64-bit hash of their text.  Buckets of the same members are decided once.  A
bucket gives a spanning forest of its links, never its pairs.  Buckets of more than ``HELD`` shingles are
cut into blocks and each pair of blocks is decided by itself, so a task holds two blocks at most; the work
in such a bucket grows with the square of its blocks.

Cases: texts under five words have one shingle, all their words; null, empty and blank texts have none and are
alike; a row without doc_id gets the component of its text, for which ids that are null don't count; repeated
rows stay repeated; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common, simhash
from cuboid.llm.components import components, named, spread_join

SHINGLE, SHARE = 5, 0.8
ROWS, BANDS, SEED = 5, 32, 42
#: Shingles of a bucket that one task compares at once; 8 bytes each.
HELD = 1 << 18
#: Copies with candidates that are broadcast at most, 8 bytes each, to leave the texts of all others where they are.
FEW = 500_000
_BLOCK = 1 << 9
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    k = min(SHINGLE, len(ends))
    starts, stops = (ends - lengths)[: len(ends) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts)))


def keys(found: np.ndarray) -> list[int]:
    """The band keys of a set of shingles, as signed 64-bit numbers."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        np.minimum(least, ((found[at : at + _BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [simhash._signed(xxhash.xxh64_intdigest(rows[i].tobytes(), i)) for i in range(BANDS)]


def forest(sets: list[np.ndarray], share: float = SHARE) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of shingles, by search from each of them in turn."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    owners = owner[np.argsort(codes, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(codes))]) if len(codes) else np.zeros(1, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rest, out = np.arange(len(sets)), []
    while len(rest) > 1:
        seen, rest = [rest[0]], rest[1:]
        while seen and len(rest):
            x = seen.pop()
            own = codes[at[x] : at[x + 1]]
            size = first[own + 1] - first[own]
            places = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            common_ = np.bincount(owners[places], minlength=len(sets))[rest]
            near = common_ * (1 + share) >= share * (sizes[x] + sizes[rest]) - 1e-9
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                seen += list(found)
                rest = rest[~near]
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fps, listed = [], [], []
        for t in batch.column(2):
            found = shingles(t.as_py() or b"")
            n.append(len(found))
            fps.append(simhash._signed(simhash.fingerprint_of(found)))
            listed.append(keys(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(listed, pa.list_(pa.int64()))], ["doc_id", "copy", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets leave in batches of about ``HELD`` shingles."""
    for batch in batches:
        ids, sets, size = [], [], 0
        for i, (copy, text) in enumerate(zip(batch.column(0), batch.column(1)), 1):
            found = shingles(text.as_py() or b"")
            ids.append(copy.as_py())
            sets.append(found.tobytes())
            size += len(found)
            if size >= HELD or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["copy", "shingles"])
                ids, sets, size = [], [], 0


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one may go on in the next batch.  Each copy that is linked goes to the least one of its tree."""
    bucket, ids, sets = None, [], []

    def links():
        root, least = {}, {}
        for x, y in forest(sets) if len(ids) > 1 else []:
            root[y] = top = root.setdefault(x, x)
            least[top] = min(least.get(top, ids[top]), ids[y])
        found = [(ids[i], least[top]) for i, top in root.items() if ids[i] != least[top]]
        return pa.RecordBatch.from_arrays([pa.array([p[side] for p in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for i, name in enumerate(names):
            if name != bucket:
                yield links()
                bucket, ids, sets = name, [], []
            ids.append(batch.column(3)[i].as_py())
            sets.append(np.frombuffer(batch.column(4)[i].as_py(), np.uint64))
    yield links()


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, text): the text as bytes, and a hash that its copies share."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return common.texts(docs).select("doc_id", F.xxhash64(text).alias("copy"), text.alias("text"))


def _buckets(rows: DataFrame, *more: Column) -> DataFrame:
    """Buckets of two copies and more, with what tells whether their members are the same."""
    own = [F.count("*").alias("m"), F.sum("n").alias("total"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.bit_xor(F.xxhash64("copy")).alias("x")]
    return rows.groupBy("key").agg(*own, *more).where("m > 1")


def _compared(docs: DataFrame, rows: DataFrame, buckets: DataFrame, total: int, held: int) -> DataFrame:
    """(a, b) links among the copies of each bucket, by their whole sets; ``total`` is the number of ``rows``."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = buckets.groupBy("m", "total", "a", "b", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / held).cast("int").alias("blocks"), "m")
    members = common.checkpointed(spread_join(rows, common.checkpointed(once), "key", "m", total).select("key", "blocks", "copy"))
    own = F.pmod(F.xxhash64("copy", F.lit("block")), F.greatest("blocks", F.lit(1))).cast("int")
    dealt = members.select("key", "copy", own.alias("own"), F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "copy")
    wanted = common.checkpointed(members.select("copy").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = _copies(docs).join(wanted, "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(common.releasing(_sets), "copy long, shingles binary")
    whole = dealt.join(sets, "copy").select("key", "i", "j", "copy", "shingles").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return whole.mapInArrow(common.releasing(_bucket_links), "a long, b long").distinct()


def links(docs: DataFrame, signed: DataFrame, held: int = HELD) -> DataFrame:
    """(a, b) links of copies that join any two texts within the similarity, if not directly then through others."""
    distinct = common.written(signed.groupBy("copy").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "copies")
    total = distinct.count()
    fps = common.checkpointed(distinct.select(F.col("copy").alias("doc_id"), "fp", "n"))
    near = common.checkpointed(simhash.grouped(fps).select(F.col("component_id").alias("key"), F.col("doc_id").alias("copy"), "n"))
    linked = common.checkpointed(_compared(docs, near, _buckets(near), total, held))
    # Copies of one root are linked; one may have another root too, from other blocks, which only leaves more to compare.
    roots = linked.groupBy(F.col("a").alias("copy")).agg(F.min("b").alias("root"))
    rows = distinct.select(F.explode("keys").alias("key"), "copy", "n")
    rooted = distinct.join(roots, "copy", "left").select(F.explode("keys").alias("key"), "copy", "n", F.coalesce("root", "copy").alias("root"))
    apart = _buckets(rooted, F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    rest = _compared(docs, rows, apart, BANDS * total, held)
    common.discard(distinct)  # the members of all buckets are on their own
    return linked.union(rest)


def near_duplicates(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, component_id): one row for each document."""
    signed = common.written(_copies(docs).mapInArrow(common.releasing(_keyed), "doc_id long, copy long, n long, fp long, keys array<long>"), "signed")
    copies = common.checkpointed(signed.select("doc_id", "copy"))
    linked = links(docs, signed, held)
    common.discard(signed)
    groups = common.checkpointed(copies.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = named(groups, components(linked), "copy", "rep")
    return spread_join(copies, found.select("copy", "component_id", "n"), "copy", "n", copies.count()).select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their component, as ``simhash.deduplicated`` says."""
    return simhash.deduplicated(docs, near_duplicates(docs))
