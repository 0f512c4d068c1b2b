"""Removal of repeated byte strings by suffix arrays.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a
smaller id.  The answer is exact; suffixes meet only where they can share such a string:

1. Anchors.  Every window of ``LENGTH`` bytes has the 20-byte string of smallest hash in it as its
   anchor, so equal windows have equal anchors at the same place.  Around an anchor stands its
   context: the 30 bytes before and behind it, in which all windows with this anchor lie.  Contexts
   are merged in each task first: equal ones keep that of the smallest document, for the others the
   context is a repeat, decided on the spot once their bytes are compared.  What is left goes to blocks
   by the anchor's hash, each of which is a partition; their number grows with the input.
2. Blocks.  Equal contexts are decided again, now among all.  Of the different contexts of an anchor,
   those go on that agree with another one in one of four strings of 41 bytes or more around it, as any
   two that share a window do.
3. Suffix arrays.  Their texts are fetched and gathered by anchor; a suffix array by two-stage sorting
   and adjacent common prefixes give the equal windows of each block, and the smallest document of each.
4. The removed runs of each document are united and its other bytes hashed.

A hot anchor (a line that a large share of all documents has) would gather in one block.  Anchors that
a hash-chosen share of the documents shows to be frequent are therefore dealt by the hash of each whole
window around them, merged in each task; this changes where windows meet, never whether they do.

Between tasks, contexts are equal if their own 64-bit hash and their anchor's (its block and 32 bits more)
are; the text isn't there.  Everything else compares bytes.

Cases: null and empty texts lose nothing; so do rows without doc_id, which nobody is compared with;
rows that share a doc_id are one document to others and don't shorten each other; an empty table
gives an empty result; other columns are not read; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common
from cuboid.llm.suffix_array import common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 20
_SPAN = LENGTH - ANCHOR  # windows around an anchor, less one
#: Strings around an anchor, from and to which place beside its start.  Contexts that share a window
#: agree before the anchor in n and behind it in 30 - n bytes at least, and so in one of these.
_AROUND = ((0, 41), (-10, 31), (-20, 21), (-30, 20))
_STEP, _CHUNK, _BLOCK = 1 << 20, 8 << 20, 12 << 20
#: Anchors that this many documents or more are expected to have are dealt by window; one in HOT_SHARE documents is asked.
#: More documents are needed in a large table, so that at most some HOT_MOST anchors are frequent.
HOT, HOT_SHARE, HOT_MOST = 20_000, 16, 200_000
#: Bytes of contexts that one suffix array sorts at most, a single anchor's apart.
_SORTED = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of the base and of its inverse."""
    if not _tables:
        n = _STEP + 8 * LENGTH
        _tables["byte"] = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64)
        _tables["up"] = np.cumprod(np.full(n, _BASE, np.uint64))
        _tables["down"] = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return _tables["byte"], _tables["up"], _tables["down"]


class _Hashes:
    """Hashes of any strings of a text, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        byte, up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or largest) of each window, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """For parts of a text: (hash, start of the context, its length, hash of the context, short hashes of strings around), by anchor.

    Hashes of strings that aren't whole in the text are 0.  A context's hash says where in it its anchor stands.
    """
    data, n = np.frombuffer(text, np.uint8), len(text)
    margin = 2 * LENGTH
    for first in range(0, n - LENGTH + 1, _STEP):
        last = min(first + _STEP, n - LENGTH + 1)  # windows that start here
        low, high = max(0, first - margin), min(n, last + LENGTH + margin)
        hashes = _Hashes(data[low:high])
        keys = hashes.every(ANCHOR)
        part = keys[first - low : last - low + _SPAN]
        least = _sliding(part, _SPAN + 1, np.minimum)
        # A place is an anchor if it is the least of any window that holds it.
        pad = np.zeros(_SPAN, np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), _SPAN + 1, np.maximum)
        at = np.flatnonzero(best == part) + first - low
        start, end = np.maximum(at - _SPAN, -low), np.minimum(at + ANCHOR + _SPAN, n - low)
        start = np.maximum(start, 0)
        context = hashes.at(start, end) ^ _mix((at - start).astype(np.uint64) * np.uint64(LENGTH * 4) + (end - start).astype(np.uint64))
        around = np.zeros((len(at), len(_AROUND)), np.uint16)
        for j, (a, b) in enumerate(_AROUND):
            whole = np.flatnonzero((at + a >= -low) & (at + b <= n - low))
            place = at[whole]
            around[whole, j] = np.maximum(hashes.at(place + a, place + b) >> np.uint64(52), np.uint64(1))
        yield keys[at], start + low, end - start, context, around


def _windows(text: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of all windows in the given contexts of a text, each once."""
    at = np.unique(np.concatenate([np.arange(a, a + n - LENGTH + 1) for a, n in zip(start.tolist(), length.tolist())]))
    out = []
    data = np.frombuffer(text, np.uint8)
    for low in range(0, len(text), _STEP):
        own = at[(at >= low) & (at < low + _STEP)]
        if len(own):
            out.append(_Hashes(data[low : low + _STEP + LENGTH]).at(own - low, own - low + LENGTH))
    return np.concatenate(out), at


# --- rows of an exchange ---------------------------------------------------------------------------

#: An occurrence: its group's hash, that of what must be equal, short hashes of strings around, document (a row of a table), place and length.
_ROW = np.dtype([("group", "<u4"), ("same", "<u8"), *((f"around{j}", "<u2") for j in range(len(_AROUND))), ("doc", "<u4"), ("start", "<u4"), ("length", "u1")])
#: In ``length``, of a window that stands for itself.
_WHOLE = 128
_ALL = {"bucket": pa.int32(), "ids": pa.binary(), "keys": pa.binary(), "rows": pa.binary(), "doc_id": pa.int64(), "key": pa.int64(), "spans": pa.binary(), "group": pa.int64(), "start": pa.int64(), "length": pa.int32(), "starts": pa.binary(), "context": pa.binary()}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _schema(names: str) -> str:
    return ", ".join(f"{n} {_SQL[_ALL[n]]}" for n in names.split())


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, _ALL[n]) for c, n in zip(cols, names.split())], names.split())


def _packed(rows: np.ndarray) -> bytes:
    """Column by column, the sorted group as differences, and compressed."""
    parts = [np.diff(rows["group"], prepend=np.uint32(0)) if n == "group" else rows[n] for n in _ROW.names]
    planes = [np.ascontiguousarray(p).view(np.uint8).reshape(len(rows), -1).T.tobytes() for p in parts]
    return pa.compress(b"".join(planes), "zstd", asbytes=True) + len(rows).to_bytes(4, "little")


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    planes = np.frombuffer(pa.decompress(data[:-4], n * _ROW.itemsize, "zstd"), np.uint8)
    out, at = np.zeros(n, _ROW), 0
    for name in _ROW.names:
        kind = _ROW[name]
        column = np.ascontiguousarray(planes[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind)[:, 0]
        out[name] = np.cumsum(column, dtype=np.uint32) if name == "group" else column
        at += n * kind.itemsize
    return out


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as its maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > reach[:-1])
    return start[first], reach[np.append(first[1:], True)]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """(doc_id, key, intervals) rows: one for each document."""
    if not len(doc):
        return []
    # One number line with a stretch for each document unites all at once.
    base = doc.astype(np.int64) << 33
    first, last = united(base + start, base + end)
    own = first >> 33
    runs = np.column_stack([first - (own << 33), last - (own << 33)]).astype("<u4")
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    data = runs.tobytes()
    return [(i, k, data[8 * a : 8 * b]) for i, k, a, b in zip(ids[own[cuts[:-1]]].tolist(), keys[own[cuts[:-1]]].tolist(), cuts, cuts[1:])]


# --- stages ----------------------------------------------------------------------------------------

_FIRST = "bucket ids keys rows doc_id key spans"


def _find(buckets: int, hot: np.ndarray):
    """Stage 1: occurrences by block, and what is decided within the task."""

    def flush(docs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        least: dict[bytes, int] = {}
        for doc_id, _, text in docs:
            least[text] = min(doc_id, least.get(text, doc_id))
        out, parts, table, kept_texts = [], [], [], []
        seen: set[tuple[int, int]] = set()
        for doc_id, key, text in docs:
            if (doc_id, key) in seen:
                continue
            seen.add((doc_id, key))
            if least[text] < doc_id:
                out.append((doc_id % buckets, None, None, None, doc_id, key, np.array([0, len(text)], "<u4").tobytes()))
                continue
            doc = len(table)
            table.append((doc_id, key))
            kept_texts.append(text)
            for group, start, length, same, around in anchors(text):
                frequent = np.isin(group, hot) if len(hot) else np.zeros(len(group), bool)
                kept = ~frequent
                parts.append((group[kept], same[kept], around[kept], np.full(int(kept.sum()), doc), start[kept], length[kept]))
                if frequent.any():
                    whole, at = _windows(text, start[frequent], length[frequent])
                    parts.append((whole, whole, np.zeros((len(at), len(_AROUND)), np.uint16), np.full(len(at), doc), at, np.full(len(at), LENGTH | _WHOLE)))
        if parts:
            group, same, around, doc, start, length = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            ids, keys = (np.array(c, np.int64) for c in zip(*table))
            size = length & (_WHOLE - 1)
            least_of, which = _least(group, same, ids[doc])
            repeat = ids[doc] > least_of
            if len(wrong := _unlike(kept_texts, doc, start, size, np.flatnonzero(repeat), which)):
                for i in wrong.tolist():
                    same[i] = xxhash.xxh64_intdigest(kept_texts[doc[i]][start[i] : start[i] + size[i]])
                least_of, _ = _least(group, same, ids[doc])
                repeat = ids[doc] > least_of
            decided = _spans(doc[repeat], start[repeat], (start + size)[repeat], ids, keys)
            out += [(x[0] % buckets, None, None, None, *x) for x in decided]
            keep = np.flatnonzero(~repeat)
            group = _mix(group[keep])
            bucket = ((group >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            rows = np.zeros(len(keep), _ROW)
            rows["group"], rows["same"] = group.astype(np.uint32), same[keep]
            for j in range(len(_AROUND)):
                rows[f"around{j}"] = around[keep, j]
            rows["doc"], rows["start"], rows["length"] = doc[keep], start[keep], length[keep]
            order = np.lexsort((rows["group"], bucket))
            rows, bucket = rows[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)) if buckets < len(bucket) else np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if b > a:
                    own = rows[a:b].copy()
                    present, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    out.append((int(bucket[a]), ids[present].tobytes(), keys[present].tobytes(), _packed(own), None, None, None))
        return _batch(_FIRST, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for batch in batches:
            for doc_id, key, text in zip(*batch.columns):
                docs.append((doc_id.as_py(), key.as_py(), text.as_py()))
                size += len(docs[-1][2])
                if size >= _CHUNK:
                    yield flush(docs)
                    docs, size = [], 0
        if docs:
            yield flush(docs)

    return run


def _least(group: np.ndarray, same: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest document among those that are equal in both hashes, and the row that it has there."""
    order = np.argsort(same, kind="stable")
    twin = same[order[1:]] == same[order[:-1]]
    if (twin & (group[order[1:]] != group[order[:-1]])).any():  # one hash isn't enough
        order = np.lexsort((group, same))
        twin = same[order[1:]] == same[order[:-1]]
    out, which = np.empty(len(same), np.int64), np.empty(len(same), np.int64)
    if len(same):
        starts = np.flatnonzero(np.append(True, ~(twin & (group[order[1:]] == group[order[:-1]]))))
        sizes = np.diff(np.append(starts, len(same)))
        least = np.repeat(np.minimum.reduceat(ids[order], starts), sizes)
        # The first row of the smallest document stands for its equals.
        place = np.where(ids[order] == least, np.arange(len(order)), len(order))
        out[order], which[order] = least, order[np.repeat(np.minimum.reduceat(place, starts), sizes)]
    return out, which


def _unlike(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those of the rows whose bytes differ from the row that stands for them."""
    first = np.cumsum([0, *map(len, texts)])
    data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts) + bytes(8), np.uint8), 8)
    a, b = (first[doc[x]] + start[x] for x in (rows, which[rows]))
    good = size[rows] == size[which[rows]]
    for k in range(0, int(size.max(initial=0)), 8):
        open_ = np.flatnonzero(good & (size[rows] > k))
        if not len(open_):
            break
        at = np.minimum(k, size[rows[open_]] - 8)  # contexts have more than 8 bytes: the last word overlaps
        good[open_] = (data[a[open_] + at] == data[b[open_] + at]).all(axis=1)
    return rows[~good]


_SECOND = "doc_id key spans bucket group length starts"


def _decide(bucket: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
    """Stage 2: a whole block; rows with intervals, old and new, and rows of contexts whose texts must be compared."""
    known = held.filter(pc.is_valid(held["spans"]))
    if known.num_rows:
        for part in known.select(["doc_id", "key", "spans"]).to_batches():
            yield _asked(part.columns, bucket)
    blobs = [tuple(x.values()) for x in held.filter(pc.is_valid(held["rows"])).select(["ids", "keys", "rows"]).to_pylist()]
    if not blobs:
        return
    ids = np.concatenate([np.frombuffer(x, np.int64) for x, _, _ in blobs])
    keys = np.concatenate([np.frombuffer(x, np.int64) for _, x, _ in blobs])
    parts, base = [], 0
    for own, _, rows in blobs:
        part = _unpacked(rows)
        part["doc"] += base
        base += len(own) // 8
        parts.append(part)
    rows = np.concatenate(parts)
    del parts
    # Only groups with more than one row matter.
    order = np.argsort(rows["group"], kind="stable")
    group = rows["group"][order]
    twin = np.append(False, group[1:] == group[:-1])
    twin |= np.append(twin[1:], False)
    rows = rows[order[twin]]
    if not len(rows):
        return
    doc_id = ids[rows["doc"]]
    least, _ = _least(rows["group"], rows["same"], doc_id)
    size = (rows["length"] & (_WHOLE - 1)).astype(np.int64)
    repeat = doc_id > least
    start = rows["start"].astype(np.int64)
    if spans := _spans(rows["doc"][repeat], start[repeat], (start + size)[repeat], ids, keys):
        yield _asked([pa.array(c, _ALL[n]) for c, n in zip(zip(*spans), ("doc_id", "key", "spans"))], bucket)
    # Different contexts, each once; the document that has one first may have it at several places.
    own = np.flatnonzero(~repeat & (rows["length"] < _WHOLE))
    if len(own):
        _, which = _least(rows["group"][own], rows["same"][own], np.zeros(len(own), np.int64))
        first, which = np.unique(which, return_inverse=True)
    else:
        first, which = own, own
    rest = own[first]
    need = np.zeros(len(rest), bool)
    for j in range(len(_AROUND)):
        around = rows[f"around{j}"][rest]
        has = np.flatnonzero(around)
        key = rows["group"][rest[has]].astype(np.uint64) << np.uint64(16) | around[has]
        by = np.argsort(key, kind="stable")
        met = np.append(False, key[by][1:] == key[by][:-1])
        met |= np.append(met[1:], False)
        need[has[by[met]]] = True
    own, which = own[need[which]], which[need[which]]
    if len(own):
        # A document that has a context at several places, as periods do, is asked for it once.
        order = np.lexsort((start[own], rows["doc"][own], which))
        own, which = own[order], which[order]
        doc = rows["doc"][own]
        cuts = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (doc[1:] != doc[:-1])))
        places, at = start[own].astype("<u4").tobytes(), [*cuts.tolist(), len(own)]
        starts = [places[4 * a : 4 * b] for a, b in zip(at, at[1:])]
        head, doc = own[cuts], doc[cuts]
        yield _asked([pa.array(ids[doc]), pa.array(keys[doc]), None], bucket, rows["group"][head].astype(np.int64), size[head].astype(np.int32), starts)


def _asked(cols: list, bucket: int, group=None, length=None, starts=None) -> pa.RecordBatch:
    """Rows of the second stage: with intervals, or with what is asked for."""
    n = len(cols[0])
    spans = pa.nulls(n, pa.binary()) if cols[2] is None else cols[2]
    rest = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((group, pa.int64()), (length, pa.int32()), (starts, pa.binary()))]
    return pa.RecordBatch.from_arrays([cols[0], cols[1], spans, pa.array(np.full(n, bucket, np.int32)), *rest], _SECOND.split())


def _by_bucket(fn):
    """Rows come sorted by bucket; ``fn(bucket, rows)`` gives the batches of each whole one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if held and bucket[a] != now:
                    yield from fn(int(now), pa.Table.from_batches(held))
                    held = []
                now = bucket[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(int(now), pa.Table.from_batches(held))

    return run


_THIRD = "bucket group doc_id key starts context"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 3, first half: the texts of the contexts that documents were asked for."""
    for whole in batches:
        for low in range(0, whole.num_rows, 64):
            batch = whole.slice(low, 64)
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            asked = col("asked")
            times = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
            flat = asked.flatten()
            size = flat.field("length").to_numpy(zero_copy_only=False)
            start = np.array([int.from_bytes(x[:4], "little") for x in flat.field("starts").to_pylist()], np.int64)
            found, at = [], 0
            for text, n in zip(col("text"), times.tolist()):
                data = memoryview(text.as_buffer())
                found += [bytes(data[a : a + k]) for a, k in zip(start[at : at + n].tolist(), size[at : at + n].tolist())]
                at += n
            doc_id, key = (pa.array(np.repeat(col(c).to_numpy(zero_copy_only=False), times)) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([flat.field("bucket"), flat.field("group"), doc_id, key, flat.field("starts"), pa.array(found, pa.binary())], _THIRD.split())


def _compare(bucket: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
    """Stage 3, second half: suffix arrays over the contexts of anchors; whole anchors go together."""
    held = held.sort_by("group").combine_chunks()
    group = held["group"].to_numpy()
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    size = np.cumsum(pc.binary_length(held["context"]).to_numpy())
    low = 0
    while low < len(group):
        # As many anchors as fit, one at least.
        fit = np.searchsorted(size[ends - 1], (size[low - 1] if low else 0) + _SORTED, "right") - 1
        high = int(ends[max(fit, np.searchsorted(ends, low, "right"))])
        part = held.slice(low, high - low)
        rows = _repeats(*(part[c].to_numpy() for c in ("doc_id", "key")), *(part[c].to_pylist() for c in ("starts", "context")))
        yield _batch("doc_id key spans", rows)
        low = high


def _repeats(ids: np.ndarray, keys: np.ndarray, starts: list[bytes], texts: list[bytes]) -> list[tuple]:
    """Intervals of windows that stand in the context of a smaller document, too, at all places of their own context."""
    order, words, left = suffix_array(texts, LENGTH)
    same = common_prefixes(order, words, left, LENGTH)
    run = np.cumsum(~same)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    many = same.copy()
    many[:-1] |= same[1:]
    order, run = order[many], run[many]
    if not len(order):
        return []
    owner = np.repeat(np.arange(len(texts)), sizes)[order]
    firsts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    least = np.repeat(np.minimum.reduceat(ids[owner], firsts), np.diff(np.append(firsts, len(run))))
    gone = ids[owner] > least
    order, owner = order[gone], owner[gone]
    if not len(order):
        return []
    base = owner << 33
    at = base + order - (np.cumsum(sizes) - sizes)[owner]
    first, last = united(at, at + LENGTH)
    owner = first >> 33
    # Each interval of a context stands at each of its places.
    times = np.array([len(x) // 4 for x in starts], np.int64)
    places = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
    n = times[owner]
    which = np.repeat(np.arange(len(owner)), n)
    place = places[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(times) - times)[owner[which]]]
    shift = place - (owner << 33)[which]
    _, some, doc = np.unique(np.column_stack([ids, keys]), axis=0, return_index=True, return_inverse=True)
    return _spans(doc.ravel()[owner[which]], first[which] + shift, last[which] + shift, ids[some], keys[some])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 4, first half: the maximal runs of each document."""
    for batch in batches:
        rows = []
        for doc_id, key, spans in zip(*batch.columns):
            runs = np.concatenate([np.frombuffer(x, "<u4") for x in spans.as_py()]).astype(np.int64).reshape(-1, 2)
            start, end = united(runs[:, 0], runs[:, 1])
            rows.append((doc_id.as_py(), key.as_py(), int((end - start).sum()), len(start), np.column_stack([start, end]).astype("<u4").tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()])], ["doc_id", "key", "n_removed", "n_spans", "runs"])


def _hash_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 4, second half: the digest of what the runs leave of a text."""
    for batch in batches:
        rows = []
        for doc_id, text, n_removed, n_spans, runs in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "n_removed", "n_spans", "runs"))):
            data, digest, at = memoryview(text.as_buffer()), hashlib.sha256(), 0
            for a, b in np.frombuffer(runs.as_py(), "<u4").reshape(-1, 2).tolist():
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            rows.append((doc_id.as_py(), len(data), n_removed.as_py(), n_spans.as_py(), digest.hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])], _RESULT)


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _joined(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts joined with the documents that ``wanted`` has, by doc_id and key.

    Few texts are exchanged: those whose key falls in a bin that is wanted.  There are ``_BINS`` bins,
    which bounds what is broadcast; where all are wanted, all texts are exchanged.
    """
    bins = wanted.select(F.pmod("key", F.lit(_BINS)).alias("bin")).distinct()
    few = rows.withColumn("bin", F.pmod("key", F.lit(_BINS))).join(F.broadcast(bins), "bin", "left_semi").drop("bin")
    return few.join(wanted, ["doc_id", "key"])


_BINS = 1 << 19


def _frequent(rows: DataFrame, hot: int, share: int) -> np.ndarray:
    """Anchors that ``hot`` documents or more are expected to have, from one in ``share`` documents; at most some HOT_MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for x in batch.column(2):
                found = [part[0] for part in anchors(x.as_py())]
                if found:
                    held.append(np.unique(np.concatenate(found)))
        if held:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            # What is frequent among all is so in some task.
            least = max(2, int(hot / share * len(held) / total / 2))
            value, n = value[n >= least], n[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n, pa.int64())], ["anchor", "n"])

    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(share)) == 0)
    total, size = some.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    total, hot = max(1, total), max(hot, (size or 0) * share // 16 // HOT_MOST)  # a text has an anchor for each 16 bytes or so
    if total * share < hot:
        return np.zeros(0, np.uint64)
    found = some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= hot // share).select("anchor").toArrow()
    return np.sort(found["anchor"].to_numpy().astype(np.uint64))


def removed_spans(rows: DataFrame, hot: int = HOT, share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, key, spans): intervals to remove, in one or more rows for a document.  ``rows``: doc_id, key, text, without nulls."""
    spark = rows.sparkSession
    long_ = rows.where(F.octet_length("text") >= LENGTH)
    total = long_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // _BLOCK))
    found = long_.select("doc_id", "key", "text").mapInArrow(_find(buckets, _frequent(rows, hot, share)), _schema(_FIRST))
    blocks = found.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    # Written once: both kinds of rows are read from it.
    second = common.written(blocks.mapInArrow(_by_bucket(_decide), _schema(_SECOND)), "blocks")
    asked = second.where("spans IS NULL").groupBy("doc_id", "key").agg(F.collect_list(F.struct("bucket", "group", "length", "starts")).alias("asked"))
    fetched = _joined(long_, common.written(asked, "asked")).mapInArrow(_contexts, _schema(_THIRD))
    gathered = fetched.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    third = gathered.mapInArrow(_by_bucket(_compare), _schema("doc_id key spans"))
    return second.where("spans IS NOT NULL").select("doc_id", "key", "spans").union(third)


def deduplicated(docs: DataFrame, hot: int = HOT, share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each document."""
    rows = common.texts(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    spans = removed_spans(rows.where("doc_id IS NOT NULL"), hot, share)
    runs = spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans")).mapInArrow(_unite, "doc_id long, key long, n_removed long, n_spans long, runs binary")
    narrow = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    known = common.written(narrow.join(runs, ["doc_id", "key"], "left"), "runs")
    partly = F.coalesce(F.col("n_removed") < F.col("n_bytes"), F.lit(False))
    wanted = known.where(partly).select("doc_id", "key", "n_removed", "n_spans", "runs").dropDuplicates(["doc_id", "key"])
    rest = _joined(rows, wanted).mapInArrow(_hash_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    # Nothing or all of these goes.
    kept = F.when(F.col("n_removed").isNull(), F.col("kept_sha256")).otherwise(F.lit(hashlib.sha256().hexdigest()))
    whole = known.where(~partly).select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), kept.alias("kept_sha256"))
    return whole.union(rest)


def op4_suffix(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"))
