"""Benchmark decontamination: a BM25 index of the test items, asked with every passage of every text.

Weights of an item are divided by the least score that a passage can have which holds the wanted
share of its five-word shingles; the threshold of every item is then 1 and loses none of them.
Block-max WAND, for many passages side by side: the terms of a passage are ordered by the largest weight
that any item has for them.  Those before the pivot, where the sum of these first reaches the threshold,
can't lift an item to it by themselves, so only the posting lists from the pivot on are opened; a passage
whose sum doesn't reach it opens none.  What these lists reach are blocks of items, whose largest weights by
term bound all their items' scores: first with the pivot's sum for the terms before it, then with what the
block has of them; only blocks that still reach the threshold are scored.  What is retrieved is verified
by the share of the item's shingles in the passage, and by nothing else; the overlap by words with its
question and its answer is reported (of an entry of a long item: of the part of each that is in it).

Passages are windows of twice the longest entry, each half a window further, so that every entry that
stands in a text stands whole in a window.  Then the whole text is one more passage, for entries whose
parts are moved further apart, by any insertion.  Items longer than ``LONGEST`` words are indexed in
entries of at most that many shingles, each shingle in one, so one of them has the share that the item has.
The items go to the executors in parts of at most ``PART_BYTES``, one part for each pass over the texts, so a
larger benchmark means more passes and no larger tasks.  No exchange: each row is decided by itself.

Cases: null and empty texts and items match nothing; repeated rows are decided each; ties are all
returned; an empty benchmark flags nothing; other columns are kept by ``uncontaminated`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.llm import common

SHINGLE, SHARE = 5, 0.8
LONGEST, BLOCK_ITEMS, PART_BYTES = 128, 16, 32 << 20
K1, B = 1.2, 0.75
_LETTERS = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 64 < c < 91 else c for c in range(256))
_WINDOWS = 256
#: Sums of (window, block) pairs that are kept densely; beyond, only those that a list reaches.
_DENSE = 1 << 18
#: (term, block) pairs that are looked up directly; in a larger index they are searched.
_DIRECT = 1 << 22
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Lower-case words of digits, letters and what is beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def _boundary(text: str, n: int) -> int:
    """Words of the question: up to the last sentence end that leaves both parts a shingle, else half."""
    least, best = min(SHINGLE, n // 2), n // 2
    for at, ch in enumerate(text):
        if ch in ".?!\n":
            k = len(words(text[: at + 1]))
            if least <= k <= n - least:
                best = k
    return best


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each place on."""
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ ids[j : j + len(out)].astype(np.uint64)) * _TIMES
        out ^= out >> np.uint64(32)
    return out


class Passage:
    """Words of a passage, and its shingles sorted by their hash."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self._sorted: dict[int, tuple] = {}

    def places(self, terms: np.ndarray, k: int) -> np.ndarray:
        """Where each shingle of ``terms`` stands first, or -1."""
        if k not in self._sorted:
            codes = _codes(self.ids, k)
            order = np.argsort(codes, kind="stable")
            self._sorted[k] = codes[order], order
        codes, order = self._sorted[k]
        place = order[np.minimum(np.searchsorted(codes, _codes(terms, k)), len(order) - 1)]
        rows = np.lib.stride_tricks.sliding_window_view
        return np.where((rows(self.ids, k)[place] == rows(terms, k)).all(axis=1), place, -1)


class Index:
    """Postings of the entries as term-by-entry weights in blocks of entries."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.entries: list[tuple] = []  # item, term ids, words of the question in it
        vocabulary: dict[bytes, int] = {}
        for item, text in items:
            listed = words(text or "")
            cut = _boundary(text, len(listed)) if listed else 0
            pieces = max(1, -(-len(listed) // LONGEST)) if listed else 0
            shingles = max(1, len(listed) - SHINGLE + 1)
            size = -(-shingles // pieces) if pieces else 0
            for at in range(0, shingles if listed else 0, size or 1):
                part = listed[at : at + size + SHINGLE - 1]
                asked = min(max(cut - at, 0), len(part))
                self.entries.append((item, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in part]), asked))
        self.vocabulary = vocabulary
        self.top = np.zeros(0)
        self.longest = max((len(t) for _, t, _ in self.entries), default=1)
        self._weigh()

    def _weigh(self) -> None:
        n, size = len(self.entries), len(self.vocabulary)
        df = np.zeros(size)
        lengths = np.array([len(t) for _, t, _ in self.entries], float)
        for _, terms, _ in self.entries:
            df[np.unique(terms)] += 1
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.n_blocks = -(-n // BLOCK_ITEMS)
        rows, cols, weights = [], [], []
        for e, (_, terms, _) in enumerate(self.entries):
            own, tf = np.unique(terms, return_counts=True)
            w = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[e] / lengths.mean()))
            shingles = max(1, len(terms) - SHINGLE + 1)
            # At most so many words stand outside the shingles that are there: they may be the heaviest.
            absent = min(len(own) - 1, shingles - int(np.ceil(SHARE * shingles)))
            least = w.sum() - np.sort(w)[len(w) - absent :].sum()
            rows.append(own)
            cols.append(np.full(len(own), e))
            weights.append(w / least)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.cols = np.concatenate(cols) if cols else np.zeros(0, np.int64)
        self.weights = np.concatenate(weights) if weights else np.zeros(0)
        # Terms are numbered by their largest weight, so that sorted terms of a passage are in the pivot's order.
        top = np.zeros(size)
        np.maximum.at(top, self.rows, self.weights)
        inorder = np.argsort(top, kind="stable")
        number = np.empty(size, np.int64)
        number[inorder] = np.arange(size)
        self.top, self.rows = top[inorder], number[self.rows]
        self.entries = [(item, number[terms], asked) for item, terms, asked in self.entries]
        self.vocabulary = {w: int(number[i]) for w, i in self.vocabulary.items()}
        order = np.lexsort((self.cols, self.rows))
        self.rows, self.cols, self.weights = self.rows[order], self.cols[order], self.weights[order]
        # Block maxima by term, as postings of blocks.
        block = self.cols // BLOCK_ITEMS
        key = self.rows * max(1, self.n_blocks) + block
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_of, self.block_max = block[starts], np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.term_first = np.searchsorted(self.rows[starts], np.arange(size + 1))
        self.group_key, self.group_start = key[starts], np.append(starts, len(key))
        self.place = None
        if size * self.n_blocks <= _DIRECT:
            self.place = np.full(size * self.n_blocks, -1, np.int32)
            self.place[self.group_key] = np.arange(len(starts))

    def candidates(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """(window, block) pairs whose bound reaches the threshold; each (window, term) comes once, in their order."""
        upto = np.cumsum(self.top[term])
        first = np.cumsum(np.bincount(window + 1, minlength=n + 1))
        upto -= np.append(0.0, upto)[first[:n]][window]
        pivot = upto >= 1 - 1e-9  # from here on in each window, as the sums rise
        if not pivot.any():
            return np.zeros((0, 2), np.int64)
        # What the terms before the pivot can add at most: the sum at the last of them.
        light, last = np.zeros(n), np.flatnonzero(~pivot & np.append(pivot[1:] | (window[1:] != window[:-1]), True))
        light[window[last]] = upto[last]
        at, size = self._postings(term[pivot])
        key = np.repeat(window[pivot], size) * self.n_blocks + self.block_of[at]
        if n * self.n_blocks <= _DENSE:
            sums = np.bincount(key, self.block_max[at], minlength=n * self.n_blocks)
            key = np.flatnonzero(sums.reshape(n, -1) + light[:, None] >= 1 - 1e-9)
            bound = sums[key]
        else:
            key, pair = np.unique(key, return_inverse=True)
            bound = np.bincount(pair, self.block_max[at], minlength=len(key))
        own, block = np.divmod(key, max(1, self.n_blocks))
        near = bound + light[own] >= 1 - 1e-9
        own, block, bound = own[near], block[near], bound[near]
        # The terms before the pivot, looked up in the blocks that are left.
        some = np.flatnonzero(~pivot)
        first = np.cumsum(np.bincount(window[some] + 1, minlength=n + 1))
        low, high = first[own], first[own + 1]
        which = np.repeat(np.arange(len(own)), high - low)
        terms = term[some][np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(which))]
        g = self._groups(terms * self.n_blocks + block[which])
        met = g >= 0
        bound += np.bincount(which[met], self.block_max[g[met]], minlength=len(own))
        good = bound >= 1 - 1e-9
        return np.column_stack([own[good], block[good]])

    def _groups(self, key: np.ndarray) -> np.ndarray:
        """Places of (term, block) keys among the postings, -1 for those that have none."""
        if self.place is not None:
            return self.place[key]
        if not len(self.group_key):
            return np.full(len(key), -1)
        g = np.minimum(np.searchsorted(self.group_key, key), len(self.group_key) - 1)
        return np.where(self.group_key[g] == key, g, -1)

    def _postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' block postings, and how many each has."""
        first, last = self.term_first[term], self.term_first[term + 1]
        size = last - first
        return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum())), size

    def scores(self, pairs: np.ndarray, window: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Scores of the entries of each (window, block) pair, a row of a block for each; ``window`` is sorted."""
        upto = np.cumsum(np.bincount(window + 1, minlength=int(pairs[-1, 0]) + 2))
        first, last = upto[pairs[:, 0]], upto[pairs[:, 0] + 1]
        size = last - first
        pair = np.repeat(np.arange(len(pairs)), size)
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        g = self._groups(term[at] * self.n_blocks + pairs[pair, 1])
        met = g >= 0
        pair, g = pair[met], g[met]
        size = self.group_start[g + 1] - self.group_start[g]
        at = np.repeat(self.group_start[g] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        key = np.repeat(pair, size) * BLOCK_ITEMS + self.cols[at] % BLOCK_ITEMS
        return np.bincount(key, self.weights[at], minlength=len(pairs) * BLOCK_ITEMS).reshape(len(pairs), BLOCK_ITEMS)

    def search(self, text: str) -> list[tuple]:
        """(item, score, share of shingles, overlap with question, with answer, first word) of the items that a text holds, each at its best place."""
        found: dict[int, tuple] = {}
        listed = words(text)
        if not listed or not self.entries:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in listed])
        del listed
        stride, width = self.longest, 2 * self.longest
        n = max(1, -(-len(ids) // stride))  # windows; the last ones may be shorter
        known = np.flatnonzero(ids >= 0)
        size = len(self.vocabulary)
        for low in range(0, n, _WINDOWS):
            high = min(n, low + _WINDOWS)
            at = known[np.searchsorted(known, low * stride) : np.searchsorted(known, (high - 1) * stride + width)]
            # Each word is in the window that starts in its stride and in the one before.
            own = at // stride
            window = np.concatenate([own[own < high], own[own > low] - 1]) - low
            terms = np.concatenate([ids[at][own < high], ids[at][own > low]])
            key = np.unique(window * size + terms)
            window, terms = np.divmod(key, size)
            pairs = self.candidates(window, terms, high - low)
            if not len(pairs):
                continue
            scores = self.scores(pairs, window, terms)
            for p, e in np.argwhere(scores >= 1 - 1e-9):
                start = (low + int(pairs[p, 0])) * stride
                hit = self._verify(int(pairs[p, 1]) * BLOCK_ITEMS + int(e), Passage(ids[start : start + width]))
                if hit:
                    item, share, question, answer, first = hit
                    if item not in found or share > found[item][1]:
                        found[item] = (float(scores[p, e]), share, question, answer, start + first)
        if len(ids) > width:
            self._search_whole(ids, found)
        return [(item, *x) for item, x in sorted(found.items())]

    def _search_whole(self, ids: np.ndarray, found: dict[int, tuple]) -> None:
        """Adds the items that no window holds, but the text as a whole."""
        terms = np.unique(ids[ids >= 0])
        window = np.zeros(len(terms), np.int64)
        pairs = self.candidates(window, terms, 1)
        if not len(pairs):
            return
        whole, here = Passage(ids), {}
        for low in range(0, len(pairs), _WINDOWS):
            scores = self.scores(pairs[low : low + _WINDOWS], window, terms)
            for p, e in np.argwhere(scores >= 1 - 1e-9):
                at = int(pairs[low + p, 1]) * BLOCK_ITEMS + int(e)
                hit = None if self.entries[at][0] in found else self._verify(at, whole)
                if hit and (hit[0] not in here or hit[1] > here[hit[0]][1]):
                    here[hit[0]] = (float(scores[p, e]), *hit[1:])
        found.update(here)

    def _verify(self, e: int, passage: Passage):
        item, terms, asked = self.entries[e]
        k = min(SHINGLE, len(terms))
        if len(passage.ids) < k:
            return None
        places = passage.places(terms, k)
        hits = np.flatnonzero(places >= 0)
        share = len(hits) / len(places)
        if share < SHARE:
            return None
        # Where the item would begin and end around its shingles.
        first = places[hits] - hits
        there = np.isin(terms, passage.ids[max(0, int(first.min())) : int(first.max()) + len(terms)])
        for j in range(k):
            there[hits + j] = True
        question = float(there[:asked].mean()) if asked else 1.0
        answer = float(there[asked:].mean()) if asked < len(terms) else 1.0
        return item, share, question, answer, int(places[hits].min())


class indexes:  # noqa: N801
    """The index in broadcast parts, each of a bounded size and made when it is asked for; their number grows with the benchmark."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame) -> None:
        self.spark = spark
        self.items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
        total = self.items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        self.parts = -(-total // PART_BYTES)

    def __len__(self) -> int:
        return self.parts

    def __iter__(self) -> Iterator:
        for i in range(self.parts):
            rows = self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.parts)) == i).orderBy("item_id", "text").collect()
            yield self.spark.sparkContext.broadcast(Index([tuple(r) for r in rows]))


SCHEMA = "doc_id long, item_id long, score double, shingle_share double, question_overlap double, answer_overlap double, first_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and each item that it holds; clean documents have none."""
    types = [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc_id.as_py(), *hit) for doc_id, text in zip(batch.column(0), batch.column(1)) if (t := text.as_py()) for hit in held.value.search(t)]
                cols = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        return run

    out = None
    for held in indexes(docs.sparkSession, benchmark):
        found = common.texts(docs).mapInArrow(scan(held), SCHEMA)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they are; what one part of the index leaves is written before the next."""
    common.bounded(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def keep(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.search(x.as_py() or "") for x in batch.column(at)], pa.bool_()))

        return run

    out = docs
    for i, held in enumerate(indexes(docs.sparkSession, benchmark)):
        out = (common.written(out, "uncontaminated") if i else out).mapInArrow(common.releasing(keep(held)), schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
