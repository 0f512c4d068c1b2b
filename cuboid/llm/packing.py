"""Packing by minimum bin slack: token ids of all documents in windows of 2,048 without padding.

One pass and no shuffle.  A document's whole windows go out at once; what remains of it waits in a
bounded pool.  Each further window starts with the longest remainder of the pool; a bitset dynamic
programme over the multiset of the other lengths (a Python number whose bit n says that some choice
sums to n) finds the choice that comes closest to the window's end, and backtracking gives how many
of each length it takes.  Where no choice meets the end, one more remainder is cut to fill the slack.
What the last window of a task leaves is cut at powers of two, which need no padding.

Token ids are those of the tokenizer for the whole text: it drops white space and never joins what
white space parts, so words can be encoded once and looked up later.  The look-up table is bounded
and only saves time.

Cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives
an empty result; other columns are not read.  A lost task is run again on the same rows and gives the
same sequence ids, which hold the task's partition in their high bits.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cuboid.llm import common

CAPACITY, END = 2048, 1
#: Remainders that wait in a task, and how few are left for the next ones to be mixed with.
POOL, LOW = 768, 256
#: Words that a worker's table holds at most; fewer where it is given up when a task ends.
_WORDS, _FEW_WORDS = 700_000, 120_000
#: What may follow a word of letters: a run of these is one piece to the tokenizer; an apostrophe may not be.
_MARKS = ".,!?;:*%&$#@()[]{}<>/|\\-_=+~^\""
_END = np.array([END], "<u4")
#: Texts that are encoded together hold so many bytes at most, or are one.
_TOGETHER, _LITTLE = 1 << 23, 1 << 21


class Encoder:
    """Token ids of whole texts, by a bounded table of words."""

    def __init__(self, path: str | None = None, most: int = _WORDS) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = most
        self.index: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cores(self, cores: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one line: each gives one end-of-word token, its last."""
        line = " ".join(cores)
        if cores and unicodedata.is_normalized("NFC", line):
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(cores):
                data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                return [data[i:j] for i, j in zip(at, at[1:])]
        return [self._one(x) for x in cores]

    def _learn(self, words: list[str]) -> None:
        cores = [w.rstrip(_MARKS) for w in words]
        letters = list(map(str.isalpha, cores))
        if not all(letters):
            self.index.update((w, self._one(w) if w else b"") for w, ok in zip(words, letters) if not ok)
            words, cores = list(compress(words, letters)), list(compress(cores, letters))
        ends = [w[len(c) :] for w, c in zip(words, cores)]
        for x in set(ends) - self.marks.keys():
            self.marks[x] = self._one(x)
        self.index.update(zip(words, map(add, self._cores(cores), map(self.marks.__getitem__, ends))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of whole texts, each with the end id; a null is empty.

        Words are numbered per call in Arrow, so only distinct ones are looked up one by one.
        """
        if len(self.index) > self.most or len(self.marks) > self.most:
            self.index.clear()
            self.marks = {"": b""}
        texts = pc.fill_null(texts, "")
        # Case doesn't matter to the ids, but for the names of special tokens.
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        listed = pc.ascii_split_whitespace(low)
        words = listed.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = list(map(self.index.get, distinct))
        if None in found:
            self._learn([w for w, x in zip(distinct, found) if x is None])
            found = list(map(self.index.__getitem__, distinct))
        taken = pa.array(found, pa.large_binary()).take(words.indices)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4 if len(taken) else np.zeros(1, np.int64)
        at = ends[listed.offsets.to_numpy() - listed.offsets[0].as_py()].tolist()
        return [np.append(ids[i:j], _END) for i, j in zip(at, at[1:])]


def fill(counts: dict[int, int], target: int) -> tuple[dict[int, int], int]:
    """Of a multiset of lengths, how many of each make the sum closest to ``target`` without passing it; and the slack."""
    keep = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= target), reverse=True):
        left, take = counts[length], 1
        while left and take * length <= target:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << take * length & keep
            left -= take
            take *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    slack, chosen = target - at, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen, slack


class Packer:
    """Takes documents and gives windows, each a list of (document, start in it, ids)."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL, low: int = LOW) -> None:
        self.capacity, self.most, self.low = capacity, pool, low
        self.by_length: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.n = 0

    def _put(self, doc, start: int, ids: np.ndarray) -> None:
        k = len(ids)
        self.by_length.setdefault(k, []).append((doc, start, ids))
        self.counts[k] = self.counts.get(k, 0) + 1
        self.n += 1

    def _take(self, length: int) -> tuple:
        piece = self.by_length[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length], self.by_length[length]
        self.n -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> Iterator[list[tuple]]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(doc, at, ids[at : at + self.capacity])]
        if whole < len(ids):
            self._put(doc, whole, ids[whole:].copy())
            if self.n >= self.most:
                while self.n > self.low:
                    yield self._window()

    def _window(self) -> list[tuple]:
        pieces = [self._take(max(self.counts))]
        chosen, slack = fill(self.counts, self.capacity - len(pieces[0][2]))
        for length in sorted(chosen, reverse=True):
            pieces += [self._take(length) for _ in range(chosen[length])]
        if slack and self.n:
            doc, start, ids = self._take(max(self.counts))  # longer than the slack: else it would have been chosen
            pieces.append((doc, start, ids[:slack]))
            self._put(doc, start + slack, ids[slack:])
        return pieces

    def end(self) -> Iterator[list[tuple]]:
        while self.n:
            pieces = self._window()
            left = sum(len(ids) for *_, ids in pieces)
            while left:
                size = 1 << (left.bit_length() - 1)
                now, free = [], size
                while free:
                    doc, start, ids = pieces.pop(0)
                    now.append((doc, start, ids[:free]))
                    if len(ids) > free:
                        pieces.insert(0, (doc, start + free, ids[free:]))
                    free -= min(free, len(ids))
                left -= size
                yield now


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_encoder: dict[str | None, Encoder] = {}


def _pack(path: str | None, capacity: int, keep_words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoder:
            _encoder[path] = Encoder(path, _WORDS if keep_words else _FEW_WORDS)
        encoder, packer = _encoder[path], Packer(capacity)
        task, n = TaskContext.get().partitionId() << 40, 0
        together = _TOGETHER if keep_words else _LITTLE
        rows: list[tuple] = []

        def keep(window: list[tuple]) -> None:
            nonlocal n
            offset = 0
            for (doc_id, tokens), start, ids in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids), tokens, task | n, offset))
                offset += len(ids)
            n += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _NAMES)
            rows.clear()
            return batch

        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            low = 0
            while low < batch.num_rows:
                before = size[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(size, before + together, "right")))
                part = batch.slice(low, high - low)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    for window in packer.add((doc_id, len(ids)), ids):
                        keep(window)
                    if len(rows) > 20_000:
                        yield out()
                low = high
        for window in packer.end():
            keep(window)
        if not keep_words:
            del encoder
            _encoder.pop(path)
            common.release()
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """One row for each piece.

    tokenizer: the path of its file on the executors, by default that of the installed public one.
    keep_words: workers keep their table of words from task to task, which saves time and takes some
    300 MB of each that has run one; without, the table is small and its memory is free for other work
    on the same executors.
    """
    return common.texts(docs).mapInArrow(_pack(tokenizer, capacity, keep_words), SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
