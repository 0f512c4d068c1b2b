"""Language-model scoring with a Brown class-based bigram model.

Counting: the words of all training texts, merged in each task before they are exchanged.
Classes, of which a larger head has more: first the ``CLUSTERED`` most frequent words are dealt to them by
exchange (each in turn moves to the class that raises the likelihood of the class bigrams most), with the
others' counts beside them by powers of two of their frequency.  Then every word of the head, which has at
most ``HEAD`` words, is exchanged: its neighbours are counted by their class over all training texts, and it
moves to the class whose own neighbours raise the likelihood most.  These moves are judged side by side, each
in the tasks that hold the word's counts, against the classes as they were.  The words beyond the head, unseen
ones included, are one class; the end of a text is one.
P(text) is the product of P(class | class before), smoothed towards the class's own frequency, and
P(word | class).

The head goes to the tasks that score; its size is bounded by a threshold on the count, found from
the histogram of counts.  Words of the rest are joined with their counts; by the threshold none of
them is frequent, so no key of that join is hot.

Cases: a null or empty text is the end token alone; without training texts every probability is that
of the unseen; words with one count go to classes in the order of their bytes; repeated rows are
scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.llm import common

FOLDS, HELD = 7, 2
CLUSTERED, CLASSES, ROUNDS = 512, 32, 6
#: Classes of a large head: a third of the root of its size, at most so many.
MOST_CLASSES = 128
HEAD, SMOOTHING = 200_000, 50.0
#: The end token among the words, none of which has a space.
END = b" "
_BANDS, _FLUSH = 64, 500_000
#: Tokens whose neighbours are counted together, and counts that are judged together.
_CHUNK, _JUDGED = 1 << 20, 1 << 15


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def training(docs: DataFrame) -> DataFrame:
    return common.texts(docs).where(common.remainder(F.col("doc_id"), FOLDS) != HELD).select("text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for x in batch.column(0):
            held.update(tokens(x.as_py()))
            held[END] += 1
            if len(held) > _FLUSH:
                yield out()
    if held:
        yield out()


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all training texts, the end token included; written once."""
    return common.written(training(docs).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


class Head:
    """The frequent words with their counts; number i is the i-th most frequent.

    Symbols: a clustered word is its number; then come the bands, the rest and the end.
    """

    def __init__(self, rows: list[tuple[bytes, int]], totals: tuple[int, int, int], clustered: int = CLUSTERED) -> None:
        """rows: (word, count) without the end; totals: all tokens, distinct tokens, ends."""
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.words = b" ".join(w for w, _ in rows)
        self.counts = np.array([n for _, n in rows], np.int64)
        self.n_tokens, self.n_distinct, self.n_ends = totals
        self.clustered = min(clustered, len(rows))
        self.rest, self.end = self.clustered + _BANDS, self.clustered + _BANDS + 1
        symbols = np.arange(len(rows) + 2)
        symbols[self.clustered : len(rows)] = self.clustered + np.log2(np.maximum(self.counts[self.clustered :], 1)).astype(int)
        symbols[len(rows) :] = self.rest, self.end
        self.symbols = symbols  # of a word's number; behind the head's words are one of the rest and the end
        self.placed = False
        rest_tokens = self.n_tokens - self.n_ends - int(self.counts.sum())
        # One more for each word of the rest, and as many words again, and one, that no training text has.
        self.rest_size = rest_tokens + 2 * max(0, self.n_distinct - len(rows) - (self.n_ends > 0)) + 1

    def assigned(self, classes: np.ndarray, n: int) -> Head:
        """This head with its words' classes, of which there are ``n``, as their symbols."""
        out = Head.__new__(Head)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "_index"}
        out.rest, out.end, out.placed = n, n + 1, True
        out.symbols = np.append(classes, [n, n + 1])
        return out

    def index(self) -> dict[bytes, int]:
        if not hasattr(self, "_index"):
            listed = self.words.split(b" ") if self.words else []
            self._index = dict(zip(listed, range(len(listed))))
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def numbers(self, listed: list[bytes]) -> np.ndarray:
        """Numbers of words and of the end behind them; those of the rest have the number behind the head's."""
        get, rest = self.index().get, len(self.counts)
        found = list(map(get, listed))
        if None in found:
            found = [rest if x is None else x for x in found]
        found.append(rest + 1)
        return np.array(found)


def head_of(counts: DataFrame, most: int = HEAD) -> Head:
    """The words whose count reaches the least threshold, 2 at least, that at most ``most`` words reach.

    Words seen once are of the rest, so that its class is as likely as new words are.
    """
    words = counts.where(F.col("word") != F.lit(END))
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    total = counts.agg(F.sum("n"), F.count("*")).first()
    # Of counts beyond 2**20 at most (tokens / 2**20) words can have one: those are few.
    levels = words.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("k")).collect()
    threshold, have = None, 0
    for r in sorted(levels, reverse=True):
        if have + r["k"] > most or r["n"] < 2:
            break
        threshold, have = r["n"], have + r["k"]
    rows = [] if threshold is None else words.where(F.col("n") >= threshold).collect()
    return Head([(bytes(r["word"]), r["n"]) for r in rows], (total[0] or 0, total[1], ends))


def bigrams(docs: DataFrame, head) -> np.ndarray:
    """Counts of symbol pairs in all training texts; a text starts behind an end."""
    size = head.value.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = head.value, np.zeros(size * size, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def add() -> None:
            s = np.concatenate([[own.end], *waiting])
            np.add(table, np.bincount(s[:-1] * size + s[1:], minlength=size * size), out=table)
            waiting.clear()

        for batch in batches:
            for x in batch.column(0):
                waiting.append(own.symbols[own.numbers(tokens(x.as_py()))])
                held += len(waiting[-1])
                if held > 1 << 20:
                    add()
                    held = 0
        if waiting:
            add()
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["pair", "n"])

    found = training(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size, np.int64)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(size, size)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, clustered: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol: the first ``clustered`` move between ``classes``, all others keep one of their own."""
    size = len(table)
    classes = max(1, min(classes, clustered)) if clustered else 0
    label = np.concatenate([np.arange(clustered) % max(1, classes), classes + np.arange(size - clustered)])
    total = classes + size - clustered
    onehot = np.zeros((size, total))
    onehot[np.arange(size), label] = 1
    wide = table.astype(np.float64)
    right, left = wide @ onehot, wide.T @ onehot  # of a symbol: counts before, and behind, each class
    n = onehot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            old, own = label[w], wide[w, w]
            out_, in_ = right[w].copy(), left[w].copy()
            out_[old] -= own
            in_[old] -= own
            n[old] -= out_
            n[:, old] -= in_
            n[old, old] -= own
            c = np.arange(classes)
            rows, cols = n[:classes], n[:, :classes].T
            gain = (_plogp(rows + out_) - _plogp(rows)).sum(axis=1) + (_plogp(cols + in_) - _plogp(cols)).sum(axis=1)
            corner = n[c, c]
            gain += _plogp(corner + out_[c] + in_[c] + own) - _plogp(corner + out_[c]) - _plogp(corner + in_[c]) + _plogp(corner)
            before, behind = n.sum(axis=1)[:classes], n.sum(axis=0)[:classes]
            gain -= _plogp(before + out_.sum() + own) - _plogp(before) + _plogp(behind + in_.sum() + own) - _plogp(behind)
            new = int(gain.argmax())
            n[new] += out_
            n[:, new] += in_
            n[new, new] += own
            if new != old:
                moved += 1
                label[w] = new
                right[:, old] -= wide[:, w]
                right[:, new] += wide[:, w]
                left[:, old] -= wide[w]
                left[:, new] += wide[w]
        if not moved:
            break
    return label


def classes_of(words: int) -> int:
    return min(MOST_CLASSES, max(CLASSES, round(words**0.5 / 3)))


def neighbours(docs: DataFrame, head, label: np.ndarray) -> DataFrame:
    """(key, n): how often a class stands before or behind a word of the head; merged in each task.

    key: (word * 2 + (0 behind it, 1 before it)) * classes + class; ``label`` is the class of each symbol.
    """
    size = int(label.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, held = head.value, [], 0
        words, classes = len(own.counts), label[own.symbols]

        def merged() -> pa.RecordBatch:
            word = np.concatenate([np.array([words + 1]), *waiting])
            kind = classes[word]
            known = np.flatnonzero(word[1:] < words) + 1  # an end stands behind each text, and before the first
            behind, before = word[known] * 2 * size + kind[known + 1], (word[known] * 2 + 1) * size + kind[known - 1]
            key, n = np.unique(np.concatenate([behind, before]), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        for batch in batches:
            for x in batch.column(0):
                waiting.append(own.numbers(tokens(x.as_py())))
                held += len(waiting[-1])
                if held > _CHUNK:
                    yield merged()
                    held = 0
        if waiting:
            yield merged()

    return training(docs).mapInArrow(run, "key long, n long")


def judged(key: np.ndarray, n: np.ndarray, table: np.ndarray, now: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, best class of each) by what a move adds to the likelihood of the class bigrams.

    key: sorted, as from ``neighbours``; table: bigrams of all classes, of which words can be in the first ``classes``;
    now: each word's class.  x log x grows from x to x + n by about n (1 + log(x + n / 2)).
    """
    size = len(table)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n, key = np.add.reduceat(n, first).astype(np.float32), key[first]
    word, rest = np.divmod(key, 2 * size)
    before, kind = np.divmod(rest, size)
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    # Counts of each class with the neighbour's class, on the side where it stands.
    beside = np.where((before == 1)[:, None], table[kind, :classes], table[:classes, kind].T).astype(np.float32)
    old = now[word]
    own = np.flatnonzero(old < classes)
    beside[own, old[own]] -= n[own]
    gain = np.add.reduceat(n[:, None] * np.log(np.maximum(beside, 0) + n[:, None] / 2), starts, axis=0)
    # Less what the class's own totals grow by.
    words = word[starts]
    for side, totals in ((0, table.sum(axis=1)), (1, table.sum(axis=0))):
        more = np.add.reduceat(np.where(before == side, n, 0), starts)
        total = np.tile(totals[:classes], (len(words), 1))
        mine = np.flatnonzero(now[words] < classes)
        total[mine, now[words[mine]]] -= more[mine]
        gain -= more[:, None] * np.log(np.maximum(total, 0) + more[:, None] / 2 + 1e-9)
    return words, gain.argmax(axis=1)


def placed(docs: DataFrame, head: Head, held, label: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word of the head, after each one's exchange against the classes of ``label``."""
    now = label[head.symbols[: len(head.counts)]]
    size = len(table)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            words, best = judged(key, n, table, now, classes)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int64())], ["word", "class"])

        for batch in batches:
            key, n = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, n)))
            if len(key) > _JUDGED:  # the last word may go on
                cut = int(np.searchsorted(key, key[-1] // (2 * size) * 2 * size))
                if cut:
                    yield out(key[:cut], n[:cut])
                    key, n = key[cut:], n[cut:]
        if len(key):
            yield out(key, n)

    pairs = neighbours(docs, held, label).repartition(parts, F.expr(f"key div {2 * size}")).sortWithinPartitions("key")
    found = pairs.mapInArrow(run, "word long, class long").toArrow()
    out = np.where(now < classes, now, 0)
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    return out


class Model:
    """Logarithms (base 10) of transitions between classes and of words in their class."""

    def __init__(self, head: Head, table: np.ndarray, smoothing: float = SMOOTHING) -> None:
        self.head = head
        label = np.arange(len(table)) if head.placed else exchange(table, head.clustered, classes_of(len(head.counts)))
        size = int(label.max()) + 1
        n = np.zeros((size, size))
        np.add.at(n, (label[:, None], label[None, :]), table)
        own = (n.sum(axis=0) + 1) / (n.sum() + size)
        self.transitions = np.log10((n + smoothing * own) / (n.sum(axis=1, keepdims=True) + smoothing))
        self.classes = label[head.symbols]  # of a word's number
        members = np.zeros(size)
        np.add.at(members, self.classes[: len(head.counts)], head.counts)
        emissions = np.zeros(len(self.classes))
        emissions[: len(head.counts)] = np.log10(head.counts / members[self.classes[: len(head.counts)]]) if len(head.counts) else 0
        self.emissions = emissions  # that of the rest comes from its join, the end is alone in its class
        self.floor = float(np.log10(head.n_tokens + head.n_distinct + 1))
        self.base = np.log10(np.concatenate([head.counts, [0, head.n_ends]]) + 1) - self.floor
        self.base[len(head.counts)] = 0

    def score(self, listed: list[bytes]) -> tuple[float, float, int, np.ndarray]:
        """Base score and score but for words of the rest, tokens, and where words of the rest stand."""
        numbers = self.head.numbers(listed)
        c = self.classes[numbers]
        score = self.transitions[self.classes[-1], c[0]] + self.transitions[c[:-1], c[1:]].sum() + self.emissions[numbers].sum()
        return float(self.base[numbers].sum()), float(score), len(numbers), np.flatnonzero(numbers == len(self.head.counts))


def fit(docs: DataFrame, counts: DataFrame, every: bool = True) -> Model:
    """every: exchange all words of the head, not only the most frequent ones."""
    spark, head = docs.sparkSession, head_of(counts)
    held = spark.sparkContext.broadcast(head)
    table = bigrams(docs, held)
    if every and len(head.counts) > head.clustered:
        classes = min(classes_of(len(head.counts)), head.clustered)
        label = exchange(table, head.clustered, classes)
        size = int(label.max()) + 1
        n = np.zeros((size, size))
        np.add.at(n, (label[:, None], label[None, :]), table)
        head = head.assigned(placed(docs, head, held, label, n, classes), classes)
        held.unpersist()
        held = spark.sparkContext.broadcast(head)
        table = bigrams(docs, held)
    held.unpersist()
    return Model(head, table)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark: SparkSession = docs.sparkSession
    counts = counted(docs)
    model = fit(docs, counts)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), []
                for x in part.column(2):
                    listed = tokens(x.as_py())
                    base, score, n, rest = own.score(listed)
                    words = Counter([listed[i] for i in rest.tolist()])
                    out.append((row, base, score, n, n - len(rest) - (own.head.n_ends == 0), list(words), list(words.values())))
                    row += 1
                cols = list(zip(*out))
                types = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "held_out", "row", "base", "score", "n_tokens", "n_known", "words", "times"])

    rows = common.texts(docs).select("doc_id", (common.remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, row long, base double, score double, n_tokens long, n_known long, words array<binary>, times array<long>"
    parts = common.written(rows.mapInArrow(run, schema), "scores")
    rest = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    joined = rest.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    from_rest = joined.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 1) - model.floor)).alias("base_more"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 1) - float(np.log10(model.head.rest_size)))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"),
    )
    zero = F.lit(0)
    return parts.drop("words", "times").join(from_rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_more", zero)).alias("n_known"),
        F.lit(model.head.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )


def op5_brown(spark, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))
