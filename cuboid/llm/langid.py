"""Language identification by a string kernel.

Two texts are alike by the n-grams (n = 1, 2, 3, blended) that both have: presence, not counts,
divided by the root of the product of their numbers.  Landmarks span the kernel's feature space
(Nystroem), and a ridge regression for each language against the rest is fitted in it.  Texts are
scored in batches: their presence matrix times the landmarks', then times the fitted weights.

n-grams run over the whole text, folded to 64 symbols: one for what isn't a letter (runs count once)
and 63 for lower-case letters, a-z apart and all others by their code point modulo 37.

The model is fitted on ``SAMPLE`` labelled rows at most, dealt evenly over all languages, or on ``EACH`` of
every language where these are more, chosen by a hash of the id; everything else sees all rows.

The scores of a text sum to 1 over the languages, so they can't tell that it is in none.  ``known`` goes by
the share of the text's trigrams that the sampled rows of its language have.  The least share is
calibrated for each language: on each half of its rows, with the trigrams of the other half.

Cases: a null text or one without letters is ``und`` with score 0, as is every text if no row is
labelled; ties go to the language that sorts first; repeated rows are decided each; an empty table
gives an empty result; other columns are kept by ``known`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuboid.llm import common

FOLDS = 5
SAMPLE, EACH, LANDMARKS, RIDGE = 2400, 8, 192, 1e-3
#: ``known`` rejects texts whose share of learned trigrams is below SLACK times the share that all but LOST of left-out rows have.
SLACK, LOST = 0.8, 0.005
_BITS, _N = 6, (1 << 6) + (1 << 12) + (1 << 18)
_THREE = (1 << 6) + (1 << 12)
_BATCH = 64
_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of each code point."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
        out[letters] = 27 + letters % 37
        out[97:123] = np.arange(1, 27)
        _table.append(out)
    return _table[0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of the folded text, repeats included; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.concatenate([[0], _symbols()[points], [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 2:
        return np.zeros(0, np.int32)
    two = s[:-1] << _BITS | s[1:]
    three = two[:-1] << _BITS | s[2:]
    return np.concatenate([s[s > 0], two + (1 << 6), three + (1 << 6) + (1 << 12)])


def _share(learned: np.ndarray, codes: np.ndarray) -> float:
    """Share of the trigrams among the codes whose bit is set; one is given to each text, as short ones have few."""
    codes = codes[codes >= _THREE]
    return (1 + np.count_nonzero(learned[codes >> 3] >> (codes & 7).astype(np.uint8) & 1)) / (1 + len(codes))


class Model:
    """Landmarks over the n-grams that any of them has, and the weights of each language."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        """sets: the distinct n-grams of each row."""
        self.langs = sorted(set(langs))
        rank = np.zeros(len(langs), np.int64)
        for lang in self.langs:
            own = np.array([x == lang for x in langs])
            rank[own] = np.arange(own.sum())
        chosen = np.argsort(rank, kind="stable")[: max(landmarks, len(self.langs))]  # one of each language at least
        self.columns = np.unique(np.concatenate([sets[i] for i in chosen])) if len(chosen) else np.zeros(0, np.int64)
        sizes = np.sqrt([max(1, len(x)) for x in sets])
        dense = np.zeros((len(sets), len(self.columns)), np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(self.columns, x)
            at[at == len(self.columns)] = 0
            dense[i, at[self.columns[at] == x] if len(self.columns) else []] = 1
        self.landmarks = (dense[chosen] / sizes[chosen, None]).T.astype(np.float32)
        kernel = (dense @ self.landmarks / sizes[:, None]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > values.max(initial=0) * 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        mapped = kernel @ root
        target = np.array([[float(x == lang) for lang in self.langs] for x in langs]).reshape(len(langs), len(self.langs))
        self.mean = target.mean(axis=0) if len(langs) else np.zeros(0)
        fitted = np.linalg.solve(mapped.T @ mapped + ridge * len(sets) * np.eye(mapped.shape[1]), mapped.T @ (target - self.mean)) if len(sets) else np.zeros((0, 0))
        self.weights = (root @ fitted).astype(np.float32)
        self.least, self.learned = np.zeros(len(self.langs)), np.zeros((len(self.langs), -(-_N // 8)), np.uint8)
        for i, lang in enumerate(self.langs):
            own = [x for x, y in zip(sets, langs) if y == lang]
            halves = [self._union(own[::2]), self._union(own[1::2])]
            self.learned[i] = halves[0] | halves[1]
            if len(own) > 1:
                self.least[i] = SLACK * np.quantile([_share(halves[1 - k % 2], x) for k, x in enumerate(own)], LOST)

    @staticmethod
    def _union(sets: list[np.ndarray]) -> np.ndarray:
        """A bit for each n-gram that any row has."""
        out = np.zeros(_N, bool)
        for x in sets:
            out[x] = True
        return np.packbits(out, bitorder="little")

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [x[:2] for x in self.scored(texts)]

    def scored(self, texts: pa.Array) -> list[tuple[str, float, bool]]:
        """(language, score, whether its trigrams are that language's) of each text."""
        out = []
        seen = np.zeros(_N, bool)
        for low in range(0, len(texts), _BATCH):
            part = texts.slice(low, _BATCH).to_pylist()
            present, sizes, threes = np.zeros((len(part), len(self.columns)), np.float32), np.zeros(len(part)), []
            for i, text in enumerate(part):
                codes = grams(text) if text else np.zeros(0, np.int32)
                threes.append(codes[codes >= _THREE])
                if len(codes):
                    seen[codes] = True
                    sizes[i] = np.count_nonzero(seen)
                    present[i] = seen[self.columns]
                    seen[codes] = False
            if not self.langs:
                out += [("und", 0.0, False)] * len(part)
                continue
            scores = (present @ self.landmarks / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)) @ self.weights + self.mean
            best = scores.argmax(axis=1)
            out += [(self.langs[b], float(min(1.0, max(0.0, row[b]))), _share(self.learned[b], codes) >= self.least[b]) if size else ("und", 0.0, False) for b, row, size, codes in zip(best, scores, sizes, threes)]
        return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(grams(t.as_py() or "")) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["grams", "lang", "rank"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the text and lang of rows that aren't held out."""
    rows = common.texts(docs, "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(common.remainder(F.col("doc_id"), FOLDS) != 0)
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Model([], [])
    each = max(EACH, sample // len(counts))
    spark = docs.sparkSession
    # Twice the rows that are needed, by a hash, so that no language's rows must be sorted as a whole.
    shares = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * each / r["count"])) for r in counts], "lang string, share double")
    hashed = F.xxhash64(F.lit("language"), F.col("doc_id"))
    few = rows.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(F.pmod(hashed, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id", "text"))).where(F.col("rank") <= each)
    # Few tasks for a bounded sample: each one keeps a Python worker.
    got = ranked.select("text", "lang", "rank").coalesce(4).mapInArrow(_sets, "grams array<int>, lang string, rank int").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    keep = [(g, x) for g, x in zip(got["grams"].to_pylist(), got["lang"].to_pylist()) if g]
    return Model([np.array(g) for g, _ in keep], [x for _, x in keep])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = common.texts(docs).select("doc_id", (common.remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, by the trigrams of its best one."""
    common.bounded(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.scored(batch.column(at))
            yield batch.filter(pa.array([x != "und" and own for x, _, own in found], pa.bool_()))

    return docs.mapInArrow(common.releasing(run), docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
