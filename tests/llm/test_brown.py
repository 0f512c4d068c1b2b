"""The class model: scores against a plain model with the same classes, and every word's class against all of its moves."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cuboid.llm import brown_lm


@pytest.fixture(scope="module")
def docs(spark):
    """Texts in which words of four kinds follow one another in turn."""
    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    rows = []
    for i in range(300):
        at = rng.randrange(4)
        rows.append((i, " ".join(rng.choice(kinds[(at + j) % 4]) for j in range(rng.randint(0, 60)))))
    rows += [(1000, None), (1001, "never seen before"), (1002, "A1 b1 C1 d1 " * 30), (1002, "a1")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("clustered", [20, 512])
def test_scores_are_a_plain_models(docs, monkeypatch, clustered):
    monkeypatch.setattr(brown_lm.Head.__init__, "__defaults__", (clustered,))
    counts = brown_lm.counted(docs)
    model = brown_lm.fit(docs, counts)
    assert model.head.placed == (clustered == 20)
    head, rows = model.head, docs.collect()
    kind = {w: int(model.classes[i]) for w, i in head.index().items()}
    rest, end = int(model.classes[-2]), int(model.classes[-1])
    of = lambda w: end if w == b" " else kind.get(w, rest)
    count, pairs, after, before = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        if not held(r["doc_id"]):
            listed = tokens(r["text"])
            count.update(listed)
            for a, b in zip([b" ", *listed], listed):
                pairs[of(a), of(b)] += 1
                after[of(b)] += 1
                before[of(a)] += 1
    size, total = len(model.transitions), sum(after.values())
    members = Counter()
    for w, c in kind.items():
        members[c] += count[w]

    def score(text):
        out, last = 0.0, end
        for w in tokens(text):
            c = of(w)
            own = (after[c] + 1) / (total + size)
            out += math.log10((pairs[last, c] + brown_lm.SMOOTHING * own) / (before[last] + brown_lm.SMOOTHING))
            if w in kind:
                out += math.log10(count[w] / members[c])
            elif w != b" ":
                out += math.log10((count[w] + 1) / head.rest_size)
            last = c
        return out

    got = sorted((r["doc_id"], r["score"]) for r in brown_lm.scored(docs).collect())
    want = sorted((r["doc_id"], score(r["text"])) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-6)


def test_neighbours_are_all_counted(spark, docs):
    head = brown_lm.head_of(brown_lm.counted(docs))
    label = np.concatenate([np.arange(head.clustered) % 5, np.arange(head.clustered, head.end + 1) % 5])
    got = Counter()
    for r in brown_lm.neighbours(docs, spark.sparkContext.broadcast(head), label).collect():
        got[r["key"]] += r["n"]
    want, index = Counter(), head.index()
    of = lambda w: int(label[head.symbols[len(head.counts) + 1 if w == b" " else index.get(w, len(head.counts))]])
    for r in docs.collect():
        if not held(r["doc_id"]):
            line = [b" ", *tokens(r["text"])]
            for i in range(1, len(line) - 1):
                if line[i] in index:
                    want[index[line[i]] * 10 + of(line[i + 1])] += 1
                    want[(index[line[i]] * 2 + 1) * 5 + of(line[i - 1])] += 1
    assert got == want


def test_each_word_moves_to_its_best_class():
    """Against the likelihood itself, for words that are in no class yet."""
    rng = np.random.default_rng(4)
    classes, size = 6, 9
    table = rng.integers(20, 400, (size, size)).astype(float)
    key, n, want = [], [], []
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for w in range(40):
        like = rng.integers(classes)
        behind, before = (rng.poisson(v / v.sum() * 60) for v in (table[like], table[:, like]))
        gains = []
        for c in range(classes):
            gain = (f(table[c] + behind) - f(table[c])).sum() + (f(table[:, c] + before) - f(table[:, c])).sum()
            gains.append(gain - f(table[c].sum() + behind.sum()) + f(table[c].sum()) - f(table[:, c].sum() + before.sum()) + f(table[:, c].sum()))
        want.append(gains)
        for side, counts in ((0, behind), (1, before)):
            for k in np.flatnonzero(counts):
                key += [(w * 2 + side) * size + int(k)] * 2  # in two parts, as from two tasks
                n += [1, int(counts[k]) - 1]
    order = np.argsort(key, kind="stable")
    words, best = brown_lm.judged(np.array(key)[order], np.array(n)[order], table, np.full(40, classes), classes)
    assert words.tolist() == list(range(40))
    assert all(gains[b] >= max(gains) - 0.02 * (max(gains) - min(gains)) for gains, b in zip(want, best))


def test_held_out_texts_gain(docs):
    """Placing every word explains left-out texts better than placing the most frequent ones alone."""
    counts = brown_lm.counted(docs)
    rows = [r["text"] for r in docs.collect() if held(r["doc_id"])]
    total = {}
    for every in (False, True):
        head_only = brown_lm.Head.__init__.__defaults__
        try:
            brown_lm.Head.__init__.__defaults__ = (20,)
            model = brown_lm.fit(docs, counts, every)
        finally:
            brown_lm.Head.__init__.__defaults__ = head_only
        total[every] = sum(model.score(brown_lm.tokens(t))[1] for t in rows)
    assert total[True] > total[False]
