"""Candidates of the block-max search against the scores of all items, and parts of a benchmark one after another."""

import random

import numpy as np
import pytest

from cuboid.llm import decontam


@pytest.mark.parametrize("seed", range(6))
def test_no_item_above_the_threshold_is_skipped(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:  # as in a large index
        monkeypatch.setattr(decontam, "_DENSE", 0)
        monkeypatch.setattr(decontam, "_DIRECT", 0)
    pool = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    index = decontam.Index(items)
    n, size = 40, len(index.vocabulary)
    bags = []
    for _ in range(n):
        bag = {rng.choice(pool) for _ in range(rng.randint(0, 40))}
        for _, text in rng.sample(items, rng.randint(0, 2)):
            listed = text.split()
            bag |= set(rng.sample(listed, max(1, int(len(listed) * rng.choice((0.5, 0.8, 1))))))
        bags.append({index.vocabulary[w.encode()] for w in bag if w.encode() in index.vocabulary})
    key = np.unique([w * size + t for w, bag in enumerate(bags) for t in bag])
    window, term = np.divmod(key, size)
    found = {tuple(p) for p in index.candidates(window, term, n).tolist()}
    weight = {}
    for t, e, w in zip(index.rows.tolist(), index.cols.tolist(), index.weights.tolist()):
        weight.setdefault(e, {})[t] = w
    wanted, bounds = set(), {}
    for k, bag in enumerate(bags):
        for e, own in weight.items():
            if sum(own.get(t, 0) for t in bag) >= 1:
                wanted.add((k, e // decontam.BLOCK_ITEMS))
        for b in range(index.n_blocks):
            bounds[k, b] = sum(max((weight[e].get(t, 0) for e in range(b * 16, min(b * 16 + 16, len(items)))), default=0) for t in bag)
    assert wanted <= found and wanted
    assert found == {p for p, x in bounds.items() if x >= 1 - 1e-9}


def test_no_terms_and_no_items():
    none = np.zeros(0, np.int64)
    assert len(decontam.Index([(1, "a b c d e f")]).candidates(none, none, 3)) == 0
    assert decontam.Index([]).search("a b c") == []


def test_parts_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 150)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(12)]
    rows = [(i, f"before {t} behind", i) for i, t in items] + [(99, "nothing of it", 1), (100, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.uncontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [99, 100]


def test_question_and_answer_of_a_long_item():
    """What is reported of an entry of a long item is of the question's and the answer's words in it."""
    text = " ".join(f"q{i}" for i in range(300)) + "? " + " ".join(f"a{i}" for i in range(40)) + "."
    index = decontam.Index([(5, text)])
    assert sum(asked for _, _, asked in index.entries) >= 300 and index.entries[0][2] == len(index.entries[0][1])
    (hit,) = index.search(text)
    assert hit[0] == 5 and hit[2] == hit[3] == hit[4] == 1
