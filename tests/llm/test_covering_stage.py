"""The pipeline's near duplicates come through the covering masks first: held against all pairs of fingerprints and sets."""

import random
from collections import Counter

import numpy as np
import pytest

from cuboid.llm import jaccard, simhash

SCHEMA = "doc_id long, copy long, n long, fp long, keys array<long>"


def alike(a, b):
    met = len(np.intersect1d(a, b))
    return met >= jaccard.SHARE * (len(a) + len(b) - met) - 1e-9


def bits(a, b):
    return bin(simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)).count("1")


def groups(ids, pairs):
    """The least id of each id's group."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    """Pairs of texts from hardly changed to similarity 0.6: of all kinds, within the radius or not, alike or not."""
    rng, out = random.Random(11), {}
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        out[i] = " ".join(words)
        for at in rng.sample(range(len(words)), k=max(1, len(words) * (i % 6) // 100)):
            words[at] = "changed"
        out[i + 1] = " ".join(words)
    return out


@pytest.fixture(scope="module")
def sets(texts):
    return {i: jaccard.shingles(t.encode()) for i, t in texts.items()}


def test_fingerprints_of_sets(sets):
    """Bit j is 1 if it is set in over half of the hashes, by counting; without any it is zero."""
    for found in [*list(sets.values())[:20], np.zeros(0, np.uint64)]:
        counts = Counter(j for h in found.tolist() for j in range(64) if h >> j & 1)
        assert simhash.fingerprint_of(found) == sum(1 << j for j in range(64) if 2 * counts[j] > len(found))


def test_covering_step_links_by_itself(spark, texts, sets):
    """Without any key in common, texts within the radius are linked if their sets are alike, and only these."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    copies = {r["doc_id"]: r["copy"] for r in jaccard._copies(docs).select("doc_id", "copy").collect()}
    rows = [(i, copies[i], len(s), simhash._signed(simhash.fingerprint_of(s)), [i]) for i, s in sets.items()]
    found = jaccard.links(docs, spark.createDataFrame(rows, SCHEMA)).collect()
    ids = {c: i for i, c in copies.items()}
    pairs = [(i, i + 1, bits(sets[i], sets[i + 1]) <= simhash.RADIUS, alike(sets[i], sets[i + 1])) for i in range(0, 600, 2)]
    assert {x[2:] for x in pairs} == {(True, True), (True, False), (False, True), (False, False)}
    wanted = groups(texts, [(a, b) for a, b, near, same in pairs if near and same])
    assert groups(texts, [(ids[r["a"]], ids[r["b"]]) for r in found]) == wanted


def test_keys_link_the_rest(spark, texts, sets):
    """Both steps together link all texts whose sets are alike, and only these."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == groups(texts, [(i, i + 1) for i in range(0, 600, 2) if alike(sets[i], sets[i + 1])])


def test_linked_buckets_are_not_compared_again(spark, texts, sets, monkeypatch):
    """Buckets of keys whose members the fingerprints have linked stay out; what is compared twice would be them."""
    asked, plain = [], jaccard._compared

    def spy(docs, rows, buckets, total, held):
        asked.append(buckets.count())
        return plain(docs, rows, buckets, total, held)

    monkeypatch.setattr(jaccard, "_compared", spy)
    near = next(i for i in range(0, 600, 2) if bits(sets[i], sets[i + 1]) <= simhash.RADIUS and alike(sets[i], sets[i + 1]))
    docs = spark.createDataFrame([(0, texts[near]), (1, texts[near + 1]), (2, "of another kind")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and asked == [1, 0]
