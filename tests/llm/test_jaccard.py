"""Near duplicates of the pipeline: five-word shingles of similarity 0.8, against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from cuboid.llm import jaccard


def plain(texts):
    """Ids that stay: the least of each group, by all pairs of sets of word tuples."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


@pytest.fixture(scope="module")
def edited():
    """Texts and copies of them with words replaced, as far as similarity 0.6."""
    rng, texts = random.Random(7), {}
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        texts[10 * i] = " ".join(words)
        for k in range(1, 5):
            other = list(words)
            for at in rng.sample(range(len(words)), k=max(1, len(words) * k // 100)):
                other[at] = "changed"
            texts[10 * i + k] = " ".join(other)
    return texts | {9001: None, 9002: "", 9003: "Two words", 9004: "two  WORDS", 9005: "two other"}


def test_stage_links_similarity_of_08(spark, edited):
    docs = spark.createDataFrame([(i, t) for i, t in edited.items()], "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == plain(edited)


def test_blocks_of_large_buckets(spark, edited):
    docs = spark.createDataFrame([(i, t) for i, t in edited.items()], "doc_id long, text string")
    got = jaccard.near_duplicates(docs, held=200).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] == r["component_id"]} == plain(edited)


def test_no_doc_id_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in jaccard.deduplicated(docs).collect()))) == ["2", "3", "None"]
    assert jaccard.deduplicated(docs.limit(0)).count() == 0


def test_recall_of_keys():
    """At similarity 0.8 to 0.85 nearly all pairs share a key."""
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = a.copy()
        b[:30] = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        met += bool(set(jaccard.keys(a)) & set(jaccard.keys(b)))
    assert met == 300
