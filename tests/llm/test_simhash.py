import itertools
import random

import numpy as np
import pytest
import xxhash

from cuboid.llm import simhash
from cuboid.llm.components import components


def plain(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 6, 50):
        text = " \t".join(rng.choice(["A", "bé", "C1", "the", "Über"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain(text)
    long = "some words and others " * 20_000
    assert simhash.fingerprint(long.encode()) == plain(long)


def test_every_near_pair_meets():
    table = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(table) == 31
    rng = random.Random(3)
    for _ in range(3000):
        differ = sum(1 << j for j in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & differ for m in table)


def groups(nodes, radius=4):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if bin(a ^ b).count("1") <= radius:
            root[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def values(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for j in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << j
        out.add(x)
    return sorted(out)


def test_forest_spans():
    nodes = values(4, 200)
    links = simhash.forest(np.array(nodes, np.uint64), 4)
    assert all(bin(int(a) ^ int(b)).count("1") <= 4 for a, b in links)
    assert len(links) == len(nodes) - len(groups(nodes))


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_join_the_same_groups(spark, bucket):
    nodes = values(5, 300)
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, bucket)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    found = {}
    for x, s in zip(nodes, signed):
        found.setdefault(roots.get(s, s), set()).add(x)
    assert sorted(map(sorted, found.values())) == groups(nodes)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2300)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_documents(spark):
    rows = [(9, "one two three four five six"), (3, "One two three four five six"), (5, None), (4, " "), (7, "something else altogether with other words in it"), (None, "one two three four five six")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) fingerprint", "component_id").collect()}
    assert got[5] == got[4] == ("0" * 16, 4) and got[9][1] == got[3][1] == got[None][1] == 3 and got[7][1] == 7
    kept = simhash.deduplicated(spark.createDataFrame(rows + [(7, rows[4][1])], "doc_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "7", "None"]


def test_rows_of_all_masks_are_spread(spark):
    """Behind an aggregate by fingerprint, too, and not merged for their few bytes."""
    groups = spark.range(500).selectExpr("id % 300 AS fp").groupBy("fp").count()
    spread = simhash._spread(groups, 7)
    spread.collect()
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
    assert simhash._dealt(spread, 4).rdd.getNumPartitions() == 7 and simhash._dealt(spread, 4).count() == 300 * 31


def test_a_bucket_over_several_batches():
    """Members of a bucket that is too large are all passed on, whatever the batches; others give their links."""
    import pyarrow as pa

    rng, rows = random.Random(8), []
    for key, n in ((1, 3), (2, 50), (3, 1), (4, 2), (5, 11), (6, 10), (7, 30)):
        rows += [(0, key, x) for x in rng.sample(range(16), min(n, 16))] if n <= 11 else [(0, key, rng.getrandbits(60)) for _ in range(n)]
    for size in (1, 2, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + size])], ["t", "key", "fp"]) for at in range(0, len(rows), size)]
        got = [r for b in simhash._bucket_links(4, 10)(batches) for r in b.to_pylist()]
        assert sorted((r["key"], r["a"]) for r in got if r["b"] is None) == sorted((k, x) for _, k, x in rows if k in (2, 5, 7))
        pairs = [(r["a"], r["b"]) for r in got if r["b"] is not None]
        assert len(pairs) == 2 + 1 + 9 and all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
