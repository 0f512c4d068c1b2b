import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuboid.llm import suffix_dedup
from cuboid.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=25) | st.text("ab", max_size=25).map(str.encode), min_size=1, max_size=6), st.sampled_from([1, 3, 8, 9, 20, 50]))
def test_suffix_array(texts, depth):
    order, s, left = suffix_array(texts, depth)
    suffixes = [t[i:] for t in texts for i in range(len(t) + 1)]
    assert sorted(order.tolist()) == list(range(len(suffixes)))
    keys = [suffixes[p][:depth] for p in order]
    assert keys == sorted(keys)
    same = common_prefixes(order, s, left, depth)
    assert same.tolist() == [i > 0 and len(suffixes[order[i]]) >= depth and keys[i] == keys[i - 1] for i in range(len(order))]


def plain(rows, n=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - n + 1):
                least[b[i : i + n]] = min(d, least.get(b[i : i + n], d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - n + 1):
                if least[b[i : i + n]] < d:
                    gone[i : i + n] = b"\1" * n
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out.append((str(d), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd \n") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(200):
        text = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 350)
            text += rng.choice(base)[a : a + rng.randint(20, 120)] if rng.random() < 0.7 else "".join(rng.choice("abcd é\x00") for _ in range(rng.randint(0, 200)))
        rows.append((rng.choice([None, i, i, i]), text))
    line = "a very common line that stands in many of the documents, word for word"
    rows += [(1000 + i, f"{rng.random()} {line} {rng.random()}") for i in range(60)]
    for i in range(40):  # periods, which have one context at many places
        word = rng.choice(["Are, ", "Erverzu ", "ab", "!! THE!! REAT"])
        rows.append((2000 + i, f"{rng.random()} " * rng.randint(0, 2) + word * rng.randint(5, 40) + f" {rng.random()}" * rng.randint(0, 2)))
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "ab" * 100), (503, "ba" * 60), (500, "a" * 300), (500, "zz" + "a" * 70), (504, None), (505, "x" * 49)]
    return rows


@pytest.mark.parametrize("hot", [{}, {"hot": 8, "share": 1}])
def test_removed_bytes(spark, hot):
    rows = corpus()
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), **hot).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows)


def test_texts_longer_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 256)
    suffix_dedup._tables.clear()
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh") for _ in range(3000))
    texts = [a, a[200:2100] + a[:150], a[::-1]]
    found = []
    for t in texts:
        data = t.encode()
        groups = {}
        for group, start, length, *_ in suffix_dedup.anchors(data):
            for g, s, n in zip(group.tolist(), start.tolist(), length.tolist()):
                groups.setdefault(g, set()).update(data[i : i + 50] for i in range(s, s + n - 49))
        found.append(groups)
        covered = set().union(*groups.values())
        assert covered == {data[i : i + 50] for i in range(len(data) - 49)}
    # Windows that two texts share stand around an anchor that both have.
    for x in range(3):
        for y in range(x):
            shared = {texts[x].encode()[i : i + 50] for i in range(len(texts[x]) - 49)} & {texts[y].encode()[i : i + 50] for i in range(len(texts[y]) - 49)}
            met = set().union(*(found[x][g] & found[y][g] for g in found[x].keys() & found[y].keys()), set())
            assert shared <= met
    suffix_dedup._tables.clear()


def test_united():
    import numpy as np

    a, b = suffix_dedup.united(np.array([5, 0, 3, 20]), np.array([9, 2, 5, 30]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 2), (3, 9), (20, 30)]


def test_equal_hashes_of_different_contexts(spark, monkeypatch):
    """With four bits of a context's hash, a task still removes what is repeated and no more."""
    rng = random.Random(12)
    shared = [bytes(rng.randrange(97, 100) for _ in range(70)) for _ in range(3)]
    texts = [b" ".join(rng.choice([*shared, bytes(rng.randrange(97, 100) for _ in range(120))]) for _ in range(4)) for _ in range(60)]
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    whole = suffix_dedup.anchors

    def short(text):
        for keys, start, length, context, around in whole(text):
            yield keys, start, length, context & np.uint64(15), around

    monkeypatch.setattr(suffix_dedup, "anchors", short)
    listed = [(i, i, t) for i, t in enumerate(texts)]
    data = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "key", "text"])
    found = [np.frombuffer(x["spans"], "<u4").reshape(-1, 2).tolist() + [x["doc_id"]] for b in suffix_dedup._find(4, np.zeros(0, np.uint64))([data]) for x in b.to_pylist() if x["spans"]]
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 49):
            seen.setdefault(t[at : at + 50], i)
    for *spans, i in found:
        for a, b in spans:
            assert all(seen[texts[i][at : at + 50]] < i for at in range(a, b - 49))
    assert found
