"""Licenses, packing, decontamination, media: against plain versions and round trips."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cuboid.llm import decontam, license_scan, packing, webp

# --- licenses --------------------------------------------------------------------------------------


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    rng = random.Random(1)
    parts = "gnu general public license apache mit CC by Cc-BY License\nMIT GNU General é x1 ,. ÉT".split(" ")
    rows = [(i, rng.choice(["", ". ", " "]).join(["", *(rng.choice(parts) + rng.choice([" ", "-", ", "]) for _ in range(rng.randint(0, 25)))])) for i in range(300)] + [(300, None), (301, "mit license " * 3 + "cc by cc by")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == plain_base(t), t
        assert 0 <= g["score"] <= 1 and set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(","))


def test_license_rules(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
        "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of": "mit",
        "Copyright (c) 2019 someone. All rights reserved.": "all-rights-reserved,copyright-notice",
        "SPDX-License-Identifier: Apache-2.0": "spdx",
        "GNU General Public License v2 or later": "gpl,gpl-2.0-or-later",
        "a licence to nothing": "",
    }
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(cases.values()))
    assert len(license_scan.RULES) > 200 and all(re.compile(r[2]) for r in license_scan.RULES)


def samples(pattern):
    """Texts that an expression matches: each branch, each optional part with and without."""
    parser = re._parser

    def of(parts):
        out = [""]
        for op, x in parts:
            if op is parser.LITERAL:
                own = [chr(x)]
            elif op is parser.ANY:
                own = ["x"]
            elif op is parser.IN:
                own = [chr(v if k is parser.LITERAL else v[0]) for k, v in x[:2]]
            elif op is parser.BRANCH:
                own = [t for branch in x[1] for t in of(branch)]
            elif op is parser.SUBPATTERN:
                own = of(x[3])
            else:
                low, high, inner = x
                own = [t * n for n in {low, min(high, low + 1)} for t in of(inner)]
            out = [a + b for a in out for b in own]
            if len(out) > 500:  # the first ones, and some of each later form
                out = out[:: len(out) // 250]
        return out

    return of(parser.parse(pattern))


def test_every_rule_passes_the_gate():
    for label, word, pattern, _ in license_scan.RULES:
        for text in samples(pattern):
            assert re.fullmatch(pattern, text), (pattern, text)
            assert word in f" {text} " and any(x in f" {text} " for x in license_scan.PREFILTER), (label, text)


def test_notices_of_few_words(spark):
    cases = {
        "BSD 3-Clause": "bsd-3-clause", "Simplified BSD": "bsd-2-clause", "new BSD": "bsd-3-clause", "the original BSD": "bsd-4-clause",
        "CDDL, version 1.0": "cddl-1.0", "MIT No Attribution": "mit-0", "OpenRAIL-M": "rail", "Proprietary and confidential.": "proprietary",
        "Altered source versions must be plainly marked as such": "zlib",
        "Neither the name of the owner may be used to endorse or promote products": "bsd-3-clause",
    }
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(cases))] == list(cases.values()) and all(r["score"] > 0 for r in got.values())


# --- packing ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def test_tokens_are_the_tokenizers(encoder):
    import pyarrow as pa

    texts = ["Hello  World's 123 é́x <|endoftext|> a<|startoftext|>b <|endof text|>", "\u0085a b c　d\x1ce​f", "ß İ Ａ ǆ don't. 'S. <|ENDOFTEXT|> ΟΔΟΣ ΣΑΣ.", "한 क़ क़x é", "a.b ..! !?x. ...", "", " ", None, "O'Neill'LL we'Ve", "x" * 3000]
    rng = random.Random(2)
    texts += ["".join(rng.choice("aAbé.,'!? \n09ßΣ<|>́-") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for _ in range(2):  # from the table, too
        got = encoder.encode(pa.array(texts, pa.string()))
        for t, ids in zip(texts, got):
            assert ids.tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], t


def test_fill_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(300):
        counts = defaultdict(int)
        for _ in range(rng.randint(0, 8)):
            counts[rng.randint(1, 40)] += 1
        target = rng.randint(0, 90)
        chosen, slack = packing.fill(dict(counts), target)
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= target)
        assert sum(n * k for n, k in chosen.items()) == target - slack == best and all(k <= counts[n] for n, k in chosen.items())


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_windows_are_full(n):
    rng = random.Random(4)
    docs = [np.arange(rng.choice([1, 7, 300, 2048, 5000])) for _ in range(n)]
    packer = packing.Packer()
    windows = [w for i, ids in enumerate(docs) for w in packer.add(i, ids)] + list(packer.end())
    got = defaultdict(list)
    sizes = []
    for w in windows:
        sizes.append(sum(len(ids) for *_, ids in w))
        for doc, start, ids in w:
            assert len(ids)
            got[doc].append((start, ids))
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes) and sum(s < 2048 for s in sizes) <= 11
    for i, ids in enumerate(docs):
        assert np.array_equal(np.concatenate([x for _, x in sorted(got[i], key=lambda x: x[0])]), ids)


def test_pieces(spark, encoder):
    rows = [(i, "some words of text, " * (i % 700)) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


# --- decontamination -------------------------------------------------------------------------------


def test_every_item_that_stands_in_a_text_is_found():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 30
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([1, 4, 12, 40, 300])))) for i in range(40)]
    index = decontam.Index(items)
    wanted = {i: decontam.words(t) for i, t in items}
    for _ in range(150):
        text = draw(rng.choice([0, 3, 50, 900]))
        for _ in range(rng.randint(0, 2)):
            own = [w.decode() for w in wanted[rng.randrange(40)]]
            if rng.random() < 0.4 and len(own) > 30:
                own[rng.randrange(len(own))] = "edited"
            at = rng.randint(0, len(text))
            text[at:at] = own
        got = {h[0] for h in index.search(" ".join(text))}
        listed = [w.encode() for w in text]
        for i, t in wanted.items():
            if len(t) > decontam.LONGEST:
                continue
            k = min(5, len(t))
            grams = [tuple(t[j : j + k]) for j in range(len(t) - k + 1)]
            spans = [set(map(tuple, (listed[j : j + k] for j in range(a, min(len(listed), a + len(t)) - k + 1)))) for a in range(max(1, len(listed) - len(t) + 1))] if len(listed) >= k else []
            best = max((sum(g in s for g in grams) / len(grams) for s in spans), default=0)
            if best == 1:
                assert i in got, (i, text)
            everywhere = {tuple(listed[j : j + k]) for j in range(len(listed) - k + 1)}
            if sum(g in everywhere for g in grams) / len(grams) < decontam.SHARE:
                assert i not in got


def test_share_alone_decides():
    """One-word edits, cut tails and insertions that leave 0.8 of the shingles: found; fewer: not."""
    rng, seen = random.Random(8), 0
    for size in (14, 30, 60, 131, 300):
        body = [f"t{rng.randrange(400)}" for _ in range(size)]
        item = " ".join(body[:-6]) + ". " + " ".join(body[-6:])
        index, grams = decontam.Index([(1, item)]), [tuple(body[j : j + 5]) for j in range(size - 4)]
        forms = [body[:-cut] for cut in range(1, 8)] + [[*body[:at], "edited", *body[at + 1 :]] for at in range(size)]
        forms += [[*body[:at], *["inserted"] * n, *body[at:]] for at in range(1, size, 3) for n in (1, 40, 2000)]
        for form in forms:
            text = ["before"] * rng.choice([0, 50, 700]) + form + ["behind"] * rng.choice([0, 50, 700])
            there = {tuple(text[j : j + 5]) for j in range(len(text) - 4)}
            got, held = index.search(" ".join(text)), sum(g in there for g in grams) >= 0.8 * len(grams)
            if size <= decontam.LONGEST:
                assert bool(got) == held, (size, form)
            elif held:
                assert got, (size, form)
            seen += held
            assert all(0 <= h[3] <= 1 and 0 <= h[4] <= 1 for h in got)
    assert seen > 500


def test_long_items_are_found(spark):
    rng = random.Random(6)
    item = " ".join(f"t{rng.randrange(500)}" for _ in range(400)) + ". The answer is five words long here."
    docs = spark.createDataFrame([(1, "x y z " * 300 + item + " a b c" * 200), (2, "x y z " * 500)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 200)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"before {t} behind") for i, t in items] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.indexes(spark, bench)) > 3
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}
    assert [r["doc_id"] for r in decontam.uncontaminated(docs, bench).collect()] == [99]


# --- media -----------------------------------------------------------------------------------------


def images():
    rng = np.random.default_rng(7)
    words = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 40, np.uint8)
    for h, w in ((1, 1), (3, 5), (16, 16), (20, 17), (1, 40)):
        yield words[: h * w * 4].reshape(h, w, 4)
        yield rng.integers(0, 256, (h, w, 4), np.uint8)
        yield rng.integers(0, 3, (h, w, 4)).astype(np.uint8) * 77
        yield (rng.integers(0, 2, (h, w, 1)) * np.array([[[3, 99, 200, 255]]])).astype(np.uint8)


@pytest.mark.parametrize("options", [(0, False, 0), (4, True, 0), (0, True, 2), (3, True, 2), (11, False, 3)])
def test_media_round_trips(options):
    cache, back, group = options
    for k, px in enumerate(images()):
        assert (webp.read_image(webp.flat(px)) == px).all()
        few = len(np.unique(px.reshape(-1, 4), axis=0)) <= 256
        for t in itertools.chain.from_iterable(itertools.permutations(range(4), n) for n in range(4)):
            if webp.PALETTE not in t or few and t[0] == webp.PALETTE:
                assert (webp.read_image(webp.full(px, t, 2, k % 14, cache, back, group)) == px).all()


def test_broken_media():
    good = webp.flat(next(images()))
    for bad in (b"", good[:15], b"x" + good[1:], good[:21], good[:20] + b"\x30" + good[21:]):
        with pytest.raises(ValueError):
            webp.read_image(bad)


def test_lengths_and_distances():
    for n in (1, 4, 5, 6, 7, 100, 4096, 1 << 20):
        symbol, extra, value = webp._prefix(n)
        w = webp.Writer()
        w.put(value, extra)
        assert webp._number(symbol, webp.Reader(w.bytes() or b"\0")) == n and symbol < 40


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "text " * 500), (5, "text " * 500), (6, "y" * (64 * 16384 + 1))]
    got = {r["doc_id"]: r for r in webp.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        want = data + bytes(-len(data) % 64 if data else 64)
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        media = webp.store(want)
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert [got[4][c] for c in ("media_sha256", "feature")] == [got[5][c] for c in ("media_sha256", "feature")]
