"""Many files at once against the plain reader, files of every kind, and what stored texts make use of."""

import base64
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from cuboid.llm import webp, webp_batch

SF = "/root/testdata/sf0.001/documents.parquet"
#: A lossless file of one pixel that was made elsewhere, as web pages carry it to test a browser.
FOREIGN = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def pictures(seed=5):
    rng = np.random.default_rng(seed)
    for h, w in ((1, 1), (1, 16), (3, 16), (64, 16), (5, 7), (2, 200)):
        yield rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
    yield np.zeros((4, 16, 4), np.uint8)
    yield np.full((1, 1, 4), 7, np.uint8)
    yield rng.integers(0, 2, (20, 16, 4)).astype(np.uint8)
    yield np.repeat(rng.integers(0, 256, (1, 16, 4)), 30, axis=0).astype(np.uint8)
    yield np.cumsum(rng.integers(-1, 2, (40, 16, 4)), axis=0).astype(np.uint8)
    green = rng.integers(0, 256, (64, 16, 1))
    yield np.concatenate([green + rng.integers(0, 3, (64, 16, 1)), green, green + rng.integers(0, 3, (64, 16, 1)), np.full_like(green, 255)], axis=2).astype(np.uint8)
    signed = green.astype(np.uint8).astype(np.int8).astype(np.int64)
    yield np.concatenate([20 * signed >> 5, green, -25 * signed >> 5, np.full_like(green, 255)], axis=2).astype(np.uint8)
    yield rng.choice(np.array([[1, 2, 3, 4], [250, 0, 9, 255], [0, 0, 0, 0]], np.uint8), (17, 16))


def test_files_are_what_was_written():
    made = list(pictures())
    files, kinds = webp_batch.write_images(made)
    assert set(kinds.tolist()) == {-1, webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE}
    for picture, file, back in zip(made, files, webp_batch.read_images(files)):
        assert (webp.read_image(file) == picture).all() and (back == picture).all()
        assert len(file) <= len(webp.flat(picture)) * 1.1 + 64


def test_files_of_every_kind_are_read_together():
    made, files = [], []
    ways = [(), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN), (webp.SUBTRACT_GREEN, webp.PREDICTOR)]
    for k, picture in enumerate(pictures(6)):
        for j, way in enumerate(ways):
            made.append(picture)
            files.append(webp.full(picture, way, 2 + j % 3, (k + j) % 14, (0, 1, 7, 11)[(k + j) % 4], bool(k % 2), (0, 0, 2)[(k + j) % 3]))
        if len(np.unique(webp._argb(picture.reshape(-1, 4)))) <= 256:
            made.append(picture)
            files.append(webp.full(picture, (webp.PALETTE,), 2, 3, 5, True))
    for picture, back in zip(made, webp_batch.read_images(files)):
        assert (back == picture).all()


def test_every_predictor():
    picture = np.cumsum(np.random.default_rng(8).integers(-3, 4, (16, 16, 4)), axis=1).astype(np.uint8)
    files = [webp.full(picture, (webp.PREDICTOR,), 9, mode) for mode in range(14)]
    assert all((x == picture).all() for x in webp_batch.read_images(files))


def test_a_file_made_elsewhere():
    one = webp.read_image(FOREIGN)
    assert one.shape == (1, 1, 4) and (webp_batch.read_images([FOREIGN])[0] == one).all()


def test_broken_files_are_refused():
    files, _ = webp_batch.write_images(list(pictures())[:4])
    for bad in (b"", files[0][:10], b"RIFX" + files[0][4:], files[3][: len(files[3]) // 2], files[3][:20] + b"\0" + files[3][21:]):
        with pytest.raises((ValueError, IndexError)) as said:
            webp_batch.read_images([files[1], bad])
        assert said.type is ValueError or said.type is IndexError and not bad


def test_codes_are_complete():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 4, (60, 300)) ** 6 * (rng.random((60, 300)) < rng.random((60, 1)))
    counts[:3] = 0
    counts[1, 5], counts[2, 7], counts[2, 9] = 3, 1, 100_000
    for longest in (15, 9):
        lengths = webp_batch.code_lengths(counts, longest)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= longest
        for row in lengths[(counts > 0).sum(axis=1) > 1]:
            assert sum(2.0 ** -x for x in row[row > 0].tolist()) == 1


def test_what_stored_texts_make_use_of():
    payloads = [webp.payload((t or "").encode()) for t in pq.read_table(SF)["text"].to_pylist()]
    made = [np.frombuffer(p, np.uint8).reshape(-1, webp.ROW, 4)[at : at + webp.HIGHEST] for p in payloads for at in range(0, len(p) // webp.BLOCK, webp.HIGHEST)]
    files, kinds = webp_batch.write_images(made)
    assert (kinds == webp.PALETTE).any() and (kinds == -1).any()
    images = webp_batch._Images([webp._argb(p.reshape(-1, 4)[:, [3, 0, 1, 2]]) for p in made], [webp.ROW] * len(made), [True] * len(made), [(0, 1)] * len(made))
    assert images._copies()[1].sum() > 0 and images._cached()[1].any()
    stored = webp.store_many(payloads)
    assert b"".join(stored) == b"".join(files) and [x.tobytes() for x in webp.load_many(stored)] == payloads
    assert sum(map(len, stored)) < 0.7 * sum(map(len, payloads))


@pytest.mark.parametrize("text", ["", "a", "some words " * 300, "é" * 70])
def test_feature_is_the_plain_one(text):
    data = webp.payload(text.encode())
    channels = [list(data[k::4]) for k in range(4)]
    mean = [sum(c) / len(c) for c in channels]
    dev = [(sum((x - m) ** 2 for x in c) / len(c)) ** 0.5 for c, m in zip(channels, mean)]
    shares = [data.count(bytes([b])) / len(data) for b in set(data)]
    entropy = sum(s * math.log2(1 / s) for s in shares)
    height, numbers = webp.feature(webp.load(webp.store(data))).split(":")
    assert int(height) == len(data) // 64
    assert [float(x) for x in numbers.split(",")] == pytest.approx([*mean, *dev, entropy], abs=6e-4)
