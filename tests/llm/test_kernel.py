"""The kernel, its Nystroem map and the scores against a plain version; and many languages."""

import numpy as np
import pyarrow as pa

from cuboid.llm import langid


def plain_grams(text):
    """n-grams of the folded text as tuples of symbols, by the letters one after another."""
    fold = lambda c: 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37
    s = [0]
    for c in text.lower() + " ":
        if fold(c) or s[-1]:
            s.append(fold(c))
    if len(s) < 2:
        return set()
    out = {(x,) for x in s if x}
    return out | {tuple(s[i : i + n]) for n in (2, 3) for i in range(len(s) - n + 1)}


def made(rng, k, n):
    letters = list("abcdefghijklmnopqrstuvwxyzéüñ")
    own = np.random.default_rng(k).permutation(len(letters))[:9]
    return " ".join("".join(letters[i] for i in rng.choice(own, rng.integers(2, 7))) for _ in range(n))


def test_scores_are_a_plain_regressions():
    rng = np.random.default_rng(1)
    langs = [f"l{k}" for k in range(4) for _ in range(12)]
    texts = [made(rng, int(x[1:]), 30) for x in langs]
    model = langid.Model([np.unique(langid.grams(t)) for t in texts], langs, landmarks=20, ridge=1e-3)
    sets = [plain_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    # Landmarks are dealt over the languages in turn, by their order.
    place = [langs[:i].count(langs[i]) for i in range(len(langs))]
    chosen = sorted(range(len(langs)), key=lambda i: (place[i], i))[:20]
    columns = set.union(*(sets[i] for i in chosen))
    k = np.array([[kernel(a, sets[j]) for j in chosen] for a in sets])
    values, vectors = np.linalg.eigh(k[chosen])
    root = (vectors / np.sqrt(values))[:, values > values.max() * 1e-6]
    names = sorted(set(langs))
    target = np.array([[float(x == n) for n in names] for x in langs])
    phi = k @ root
    weights = np.linalg.solve(phi.T @ phi + 1e-3 * len(texts) * np.eye(phi.shape[1]), phi.T @ (target - target.mean(axis=0)))
    new = [made(rng, i % 4, n) for i, n in enumerate((1, 3, 10, 200))] + ["Mixed CASE é ü 12 -- ñ", "zzz"]
    got = model.predict(pa.array(new))
    assert columns
    for t, (lang, score) in zip(new, got):
        own = plain_grams(t)
        want = np.array([kernel(own, sets[j]) for j in chosen]) @ root @ weights + target.mean(axis=0)
        best = int(want.argmax())
        assert abs(score - min(1, max(0, want[best]))) < 1e-3
        assert lang == names[best] or np.sort(want)[-1] - np.sort(want)[-2] < 1e-3


def test_more_languages_than_landmarks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, made(rng, i % 260, 25), f"l{i % 260:03d}") for i in range(260 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 260 and model.landmarks.shape[1] >= 260
    held = [r for r in langid.identify(docs, model).collect() if r["held_out"]]
    right = np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held])
    assert right > 0.8 and len({r["lang_pred"] for r in held}) > 200
