"""License scans against a plain matcher with the same rules: every match, priorities, containment, labels and score."""

import random
import re

from test_texts import plain_base, samples

from cuboid.llm import license_rules, license_scan


def plain(text):
    """Labels and score: all rules over the whole text, without keywords; then each detection against all others."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = f" {' '.join(words)} "
    found = {(m.start(), m.end(), p, label) for label, _, pattern, p in license_scan.RULES for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line)}
    kept = []
    for a, b, p, label in found:
        inside = any(x <= a and b <= y and (q > p or q == p and (x, y) != (a, b)) for x, y, q, _ in found)
        if not inside:
            kept.append((p, label))
    base = set(filter(None, plain_base(text)[4].split(",")))
    best = max([p for p, _ in kept] + [2] * bool(base), default=0)
    return ",".join(sorted({label for _, label in kept} | base)), best / license_scan.TOP


def test_scan_is_the_plain_one(spark):
    """Every rule's wordings, alone, side by side and run into one another, with other marks and case between the words."""
    rng, texts = random.Random(11), []
    own = [rng.choice(samples(pattern)) for _, _, pattern, _ in license_scan.RULES]
    mix = lambda t: "".join(rng.choice((" ", " ", "\n", ", ", "-", ". (")) if c == " " else c.upper() if rng.random() < 0.1 else c for c in t)
    texts += [mix(t) for t in own]
    for _ in range(150):
        parts = rng.sample(own, rng.randint(2, 6)) + ["plain words", "é"] * rng.randint(0, 2)
        rng.shuffle(parts)
        texts.append(mix(rng.choice((" ", " x ", "")).join(parts)))
    texts += [t[: len(t) // 2] for t in own[::7]] + ["", "words only"]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["labels"], round(got[i]["score"], 9)) == (plain(t)[0], round(plain(t)[1], 9)), t


def test_hand_written_signatures():
    lines = license_rules.signatures()
    assert len({p for _, _, p, _ in lines}) == len(lines) >= 200
    assert all(1 <= p <= 5 for *_, p in lines)
