"""Language identification, the language model and the HTML labeller: against plain versions and held-out rows."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cuboid.llm import brown_lm, html_extract, langid
from cuboid.llm.html_blocks import blocks

SYLLABLES = {"en": "the and of er in on tion ing ed".split(), "fr": "le de la eux ou ment que é ai".split(), "de": "der ung sch ein ich ü be ver".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 80)), lang if rng.random() < 0.9 else None) for i in range(400)]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"] and r["text"] and r["doc_id"] < 1000]
    assert len(held) > 50 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= g["score"] <= 1
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}


def test_language_needs_no_labels_to_run(docs):
    from pyspark.sql import functions as F

    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none, langid.fit(none)).collect()} == {"und"}


def test_held_out_labels_are_not_read(docs):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    pick = lambda d: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.identify(d, langid.fit(d)).collect())
    assert pick(other) == pick(docs)


def test_kernel_is_presence():
    # a; _a, aa, a_; _aa, aa_
    assert len(set(langid.grams("aa"))) == 6 and set(langid.grams("aa 1aa")) > set(langid.grams("aa")) == set(langid.grams("AA"))
    assert len(langid.grams("12 ?")) == 0


@pytest.mark.parametrize("head", [200_000, 30])
def test_language_model(docs, monkeypatch, head):
    monkeypatch.setattr(brown_lm.head_of, "__defaults__", (head,))
    got = {r["doc_id"]: r for r in brown_lm.scored(docs).collect()}
    count, rows = Counter(), docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    for r in rows:
        if not held(r["doc_id"]):
            count.update(tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    gain = 0
    for r in rows:
        g, own = got[r["doc_id"]], tokens(r["text"])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert math.isclose(g["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r["doc_id"]), len(own), sum(count[w] > 0 for w in own), n)
        assert g["score"] < 0
        gain += (g["score"] - base) * g["held_out"]
    if head > 1000:
        assert gain > 0  # classes explain held-out texts better than single words


def test_probabilities_add_up(spark, docs):
    counts = brown_lm.counted(docs)
    head = brown_lm.head_of(counts, 40)
    held = spark.sparkContext.broadcast(head)
    model = brown_lm.Model(head, brown_lm.bigrams(docs, held))
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    by = np.zeros(len(model.transitions))
    np.add.at(by, model.classes[: len(head.counts)], 10 ** model.emissions[: len(head.counts)])
    used = np.unique(model.classes[: len(head.counts)])
    assert np.allclose(by[used], 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    kinds = np.arange(60) % 4
    table = rng.poisson(np.where((kinds[:, None] + 1) % 4 == kinds[None, :], 20, 0.2))
    label = brown_lm.exchange(table, 60, 4, 10)
    assert all(len(set(label[kinds == k])) == 1 for k in range(4)) and len(set(label)) == 4


# --- pages -----------------------------------------------------------------------------------------


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:"</p>"}</style><script>if(a<b)"</p>"</script></head>
    <body><!-- c <p>x</p> --><p>A &amp; B&nbsp;<b>bo</b>ld<br>next<p>two<ul><li>i<li>j <a href="/x>y">link</a></ul></div>tail &lt;p&gt; 1 < 2"""
    assert [b.text for b in blocks(page)] == ["A & B bold next", "two", "i", "j link", "tail <p> 1 < 2"]
    got = blocks(page)
    assert got[3].linked == 4 and [t for t, _ in got[3].path] == ["html", "body", "ul", "li"]
    assert [b.text for b in blocks("<td>a<td>b<tr><td>c")] == ["a", "b", "c"]
    assert [(b.text, [t for t, _ in b.path]) for b in blocks("<h3>a</h2><p>b</p><h2>c<h4>d</h4>e")] == [("a", ["h3"]), ("b", ["p"]), ("c", ["h2"]), ("d", ["h4"]), ("e", [])]
    assert blocks("") == [] and blocks("<p></p>") == [] and [b.text for b in blocks("<!-- open")] == []
    assert blocks('<div class="adBanner top_x" id=Side>z</div>')[0].path[-1] == ("div", ("ad", "banner", "top", "x", "side"))
    for odd in ("<" * 50_000, "<a " * 20_000, "<p a='" * 5_000, "&" * 50_000, "<div>" * 3_000 + "x"):
        blocks(odd)


@pytest.fixture(scope="module")
def model():
    return html_extract.train([])


def test_held_out_layouts(model):
    pages, labels = html_extract._built(77, 300)
    vectors = html_extract.Vectors()
    probs = model.predict([vectors.of(p) for p in pages])
    right = np.concatenate([(p >= 0.5) == (y > 0.5) for p, y in zip(probs, labels)])
    assert right.mean() > 0.99


def test_batches_do_not_change_labels(model):
    pages, _ = html_extract._built(78, 40)
    vectors = html_extract.Vectors()
    x = [vectors.of(p) for p in pages]
    together = model.predict(x)
    assert all(np.allclose(model.predict([a])[0], b, atol=1e-4) for a, b in zip(x, together))


def test_gradient():
    rng = np.random.default_rng(3)
    m = html_extract.Labeller(1, 3)
    pages = [rng.standard_normal((n, html_extract.DIM)).astype(np.float32) * 0.1 for n in (4, 2)]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]

    def loss():
        probs = m.predict(pages)
        return -np.mean(np.concatenate([np.log(np.where(y > 0, p, 1 - p)) for p, y in zip(probs, labels)]))

    before = loss()
    m.train(pages, labels, epochs=30, rate=0.02)
    assert loss() < before * 0.5


def test_article_of_a_plain_page(model):
    page = "<html><body><nav><ul><li><a href='/a'>home</a></li><li><a href='/b'>news</a></li></ul></nav><article><h1>Title of it</h1><p>First words of the text, with more to come.</p><p>Then others follow, and end.</p></article><div class='comments'><p>I like this text, really.</p></div><footer>&copy; someone</footer></body></html>"
    want = "Title of it First words of the text, with more to come. Then others follow, and end."
    assert html_extract.main_text(page, model, html_extract.Vectors()) == want


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages, html_extract.fit(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        g = got[r["page_id"]]
        assert (g["text"], g["url"], g["n_chars"]) == (want, r["url"], len(want))


def test_language_of_nothing_learned(spark):
    """Other scripts, other spellings and letter noise are dropped; held-out texts of learned languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    held = docs.where("lang IS NOT NULL AND text IS NOT NULL").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").select("doc_id", "text")
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(20)]
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar."]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise + other)], "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.known(held.unionByName(more), model).collect()}
    assert all(i >= 0 for i in kept) and len(kept) >= 0.99 * held.count()
