"""Cases that every operator must stand: nulls, empty and very long texts, repeats, clashing columns, empty tables."""

import pytest

from cuboid.llm import brown_lm, common, decontam, html_extract, langid, license_scan, packing, pii, simhash, suffix_dedup, webp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox " * 60_000


def rows():
    out = [(i, f"plain words number {i} in a short text of its own", "en" if i % 2 else "fr", "s", 50) for i in range(12)]
    out += [(20, None, None, None, None), (21, "", "en", None, 0), (22, " \n\t ", "en", "s", 3), (23, LONG, "en", "s", len(LONG)), (24, LONG + "end", "en", "s", None)]
    out += [(None, "a text without an id", "en", "s", 1), (30, "same row", "en", "s", 8), (30, "same row", "en", "s", 8), (31, "x" * 300_000, None, "s", 1), (32, "é\x00ß 漢字 \U0001f600", "de", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


#: Names that operators use within themselves.
CLASH = "fp row key bucket words start length spans score component_id rep n word times held_out lang_pred __kept".split()


@pytest.fixture(scope="module")
def wide(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one question of seven words stands here? and this is its answer in words"), (2, None), (3, ""), (None, "an item without id but words enough to match")], "item_id long, text string")


def ops(bench):
    return {
        "pii": pii.detect,
        "language": lambda d: langid.identify(d, langid.fit(d)),
        "simhash": simhash.near_duplicates,
        "suffix": suffix_dedup.deduplicated,
        "brown": brown_lm.scored,
        "licenses": license_scan.scan,
        "packing": packing.pack,
        "contaminated": lambda d: decontam.contaminated(d, bench),
        "webp": webp.media_columns,
    }


NAMES = list(ops(None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, bench, name):
    got = ops(bench)[name](docs).collect()
    if name == "contaminated":
        assert got == []
    elif name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows()}
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_change_nothing(docs, wide, bench, name):
    op = ops(bench)[name]
    drop = {"sequence_id", "offset", "start", "length", "ids_crc32"} if name == "packing" else set()
    key = lambda r: str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k not in drop})
    assert sorted(map(key, op(wide).collect())) == sorted(map(key, op(docs).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, bench, name):
    assert ops(bench)[name](docs.where("1 = 0")).collect() == []


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "uncontaminated", "redact"])
def test_filters_keep_columns(wide, bench, stage):
    run = {"language": lambda d: langid.known(d, langid.fit(d)), "near_duplicates": simhash.deduplicated, "uncontaminated": lambda d: decontam.uncontaminated(d, bench), "redact": pii.redact}[stage]
    got = run(wide)
    assert got.columns == wide.columns and got.count() > 0
    assert run(wide.where("1 = 0")).count() == 0


def test_pages_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<article><p>words of an article stand here, and more.</p></article>"), (4, "u", "<p>" * 5000 + "deep"), (4, "u", "<p>" * 5000 + "deep")], "page_id long, url string, html string")
    model = html_extract.fit(pages)
    got = html_extract.extract(pages, model).collect()
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""] and len(got) == 5
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(pages.where("1 = 0"), html_extract.fit(pages.where("1 = 0"))).count() == 0


def test_empty_benchmark(docs, bench):
    assert decontam.contaminated(docs, bench.where("1 = 0")).count() == 0
    assert decontam.uncontaminated(docs, bench.where("1 = 0")).count() == docs.count()


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
