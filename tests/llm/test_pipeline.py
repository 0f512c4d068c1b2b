"""The pipeline: each stage against a plain version over its own input."""

import os
import zlib

import pytest

from cuboid.llm import decontam, langid, pii, queries


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9000, None, None, "s", None), (9001, "12 34", "en", "s", 5), (9002, "", "en", "s", 0)], docs.schema)
    inputs = [docs.unionByName(extra)]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(stage(spark, inputs[-1], "/root/testdata/sf0.001").cache())
    return inputs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.schema.names == stages[0].schema.names


def test_language(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(before) - set(after) == {9000, 9001, 9002} and all(after[i] == before[i] for i in after)


def test_near_duplicates(stages):
    """The stage's rule: five-word shingles of similarity 0.8 or more link two texts, by all pairs."""
    before, after = texts(stages[1]), texts(stages[2])
    sets, root = {}, {i: i for i in before}
    for i, t in before.items():
        listed = (t or "").encode().lower().split()
        sets[i] = {tuple(listed[k : k + 5]) for k in range(max(1, len(listed) - 4))} if listed else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in sets if find(i) == i} and len(after) < len(before)


def test_decontamination(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [decontam.words(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]

    def held(text):
        listed = decontam.words(text or "")
        grams = {tuple(listed[i : i + 5]) for i in range(len(listed) - 4)}
        return any(sum(tuple(x[i : i + 5]) in grams for i in range(len(x) - 4)) >= 0.8 * (len(x) - 4) for x in items)

    assert set(after) == {i for i, t in before.items() if not held(t)} and len(after) < len(before)


def test_personal_data(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after) and any(before[i] != after[i] for i in before)
    for i, t in before.items():
        assert after[i] == pii.redacted(t) and not pii.base_spans(after[i])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing(stages):
    got = stages[5].collect()
    assert {r["doc_id"] for r in got} == set(texts(stages[4]))
    sums = {}
    for r in got:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert all(sums[r["doc_id"]] == r["doc_tokens"] for r in got)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_run(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in stages[5].collect()}


def test_every_operator_has_a_query():
    found = queries.queries()
    assert {n.split("_")[0] for n in found} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(found)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_cases_of_a_whole_run(spark, tmp_path):
    """Repeated and null rows, a very long text, columns with names of the operators' own; and no rows at all."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    bench = spark.read.parquet(f"{source}/benchmark.parquet")
    some = docs.limit(60)
    text = max((r["text"] for r in some.collect() if r["text"]), key=len)
    rows = [(9100, (text + " ") * 40, "en", "s", 1), (9101, None, None, None, None), (9102, "x", None, "s", 1), (9103, "", "en", "s", 0)]
    clash = some.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(some.limit(5))
    clash = clash.selectExpr("*", "1 AS component_id", "'a' AS `key`", "2 AS copy", "3 AS n", "'b' AS spans", "4 AS score")
    for name, frame in (("full", clash), ("empty", clash.limit(0))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path / name))
            assert kept.columns == frame.columns
        shared = spark.conf.get("spark.checkpoint.dir")
        tables = set(os.listdir(shared))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        stages = [x for x, _ in corpus_pipeline.STAGES]
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - tables} & set(stages) == {"personal_data"}
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert (len(got) > 0) == (name == "full")
        pieces = {}
        for r in got:
            pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        assert all(pieces[r["doc_id"]] == r["doc_tokens"] for r in got)
