"""The pipeline and the queries over empty tables, repeated and null ids, very long texts and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

from metrika.llm import jaccard_join, quality, registry, secret_scan

from .test_odd_tables import CLASH, DOCS, clashing
from .test_operators import prose

PAGES = "page_id long, url string, html string"
CLICKS = "click_id long, ts timestamp, arrived_at timestamp, client_id long, kind string, value double, props string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def write(spark, folder, documents, items=(), labels=()):
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, columns in (("pages", PAGES), ("clicks", CLICKS), ("embeddings", EMBEDDINGS)):
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), spark.createDataFrame([], DOCS + ", n_chars long"))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_of_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_pipeline_of_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, item, long = prose(rng, 90), prose(rng, 90), prose(rng, 20), prose(rng, 30_000)
    # an id with two texts, a row twice, a null id, null and empty texts, a long text and its copy
    rows = [(1, a), (1, b), (2, a), (2, a), (None, prose(rng, 50)), (None, None), (3, None), (4, ""), (5, long), (6, long + " end"), (7, f"{long[: len(long) // 3]} {item} more"), (8, "x" * 50_000)]
    docs = clashing(spark.createDataFrame([(*r, "en", "s") for r in rows], DOCS))
    folder = write(spark, tmp_path / "t", docs, [(1, item)], [(1, 1, 0)])
    kept, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        found = now.collect()
        assert all(r[n] == v for r in found for n, v in CLASH.items())
        kept.append(sorted((r["doc_id"] or 0, r["text"]) for r in found))
    texts = [{t for _, t in k} for k in kept]
    assert texts[0] == {a, b, rows[4][1], long, long + " end", rows[10][1]}
    # one row of each group stays: a's of three rows, and the long text or its near copy
    assert texts[1] >= {a, b, rows[4][1], rows[10][1]} and len(kept[1]) == 5
    assert texts[2] == texts[1] - {rows[10][1]} and kept[3] == kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert len({r["doc_id"] for r in packed}) == len({i for i, _ in kept[3]})
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def test_secrets_of_long_and_repeated_rows(spark, tmp_path):
    rng = random.Random(13)
    long = prose(rng, 40_000) + " password = hunter2hunter " + "f" * 40 + " " + prose(rng, 10_000)
    docs = clashing(spark.createDataFrame([(1, long, "en", "s"), (1, long, "en", "s"), (None, "token: abcdefgh9", "en", "s")], DOCS))
    folder = write(spark, tmp_path / "s", docs)
    found = registry.QUERIES[next(n for n in registry.QUERIES if n.startswith("op10_"))](spark, folder).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"]) for r in found) == [(0, 1, 0, 0), (1, 1, 0, 1), (1, 1, 0, 1)]
    at = long.index("hunter2hunter")
    assert all(f"assign:{at}:{at + 13}" in r["spans"] or f"assign:{at - 11}:{at + 13}" in r["spans"] for r in found if r["doc_id"])
    assert secret_scan.mask_documents(docs).columns == docs.columns


def test_rules_count_repeated_rows(spark):
    rng = random.Random(14)
    text = prose(rng, 60)
    docs = spark.createDataFrame([(1, text, "en", "s"), (1, text, "en", "s"), (2, None, "en", "s")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.judge(spark, docs, labels).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in found) == [(1, 60, True), (1, 60, True), (2, 0, False)]


def test_links_of_a_very_long_text(spark):
    rng = random.Random(15)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long + " one more"), (3, prose(rng, 60_000)), (4, " ".join(long.split()[:20_000]))]
    docs = clashing(spark.createDataFrame([(*r, "en", "s") for r in rows], DOCS))
    left = jaccard_join.filter_documents(spark, docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select(F.col("doc_id")).collect()} == {1, 3, 4}
