"""Operators over empty tables, repeated and null ids, very long texts and columns whose names clash."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.llm import decontaminate, language, packing, quality, secret_scan, substrings, token_files, toxicity, warc

from .test_operators import brute_removal, prose, word

DOCS = "doc_id long, text string, lang string, source string"
CLASH = {"N_WORDS": 7, "kept": 8, "rule_symbols_per_word": 9, "key": 10, "Score": 11, "part": 12, "rid": 13, "item": 14}


def clashing(df):
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_keeps_columns(spark, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60), "en", "s") for i in range(20)] + [(3, prose(rng, 60), "en", "s"), (None, prose(rng, 60), None, None), (30, "short", "en", "s")]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    left = quality.filter_documents(docs, labels)
    assert left.columns == docs.columns
    got = left.collect()
    assert len(got) == 22 and all(r[n] == v for r in got for n, v in CLASH.items())
    assert quality.judge(spark, none, labels).collect() == [] and quality.filter_documents(none, labels).collect() == []
    assert sorted(r["kept"] for r in quality.judge(spark, docs, labels).collect()) == [False] + [True] * 22


def test_warc_ids(spark, tmp_path):
    rng = random.Random(2)
    page = prose(rng, 400)
    rows = [(-5, "u", page), (-5, "u", page), (-9, "u", page), (None, "u", page), (4, None, None), (4, "u", "x")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = warc.read(spark, f"file://{tmp_path}/a", warc.write(pages, f"file://{tmp_path}/a")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found) == [(-9, "revisit", -5), (-5, "response", 0), (-5, "response", 0), (0, "response", 0), (4, "response", 0), (4, "response", 0)]
    empty = pages.limit(0)
    assert warc.read(spark, f"file://{tmp_path}/b", warc.write(empty, f"file://{tmp_path}/b")).collect() == []


def test_decontamination_odd_items(spark, none):
    rng = random.Random(5)
    a, b, c = (prose(rng, 30) for _ in range(3))
    items = clashing(spark.createDataFrame([(None, a), (None, b), (1, c), (1, c), (2, None)], "item_id long, text string"))
    long = prose(rng, 40_000)
    rows = [(1, f"{long} {a} {long}"), (2, b.upper()), (2, prose(rng, 50)), (None, c + " more"), (5, long), (6, None), (2, b.upper())]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = decontaminate.contained(spark, docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item"] or 0) for r in found) == [(0, 1), (1, 0), (2, 0)]
    left = decontaminate.filter_documents(spark, docs, items)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"] == long) for r in left.collect()) == [(2, False), (5, True), (6, False)]
    assert decontaminate.contained(spark, none, items).collect() == [] and decontaminate.contained(spark, docs, items.limit(0)).collect() == []


def test_substrings_long_text_and_columns(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 3000)
    monkeypatch.setattr(substrings, "TOGETHER", 5000)
    rng = random.Random(6)
    line = prose(rng, 30)
    texts = [prose(rng, 3000) for _ in range(2)]
    texts += [texts[0][1000:9000] + word(rng) + texts[1][:4000], line * 20] + [prose(rng, 40) + "\n" + line + "\n" + prose(rng, 40) for _ in range(30)]
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    got = substrings.remove(spark, docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removal(texts)


def test_packing_odd_tables(spark, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(spark, none, path).collect() == []
    rng = random.Random(4)
    rows = [(1, prose(rng, 700)), (1, prose(rng, 700)), (None, "a b"), (2, None), (2, ""), (3, prose(rng, 3000))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack(spark, docs, path).collect()
    places = {}
    for r in got:
        assert 0 < r["length"] <= 2048 and r["start"] == 2048 * r["piece"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():  # gapless from 0, at most 2048
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 2048) + 1


def test_token_files_odd_tables(spark, none, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = token_files.write(spark, none, f"file://{tmp_path}/a", path)
    assert token_files.read(spark, f"file://{tmp_path}/a", parts).collect() == []
    rng = random.Random(4)
    rows = [(1, prose(rng, 20_000)), (1, "b c"), (None, "a b"), (2, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = token_files.read(spark, f"file://{tmp_path}/b", token_files.write(spark, docs, f"file://{tmp_path}/b", path)).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2] and got[-1]["n_tokens"] == 1
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_masks_keep_columns(spark, none):
    rows = [(1, "password = abcdefgh12 " + "word " * 50_000), (1, "plain"), (None, None), (1, "plain")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = secret_scan.mask_documents(docs)
    assert got.columns == docs.columns
    assert sorted(hashlib.md5((r["text"] or "").encode()).hexdigest() for r in got.collect()) == sorted(hashlib.md5(t.encode()).hexdigest() for t in ("[SECRET] " + "word " * 50_000, "plain", "plain", ""))
    assert secret_scan.mask_documents(none).collect() == []


def test_toxicity_odd_tables(spark, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(none, labels)
    rows = [(None, "x"), (1, None), (1, "y"), (2, "word " * 50_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = toxicity.score_documents(docs, model, ["doc_id", "kept"]).collect()
    assert len(got) == 4 and len({r["score"] for r in got}) == 1 and all(r["kept"] == 8 for r in got)
    assert toxicity.score_documents(none, model, ["doc_id"]).collect() == []


SPEECH = {"x": "the and of ing tion with".split(), "y": "der und sch ung keit mit".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SPEECH[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_chunks():
    """A text of one chunk has exactly the whole recurrence's probabilities; of longer ones the chunks are each position's once."""
    net = language.Network(["a", "b", "c"])
    net.prepare()
    rng = random.Random(1)
    texts = [speech(rng, "x", n).encode()[: language.CORE] for n in (1, 3, 40, 200)]
    for raw in texts:
        data, lengths = language.padded([raw])
        both = np.concatenate([net.walk(data, lengths, d) for d in "fb"], axis=2)
        logits = both @ net.p["v"] + net.p["c"]
        want = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
        assert np.allclose(net.sums(language.chunks_of(raw))[0], want.sum(axis=(0, 1)), atol=1e-3)
    together = net.sums([c for t in texts for c in language.chunks_of(t)])
    assert np.allclose(together, [net.sums(language.chunks_of(t))[0] for t in texts], atol=1e-3)
    raw = speech(rng, "y", 900).encode()
    chunks = language.chunks_of(raw)
    assert b"".join(b[first:end] for b, first, end in chunks) == raw and abs(net.sums(chunks).sum() - len(raw)) < 0.1


def test_language_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, speech(rng, "xy"[i % 2], 5000 if i % 50 == 0 else 40), "xy"[i % 2], "s") for i in range(400)]
    rows += [(-1, None, "x", "s"), (-2, "12 34 !", "y", "s"), (None, speech(rng, "x", 30), "y", "s"), (7, rows[7][1], "y", "s"), (500, speech(rng, "y", 30), None, "s")]
    rows += [(k, "zu zo zi ze " * 8000, "z", "s") for k in range(600, 640)]  # only in long texts
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[-1][0]["lang_pred"] == by[-2][0]["lang_pred"] == "und" and by[None][0]["held_out"] is None and len(by[7]) == 2
    held = [r for r in got if r["doc_id"] is not None and 0 <= r["doc_id"] < 400 and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == "xy"[r["doc_id"] % 2] for r in held]) > 0.98
    assert {r["lang_pred"] for k in range(600, 640) for r in by[k]} == {"z"} and all(0 <= r["score"] <= 1 for r in got)
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert language.query(spark, f"{tmp_path}/e").collect() == []


def test_toxicity_query(spark, tmp_path):
    """Held-out accuracy; labels of held-out rows and columns other than the text change nothing."""
    rng = random.Random(3)
    texts = [prose(rng, 30) + (" ärgerlich rotten " if i % 3 == 0 else " ") + prose(rng, 3000 if i % 40 == 0 else 30) for i in range(500)]
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(500)]
    found = []
    for k, spoilt in enumerate((False, True)):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, "ab"[i % 2 if not spoilt else i % 3 == 0], "s") for i, t in enumerate(texts)], DOCS).write.parquet(f"{folder}/documents.parquet")
        marks = [(i, 1, int(i % 3 == 0) if not (spoilt and held[i]) else int(i % 3 != 0)) for i in range(500)]
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found.append({r["doc_id"]: r for r in toxicity.query(spark, folder).collect()})
    a, b = found
    assert [a[i]["held_out"] for i in range(500)] == held
    assert all(abs(a[i]["score"] - b[i]["score"]) < 1e-9 for i in range(500))
    assert np.mean([a[i]["predicted"] == int(i % 3 == 0) for i in range(500) if held[i]]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in a.values())


def test_characters_not_bytes():
    assert len(toxicity.packed("éü")) == 1 and len(toxicity.packed("é")) == 0
    assert np.array_equal(toxicity.packed("ÉA"), toxicity.packed("éa"))
