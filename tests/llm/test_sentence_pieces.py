"""Ids and decoded texts against the library's own, over whole texts."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from metrika.llm import sentence_pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", " \n", "\n ", "  \n  ", "▁", "▁▁", "a ▁ b\n", "\x1f", "a\x1f b", "\x00", "<s> </s> <unk> <0x41>", "\t\r\x0b", "漢字€😀", "é ﬁ Ａ", " leading", "trailing ", "a  b", "a\n\n\nb", "\n\n"]


def made_up(seed, n):
    r = random.Random(seed)
    letters = "ab e  \n\n\t.,'▁é漢€\x00\x1f\r<s>0x41   😀THEing"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("texts", [ODD, made_up(1, 4000), made_up(2, 1), ["x" * 200_000, ("the cat, " * 50_000) + "\n"], [], ["", ""]])
def test_whole_texts_equal_the_library(texts):
    processor = S.loaded(MODEL)
    ids, decoded = S.encode_texts(processor, texts)
    want = processor.encode(texts, num_threads=1)
    assert ids.to_pylist() == want
    assert decoded.to_pylist() == [processor.decode(i) for i in want]


def test_words_are_segmented_once(monkeypatch):
    processor, seen = S.loaded(MODEL), []
    plain = S.segment
    monkeypatch.setattr(S, "segment", lambda p, words: seen.extend(words) or plain(p, words))
    S.encode_texts(processor, ["the cat the cat\nthe", "cat the  cat"])
    assert sorted(seen) == sorted(set(seen)) and len(seen) <= 7


def test_runs_hold_bounded_texts(monkeypatch):
    monkeypatch.setattr(S, "CHARACTERS", 10)
    texts = ["aaaa", None, "b" * 6, "c", "d" * 50, "", "e"]
    found = S.runs(texts)
    assert [i for a, b in found for i in range(a, b)] == list(range(7))
    assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= 10 for a, b in found)


def test_models_that_cross_cuts_are_refused():
    class Crossing:
        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"

    with pytest.raises(ValueError):
        S.check_model(Crossing())


def test_query_and_odd_tables(spark, tmp_path):
    texts = [*ODD, None, "repeated row", "repeated row", *made_up(5, 200)]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    rows[-1] = (rows[-2][0], *rows[-1][1:])  # one id twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.query(spark, str(tmp_path)).collect()
    processor = S.loaded(MODEL)
    want = []
    for i, t, _ in rows:
        ids = processor.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=lambda r: (str(r[0]), r[2])) == sorted(want, key=lambda r: (str(r[0]), r[2]))
    out = S.encode_documents(docs, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]  # an own column of the name is replaced
    assert S.encode_documents(docs.limit(0), MODEL).collect() == []
