"""Phonology, pronunciation chain and kernel against fixed examples and exhaustive properties."""

import pytest
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import g2p, kernel, tokenize
from metrika.sources import annotation, lexicon


@pytest.fixture(scope="module")
def pron(spark):
    words = "lincoln Coogi blaow bling homie brrr imma shoulda runnin flowin' chokin' ' y c".split()
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    out = g2p.pronounce(df, lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))
    return {r["word"]: (r["source"], r["cost"], r["p"]) for r in out.select("word", "source", "cost", F.transform("prons", P.syllables_text).alias("p")).collect()}


@pytest.mark.parametrize(
    "word, source, cost, text",
    [
        ("lincoln", "dictionary", 0.0, "L IH1 NG . K AH0 N"),
        ("coogi", "letter-to-sound", 0.1, "K UW1 . G IY0"),
        ("blaow", "letter-to-sound", 0.1, "B L AW1"),
        ("bling", "letter-to-sound", 0.1, "B L IH1 NG"),
        ("homie", "letter-to-sound", 0.1, "HH AA1 . M IY0"),
        ("imma", "lexicon", 0.0, "AY1 . M AH0"),
        ("shoulda", "lexicon", 0.0, "SH UH1 . D AH0"),
        ("runnin", "stem+-in'", 0.0, "R AH1 . N IH0 N"),
        ("flowin'", "g-drop", 0.0, "F L OW1 . IH0 N"),
        ("chokin'", "g-drop", 0.0, "CH OW1 . K IH0 N"),
    ],
)
def test_chain(pron, word, source, cost, text):
    assert pron[word] == (source, cost, [text])


@pytest.mark.parametrize("word", ["brrr", "'", "c", "y"])
def test_unvoiced(pron, word):
    assert pron[word] == ("oov", 0.0, [])


def test_distances_are_metrics_in_range():
    for names, d in ((T.VOWELS, T.VOWEL_DISTANCES), (T.CONSONANTS, T.CONSONANT_DISTANCES)):
        n = len(names)
        for i in range(n):
            assert d[i * n + i] == 0
            for j in range(n):
                assert 0 <= d[i * n + j] <= 1 and d[i * n + j] == d[j * n + i]


def test_onsets_and_splits(spark):
    rows = [(["K", "S"],), (["S", "T", "R"],), (["NG"],), ([],), (["N", "S", "T", "R"],)]
    s = P.split_consonants(F.col("c"))
    got = spark.createDataFrame(rows, "c array<string>").select(P.is_legal_onset(F.col("c")), s["coda"], s["onset"]).collect()
    assert [tuple(r) for r in got] == [(False, ["K"], ["S"]), (True, [], ["S", "T", "R"]), (False, ["NG"], []), (True, [], []), (False, ["N"], ["S", "T", "R"])]


def test_tails_fall_back(spark):
    texts = ["R IY1 . Z AH0 N", "AH0 . R AW1 N D", "HH IH2 . N AH0", "AH0 . B AH0", "K AE1 . T AE1"]
    tail = P.syllables_text(P.rhyme_tail(P.parse_arpabet(F.col("t"))))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tail).collect()
    assert [r[0] for r in got] == ["R IY1 . Z AH0 N", "R AW1 N D", "HH IH2 . N AH0", "B AH0", "T AE1"]
    assert spark.createDataFrame([("K XX T",)], "t string").select(P.parse_arpabet(F.col("t"))).first()[0] is None


def python_align(a, b, gap=0.6):
    """Plain dynamic programming over nuclei; columns of (i, j)."""
    m, n = len(a), len(b)
    vd = lambda x, y: T.vowel_distance(x[0], y[0])
    cost = {(0, 0): (0.0, [])}
    for i in range(m + 1):
        for j in range(n + 1):
            if (i, j) == (0, 0):
                continue
            options = []
            if i and j:
                c, p = cost[i - 1, j - 1]
                options.append((c + vd(a[i - 1], b[j - 1]), p + [(i - 1, j - 1)]))
            if i:
                c, p = cost[i - 1, j]
                options.append((c + gap, p + [(i - 1, None)]))
            if j:
                c, p = cost[i, j - 1]
                options.append((c + gap, p + [(None, j - 1)]))
            best = options[0]
            for o in options[1:]:
                if o[0] < best[0] - 1e-12:
                    best = o
            cost[i, j] = best
    return cost[m, n][1]


def python_score(a, b):
    def coda(x, y):
        n = max(len(x), len(y))
        return 1.0 if not n else sum(1 - T.consonant_distance(p, q) for p, q in zip(x, y)) / n

    columns = python_align(a, b)
    total = sum(((1 - T.vowel_distance(a[i][0], b[j][0])) + 0.35 * coda(a[i][1], b[j][1])) / 1.35 for i, j in columns if i is not None and j is not None)
    return total / len(columns), len(columns)


def test_alignment_against_plain_code(spark):
    import random

    rng = random.Random(5)
    some = lambda: [(rng.choice(T.VOWELS), [rng.choice(T.CONSONANTS) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 5))]
    pairs = [(some(), some()) for _ in range(200)]
    as_rows = lambda t: [([], n, c, 1) for n, c in t]
    df = spark.createDataFrame([(i, as_rows(a), as_rows(b)) for i, (a, b) in enumerate(pairs)], f"i int, a array<{P.SYLLABLE}>, b array<{P.SYLLABLE}>")
    got = kernel.score_tails(df.select("i", kernel.coded(F.col("a")).alias("a"), kernel.coded(F.col("b")).alias("b")), "a", "b").collect()
    for r in got:
        score, columns = python_score(*pairs[r["i"]])
        assert abs(r["score"] - score) < 1e-8 and r["alignment"]["columns"] == columns


def test_lines_and_cells(spark):
    texts = ["a b\n\nc", "", None, "x\r\ny\x0bz w\n", "don't, stop!"]
    df = spark.createDataFrame(list(enumerate(texts)), "verse_id int, text string")
    lines = {}
    for r in tokenize.verse_lines(df).orderBy("verse_id", "line").collect():
        lines.setdefault(r["verse_id"], []).append(r["raw"])
    for i, t in enumerate(texts):
        assert lines.get(i, []) == (t or "").splitlines()
    cells = tokenize.verse_cells(df).where("verse_id = 4").orderBy("cell_idx").collect()
    assert "".join(c["text"] for c in cells) == texts[4] and [c["text"] for c in cells if c["is_word"]] == ["don't", "stop"]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text(";;; comment\nREAD  R EH1 D\nREAD(2)  R IY1 D # note\nCAT  K AE1 T\n")
    rows = lexicon.read_lexicon(spark, str(tmp_path / "d.txt")).orderBy("word", "variant_idx").collect()
    assert [(r["word"], r["variant_idx"], " ".join(r["phones"])) for r in rows] == [("cat", 0, "K AE1 T"), ("read", 0, "R EH1 D"), ("read", 1, "R IY1 D")]
    have, missing = lexicon.lexicon_json(lexicon.read_lexicon(spark, str(tmp_path / "d.txt")), spark.createDataFrame([("Cat",), ("dog",)], "word string"))
    assert have.first()["json"] == '[[{"o":["K"],"n":"AE","s":1,"c":["T"]}]]' and missing.first()["word"] == "dog"


def test_annotations_round_trip(spark):
    text = "group: wake up@1.1-2 state up@1.9-10\nnot: cat@2.1 hat@2.3"
    refs = annotation.parse_annotations(spark.createDataFrame([(1, text)], "verse_id int, annotation string"))
    rows = [(r["kind"], r["text"], r["line"], r["w1"], r["w2"]) for r in refs.orderBy("gid", "ref_idx").collect()]
    assert rows == [("group", "wake up", 0, 0, 1), ("group", "state up", 0, 8, 9), ("not", "cat", 1, 0, 0), ("not", "hat", 1, 2, 2)]
    back = annotation.write_annotations(spark.createDataFrame([(1, "v")], "verse_id int, text string"), refs).first()["annotation"]
    assert back == "verse:\nv\n\n" + text
