"""Guess costs against every segmentation, base spans against a scanner of single characters, the query on a whole table."""

import hashlib
import math
import random
import string

from metrika.llm import secret_scan as S

from .test_operators import prose


def all_costs(value, ranks):
    """Costs of all ways to cut value: pieces that a pattern finds, and brute-force pieces of any length."""
    pieces = {}
    for s, e, c in S.segments(value, ranks):
        pieces.setdefault(s, []).append((e, c))
    for s, e, unit in S.repeats(value):
        own = min([sum(map(S._alphabet, value[s : s + unit]))] + [c for a, b, c in S.segments(value[s : s + unit], ranks) if (a, b) == (0, unit)])
        pieces.setdefault(s, []).append((e, own + math.log10((e - s) / unit)))
    for s in range(len(value)):
        for e in range(s + 1, len(value) + 1):
            pieces.setdefault(s, []).append((e, sum(map(S._alphabet, value[s:e]))))

    def cuts(at):
        if at == len(value):
            yield 0.0
        for e, c in pieces.get(at, ()):
            for rest in cuts(e):
                yield c + rest + (S.JOIN if at else 0.0)

    return cuts(0)


def test_cheapest_segmentation():
    rng = random.Random(1)
    ranks = S._RANK | {"correct": 300, "horse": 400, "battery": 500, "staple": 600, "butterfly": 700, "kitchen": 800}
    values = ["horse99", "aaaaab", "qwert!1", "1999aaa", "P4ss", "abcabc", "x", "20240101", "zxcvhorse"]
    values += ["".join(rng.choice("ab1qw!") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    for v in values:
        assert abs(S.guess_cost(v, ranks) - min(all_costs(v, ranks))) < 1e-9, v
    assert S.guess_cost("correcthorsebatterystaple", ranks) < 15 and S.guess_cost("butterflykitchen", ranks) < 7
    assert S.guess_cost("") == 0.0


def runs(text, letters, least):
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in letters:
            j += 1
        if j - i >= least:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def base_by_hand(text):
    out, low, n = [], "".join(c.lower() if c in string.ascii_uppercase else c for c in text), len(text)
    i = 0
    while i < n:  # assign
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                break
        else:
            i += 1
            continue
        j += j < n and text[j] in "\"'"
        while j < n and text[j] == " ":
            j += 1
        if j >= n or text[j] not in ":=":
            i += 1
            continue
        j += 1
        while j < n and text[j] == " ":
            j += 1
        j += j < n and text[j] in "\"'"
        k = j
        while k < n and text[k] in string.ascii_letters + string.digits + "+/_.=-":
            k += 1
        if k == j:
            i += 1
            continue
        if k - j >= 8:
            out.append((i, k, 0))
        i = k
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        j = i + 4
        while j < n and text[j] in string.ascii_uppercase + string.digits:
            j += 1
        if j == i + 4:
            i += 1
            continue
        if j - i >= 16:
            out.append((i, j, 1))
        i = j
    out += [(a, b, 2) for a, b in runs(text, "0123456789abcdef", 32)]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, b, k in sorted(out, key=lambda x: (x[0], x[2])))


PARTS = ["password", "PassWD", "token", "api_key", "ApiKey", "secret", "\"", "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "abcdefgh", "0123456789abcdef", "/", "é", "\n", "ſecret", "deadbeefdeadbeefdeadbeefdeadbeef", "x_y.z-1+2", "key"]


def test_base_spans_and_query(spark, tmp_path):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    texts += [None, "", prose(rng, 20_000) + " token='abcdefgh12' " + prose(rng, 20_000), texts[0]]
    rows = [(i % 500 if i else None, t) for i, t in enumerate(texts)]  # repeated ids and a null one
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as SPANS", "'k' as kind").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in S.query(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        base = base_by_hand(t or "")
        want.append((i or 0, hashlib.sha256(base.encode()).hexdigest(), len(base.split(",")) if base else 0))
        own = [x for x in S.scan(t) if x[2] != "guess"]
        assert S.as_text(own) == base
    assert got == sorted(want)
    assert S.find(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []
