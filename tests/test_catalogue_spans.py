"""The registered scanner queries take spans of up to four words."""

from pyspark.sql import functions as F

from metrika.functions import tables as T
from metrika.operators import kernel, scan
from metrika.plans import catalogue

LINES = ["wake up plane man", "state up sane man"]


def test_matches_of_all_spans(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(LINES))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    s = catalogue._scan(spark, str(tmp_path))
    spans = {(r["line"], r["start"], r["n_words"]) for r in s.candidates.select("line", "start", "n_words").collect()}
    assert spans == {(i, a, n) for i, x in enumerate(LINES) for a in range(len(x.split())) for n in range(1, 5) if a + n <= len(x.split())}

    # every pair of readings, without the join's keys
    r = s.readings.withColumn("code", kernel.coded(F.col("tail"))).withColumn("seed", F.get("tail", F.lit(0))).persist()
    pairs = scan.sided(r, "a").crossJoin(scan.sided(r, "b").drop("verse_id"))
    scores = kernel.score_tails(pairs.select("a_code", "b_code").distinct(), "a_code", "b_code").select("a_code", "b_code", "score")
    n, want = len(T.VOWELS), {}
    for x in pairs.join(scores, ["a_code", "b_code"]).collect():
        a, b = ((x[f"{k}_line"], x[f"{k}_start"], x[f"{k}_n_words"], x[f"{k}_anchor"]) for k in "ab")
        if not (b[0] > a[0] or b[0] == a[0] and b[1] >= a[1] + a[2]):
            continue
        u, v = x["a_seed"], x["b_seed"]
        if 1 - T.VOWEL_DISTANCES[T.VOWELS.index(u["nucleus"]) * n + T.VOWELS.index(v["nucleus"])] < scan.SEED:
            continue
        if (u["onset"], u["nucleus"], u["coda"]) == (v["onset"], v["nucleus"], v["coda"]):
            continue
        score = round(x["score"] - x["a_cost"] - x["b_cost"], 6)
        if score >= kernel.THRESHOLD:
            want[a, b] = max(score, want.get((a, b), 0))
    got = {}
    for x in catalogue.QUERIES["find_matches"](spark, str(tmp_path)).collect():
        a, b = ((x[f"{k}_line"], x[f"{k}_start"], x[f"{k}_n_words"], x[f"{k}_anchor"]) for k in "ab")
        got[a, b] = x["score"]
    assert got == want and any(a[2] == b[2] == 4 for a, b in got) and any(a[2] == 3 for a, _ in got)
