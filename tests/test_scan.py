"""The scanner and its presentation on short verses."""

import pytest
from pyspark.sql import functions as F

from metrika.operators import components, plan, scan
from metrika.sources import lexicon

VERSES = [(1, "wake up, take a cake and shake the state up\nfeeling great, no debate"), (2, "see me\nyou to\nplane man\nsane man"), (3, "spaghetti sofa the a and\n\nCoogi groovy brrr <b>"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def found(spark):
    verses = spark.createDataFrame(VERSES, "verse_id long, text string")
    return scan.scan_verse(verses, lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))


@pytest.fixture(scope="module")
def selected(found):
    return found.selected.collect()


def test_candidates(found):
    rows = found.candidates.collect()
    by = {}
    for r in rows:
        by.setdefault((r["verse_id"], r["words"]), set()).add(r["anchor"])
    assert by[3, "spaghetti"] == {1, 2} and by[1, "wake up"] == {0}
    assert not any(r["words"].split()[0] in ("a", "and", "the") for r in rows) and not any("brrr" in r["words"] for r in rows)


def test_matches(selected):
    best = {(r["a_words"], r["b_words"]): (round(r["score"], 3), r["length"]) for r in selected}
    assert best["wake up", "state up"] == (0.964, 2) and ("wake", "state") not in best
    assert best["see", "me"] == (0.85, 1) and ("you", "to") not in best
    assert best["plane man", "sane man"] == (1.0, 2) and best["Coogi", "groovy"] == (0.9, 2)


def test_selected_don_t_conflict(selected):
    overlap = lambda x, y, s: x["verse_id"] == y["verse_id"] and x[s + "_line"] == y[s + "_line"] and x[s + "_start"] < y[s + "_start"] + y[s + "_n_words"] and y[s + "_start"] < x[s + "_start"] + x[s + "_n_words"]
    for i, x in enumerate(selected):
        for y in selected[i + 1 :]:
            assert not (overlap(x, y, "a") and overlap(x, y, "b"))


def test_groups_and_compounds_partition(found, selected):
    groups = found.groups.collect()
    nodes = {(r["verse_id"], *[r[f"{s}_{c}"] for c in ("line", "start", "n_words", "anchor")]) for r in selected for s in "ab"}
    members = [(r["verse_id"], r["line"], r["start"], r["n_words"], r["anchor"]) for r in groups]
    assert len(members) == len(set(members)) and set(members) == nodes
    chained = found.compounds.collect()
    assert sorted((r["verse_id"], r["sel_idx"]) for r in chained) == sorted((r["verse_id"], r["sel_idx"]) for r in selected)


def test_cells_rebuild_the_text(found):
    cells = plan.plan_verse(found).orderBy("verse_id", "line", "cell_idx").collect()
    for verse, text in VERSES:
        lines = {}
        for c in cells:
            if c["verse_id"] == verse:
                lines[c["line"]] = lines.get(c["line"], "") + c["text"]
        assert lines == {i: s for i, s in enumerate((text or "").splitlines()) if s}


def test_renderings(found):
    pages = {r["verse_id"]: r["rendered"] for r in plan.render_html(found).collect()}
    assert set(pages) == {1, 2, 3, 4, 5} and "&nbsp;" in pages[3] and "&lt;" in pages[3] and "unknown words (not scanned): the, brrr" in pages[3]
    assert "class 0" in pages[1] and "0.96" in pages[1]
    term = {r["verse_id"]: r["rendered"] for r in plan.render_terminal(found).collect()}
    import re

    assert re.sub("\x1b\\[[0-9;]*m", "", term[1]).startswith(VERSES[0][1])


@pytest.mark.parametrize(
    "n, edges, want",
    [
        (5, [(0, 2), (2, 4)], [0, 1, 0, 3, 0]),
        (3, [], [0, 1, 2]),
        (4, [(0, 1), (1, 0), (2, 2)], [0, 0, 2, 3]),
        (9, [(i + 1, i) for i in range(8)], [0] * 9),
    ],
)
def test_components(spark, n, edges, want):
    nodes = spark.createDataFrame([(0, i) for i in range(n)], "scope int, node int")
    found = components.connected_components(nodes, spark.createDataFrame([(0, *e) for e in edges], "scope int, a int, b int"))
    assert [r["component"] for r in found.orderBy("node").collect()] == want


def test_threshold_must_be_positive(found):
    with pytest.raises(ValueError):
        scan.find_matches(found.readings, threshold=0.0)


def test_streaming_stage(spark, tmp_path):
    from metrika.streaming import verses as stream

    spark.createDataFrame(VERSES[:3], "verse_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("verse_id long, text string").parquet(str(tmp_path / "in"))
    q = stream.tails(source, lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark)).writeStream.format("memory").queryName("tails").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tails")
    assert got.where("word = 'Coogi'").select("tail").first()[0] == "K UW1 . G IY0"
    assert got.select(F.countDistinct("verse_id")).first()[0] == 3


def test_rounds_against_plain_loops(spark):
    import random

    r, rows = random.Random(4), {}
    for _ in range(260):
        side = [(r.randrange(3), r.randrange(7), r.randint(1, 4), r.randrange(2)) for _ in "ab"]
        length = r.randint(1, 4)
        rows[(r.randrange(3), *side)] = (r.choice([0.75, 0.8, 1.0]), length, r.randint(1, length))
    data = [(v, *a, f"{a}", *b, f"{b}", *m) for (v, a, b), m in rows.items()]
    side = lambda s: f"{s}_line int, {s}_start int, {s}_n_words int, {s}_anchor int, {s}_words string"
    kind = f"verse_id int, {side('a')}, {side('b')}, score double, length int, informative_length int"
    chosen = scan.select_matches(spark.createDataFrame(data, kind)).cache()

    overlap = lambda x, y: x[0] == y[0] and x[1] < y[1] + y[2] and y[1] < x[1] + x[2]
    want, chains, rules = {}, {}, {}
    for verse in {k[0] for k in rows}:
        own = sorted((-m[0], -m[2], m[1], b[0] - a[0], b[1], a[0], a[1], a, b) for (v, a, b), m in rows.items() if v == verse)
        taken = []
        for *_, a, b in own:
            if not any(overlap(a, x) and overlap(b, y) for x, y in taken):
                taken.append((a, b))
        want[verse] = taken
        # chains: smallest place of the component, by repeated passes
        order = sorted(range(len(taken)), key=lambda i: (taken[i][0][0], taken[i][0][1], i))
        root = {i: place for place, i in enumerate(order)}
        ends = [((a[0], a[1] + a[2], b[0], b[1] + b[2]), (a[0], a[1], b[0], b[1])) for a, b in taken]
        for _ in taken:
            for i, (end, _) in enumerate(ends):
                for j, (_, start) in enumerate(ends):
                    if end == start:
                        root[i] = root[j] = min(root[i], root[j])
        ids = sorted(set(root.values()))
        chains[verse] = [ids.index(root[i]) for i in range(len(taken))]
        several = []
        for c in range(len(ids)):
            beats = [taken[i] for i in order if chains[verse][i] == c]
            if len(beats) > 1:
                words = [(beats[0][s][0], w) for s in (0, 1) for w in range(beats[0][s][1], beats[-1][s][1] + beats[-1][s][2])]
                several.append((-len(beats), beats[0][0][0], beats[0][0][1], c, words))
        for rule, (*_, words) in enumerate(sorted(several)):
            if not any((verse, w) in rules for w in words):
                rules |= {(verse, w): rule for w in words}
    got = {}
    for x in chosen.orderBy("verse_id", "sel_idx").collect():
        got.setdefault(x["verse_id"], []).append(tuple(tuple(x[f"{s}_{c}"] for c in scan.KEY[1:]) for s in "ab"))
    assert got == want and sum(map(len, want.values())) < len(rows)
    chained = scan.chain_matches(chosen).cache()
    found = {}
    for x in chained.orderBy("verse_id", "sel_idx").collect():
        found.setdefault(x["verse_id"], []).append(x["compound_idx"])
    assert found == chains and any(len(set(c)) < len(c) for c in chains.values())
    assert {(x["verse_id"], (x["line"], x["word_idx"])): x["rule"] for x in plan.compound_rules(chained).collect()} == rules


def test_selection_of_nothing(spark, found):
    none = found.matches.where("false")
    assert not scan.select_matches(none).collect()
    empty = scan.select_matches(none)
    assert not scan.scan_groups(empty).collect() and not scan.chain_matches(empty).collect()
