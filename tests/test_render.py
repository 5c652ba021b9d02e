"""Cells, rules, ticks, tooltips, escaping and legends by hand, and the files of rendered verses."""

import os

import pytest
from pyspark.sql import functions as F

from metrika.operators import plan
from metrika.sources import rendered

CELL = "verse_id long, line int, cell_idx int, text string, is_word boolean, rule int"


def under(spark, cells):
    rows = [(1, 0, i, t, t.isalpha(), r) for i, (t, r) in enumerate(cells)]
    return [r.under for r in plan.cell_rule(spark.createDataFrame(rows, CELL)).orderBy("cell_idx").collect()]


@pytest.mark.parametrize(
    "cells, want",
    [
        ([("a", 0), (" ", None), ("b", 0)], [0, 0, 0]),
        ([("a", 0), (" ", None), ("b", 1)], [0, None, 1]),
        ([("a", 0), (", ", None), ("b", None), (" ", None), ("c", 0)], [0, None, None, None, 0]),
        ([(" ", None), ("a", 2), ("!", None)], [None, 2, None]),
        ([("...", None)], [None]),
        ([("a", None), (" ", None), ("b", None)], [None, None, None]),
    ],
)
def test_rules_go_on_between_words_of_one_compound(spark, cells, want):
    assert under(spark, cells) == want


def covering(spark, rows):
    return spark.createDataFrame(rows, "verse_id long, line int, word_idx int, rank int, class_idx int, score double, words string, partner string")


def test_fill_is_the_best_class_and_ticks_are_the_others(spark):
    got = plan.word_fill(covering(spark, [(1, 0, 0, 1, 4, 0.9, "x", "y"), (1, 0, 0, 2, 2, 0.8, "x", "y"), (1, 0, 0, 3, 4, 0.8, "x", "z"), (1, 0, 0, 4, 0, 0.7, "x", "q")])).first()
    assert (got.fill, got.ticks) == (4, [0, 2])


def test_slots_go_to_the_largest_classes(spark):
    rows = [(1, k, m) for k, n in enumerate([2, 5, 2, 3, 2, 2, 2, 2, 2, 4]) for m in range(n)]
    got = {r.class_idx: r.slot for r in plan.slot_assignment(spark.createDataFrame(rows, "verse_id long, class_idx int, member_idx int")).collect()}
    assert got == {1: 0, 9: 1, 3: 2, 0: 3, 2: 4, 4: 5, 5: 6, 6: 7, 7: None, 8: None}


def test_legend_has_one_row_a_class_and_counts_the_rest(spark):
    rows = [(1, 0, i, w) for i, w in enumerate("a b a c d e f g".split())] + [(1, 1, 0, "x"), (1, 1, 1, "y")]
    got = {r.class_idx: r.preview for r in plan.legend_preview(spark.createDataFrame(rows, "verse_id long, class_idx int, member_idx int, words string")).collect()}
    assert got == {0: "a · b · c · d · e · f · … +1", 1: "x · y"}
    html = plan.html_of([[]], [(0, 0, "a · b"), (1, None, "<x>")], [("brr", "oov"), ("coogi", "letter-to-sound")])
    assert html.count("<p><i ") == 2 and "class 1: &lt;x&gt;" in html and "fill-x" in html
    assert "unknown words (not scanned): brr" in html and "not dictionary fact: coogi (letter-to-sound)" in html


def cell(**more):
    return {"text": "a", "is_word": True, "fill": None, "ticks": None, "rule": None, "under": None, "oov": False, "guessed": None, "receipts": None} | more


def test_tooltips_list_matches_then_doubts():
    receipts = [{"words": "wake up", "partner": "state up", "class_idx": 2, "score": 0.964}, {"words": "wake", "partner": "take", "class_idx": 2, "score": 1.0}]
    assert plan.tooltip(cell(receipts=receipts, guessed="g-drop")).split("\n") == ["'wake up' ~ 'state up' — class 2, 0.96", "'wake' ~ 'take' — class 2, 1.00", "pronunciation guessed (g-drop)"]
    assert plan.tooltip(cell(oov=True)) == "unknown word — no pronunciation found" and plan.tooltip(cell()) == ""


def test_words_are_escaped_and_marked():
    receipts = [{"words": 'a"b', "partner": "<c>", "class_idx": 0, "score": 0.8}]
    got = plan.html_word(cell(text="<b>", fill=0, ticks=[1], receipts=receipts), {0: 0, 1: None})
    assert "&lt;b&gt;" in got and "<b>" not in got.replace('<b class="fill-0">', "") and "&quot;" in got and "&lt;c&gt;" in got
    assert 'class="fill-0"' in got and 'class="mark-x"' in got
    assert plan.html_word(cell(text="plain"), {}) == "plain"
    assert "unknown" in plan.html_word(cell(oov=True), {}) and "guess" in plan.html_word(cell(guessed="g-drop"), {})


def test_cells_of_one_compound_are_wrapped_once():
    line = [cell(text="palms", under=0), cell(text=" ", is_word=False, under=0), cell(text="sweaty", under=0), cell(text=" & ", is_word=False), cell(text="knees")]
    html = plan.html_of([line, []], [], [])
    assert '<span class="joined">palms sweaty</span> &amp; knees' in html and "<div>&nbsp;</div>" in html


def test_terminal_marks_fill_rule_and_doubt():
    line = [cell(text="cat", fill=0), cell(text=" ", is_word=False), cell(text="hat", rule=1), cell(text="brr", oov=True)]
    out = plan.terminal_of([line], [(0, 0, "cat")], []).split("\n")
    assert "\x1b[48;2;" in out[0] and "\x1b[4mhat\x1b[0m" in out[0] and "\x1b[3mbrr\x1b[0m" in out[0] and out[-1].endswith("class 0: cat")


def test_one_file_a_verse(spark, tmp_path):
    rendered.register(spark)
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(str(i), f"text {i}\né") for i in range(50)] + [("a/b c", "odd"), (None, "x"), ("n", None), ("", "empty id")], "verse_id string, text string")
    rows.repartition(5).write.format("verse_files").option("suffix", ".html").mode("append").save(path)
    back = lambda: spark.read.format("verse_files").option("suffix", ".html").load(path)  # noqa: E731, files are listed once a load
    want = {(r.verse_id, r.text) for r in rows.collect() if r.verse_id is not None and r.text is not None}
    assert {tuple(r) for r in back().collect()} == want and len(os.listdir(path)) == len(want)
    # written again, a verse replaces its file; overwriting removes what was there
    rows.where("verse_id in ('1', '2')").select("verse_id", F.lit("new").alias("text")).write.format("verse_files").option("suffix", ".html").mode("append").save(path)
    assert {r.text for r in back().where("verse_id in ('1', '2')").collect()} == {"new"} and back().count() == len(want)
    rows.where("verse_id = '7'").write.format("verse_files").option("suffix", ".html").mode("overwrite").save(path)
    assert [r.verse_id for r in back().collect()] == ["7"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rendered.register(spark)
    path = str(tmp_path / "out")
    fails = F.when(F.col("id") < 30, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("verse_id"), fails.alias("text")).write.format("verse_files").mode("append").save(path)
    assert not os.path.isdir(path) or os.listdir(path) == []


def test_a_repeated_task_leaves_one_file(tmp_path):
    path = str(tmp_path / "out")
    writer = rendered.Writer(path, ".txt", False)
    first, again = writer.write(iter([("1", "a"), ("2", "b")])), writer.write(iter([("1", "a"), ("2", "b")]))
    assert os.listdir(path) == ["_trial"]  # nothing is in its place before the commit
    writer.commit([again, None])
    assert sorted(os.listdir(path)) == ["1.txt", "2.txt"] and first.names == again.names


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    rendered.register(spark)
    assert spark.read.format("verse_files").load(str(tmp_path / "none")).collect() == []
