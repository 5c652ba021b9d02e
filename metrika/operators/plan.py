"""Presentation: paint plans as tables, HTML and terminal strings as thin functions at the edge."""

from __future__ import annotations

import html
import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrika.operators import tokenize
from metrika.operators.components import settled
from metrika.operators.scan import VerseScan, first_at_all

# Colours of the classes, as thin marks and as fills, on light and on dark ground.
ACCENT_LIGHT = ["#2a78d6", "#1baf7a", "#eda100", "#008300", "#4a3aa7", "#e34948", "#e87ba4", "#eb6834"]
ACCENT_DARK = ["#3987e5", "#199e70", "#c98500", "#2ec02e", "#9085e9", "#e66767", "#d55181", "#d95926"]
FILL_LIGHT = ["#a8c7ec", "#a2ddc7", "#f6d897", "#97cc97", "#b5aed9", "#f2b4b3", "#f4c8d8", "#f5c1ab"]
FILL_DARK = ["#2d5e97", "#196c4f", "#865c0a", "#268126", "#635c9a", "#984a49", "#8e3c59", "#904121"]
NEUTRAL_FILL, NEUTRAL_ACCENT = ("#e7e6e1", "#383835"), ("#898781", "#898781")
INK, SURFACE, QUIET = ("#0b0b0b", "#ffffff"), ("#fcfcfb", "#1a1a19"), "#898781"
SLOTS = len(ACCENT_LIGHT)
PREVIEW = 6
CANDIDATE = ["line", "start", "n_words", "anchor"]


def candidate_best(selected: DataFrame) -> DataFrame:
    """verse_id, CANDIDATE, score, partner: each matched candidate's best match, the first taken among equals."""
    own = lambda x, y, side: selected.select("verse_id", *[F.col(f"{x}_{c}").alias(c) for c in CANDIDATE], "score", "sel_idx", F.lit(side).alias("side"), F.col(f"{y}_words").alias("partner"))
    rows = own("a", "b", 0).unionByName(own("b", "a", 1))
    best = F.max(F.struct("score", (-F.col("sel_idx")).alias("i"), (-F.col("side")).alias("s"), "partner")).alias("m")
    return rows.groupBy("verse_id", *CANDIDATE).agg(best).select("verse_id", *CANDIDATE, F.col("m.score").alias("score"), F.col("m.partner").alias("partner"))


def word_covering(groups: DataFrame, best: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, rank (1: best), class_idx, score, words, partner: candidates over each word, by score, width, start."""
    rows = groups.join(best, ["verse_id", *CANDIDATE]).withColumn("word_idx", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)))
    order = Window.partitionBy("verse_id", "line", "word_idx").orderBy(F.col("score").desc(), F.col("n_words").desc(), "start", "class_idx", "member_idx")
    return rows.select("verse_id", "line", "word_idx", F.row_number().over(order).alias("rank"), "class_idx", "score", "words", "partner")


def word_fill(covering: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, fill, ticks: the best candidate's class, and the others, ascending."""
    out = covering.groupBy("verse_id", "line", "word_idx").agg(F.min_by("class_idx", "rank").alias("fill"), F.collect_set("class_idx").alias("all"))
    return out.select("verse_id", "line", "word_idx", "fill", F.array_sort(F.array_except("all", F.array("fill"))).alias("ticks"))


def slot_assignment(groups: DataFrame) -> DataFrame:
    """verse_id, class_idx, members, slot: the largest classes first; null beyond the last slot."""
    size = groups.groupBy("verse_id", "class_idx").agg(F.count("*").alias("members"))
    place = F.row_number().over(Window.partitionBy("verse_id").orderBy(F.col("members").desc(), "class_idx")) - 1
    return size.withColumn("place", place).select("verse_id", "class_idx", "members", F.when(F.col("place") < SLOTS, F.col("place")).alias("slot"))


def legend_preview(groups: DataFrame) -> DataFrame:
    """verse_id, class_idx, preview: distinct members in order, the first six, then how many more."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "words"))), lambda x: x["words"]))
    out = groups.groupBy("verse_id", "class_idx").agg(names.alias("u"))
    more = F.concat(F.lit("… +"), (F.size("u") - PREVIEW).cast("string"))
    return out.select("verse_id", "class_idx", F.array_join(F.when(F.size("u") <= PREVIEW, F.col("u")).otherwise(F.concat(F.slice("u", 1, PREVIEW), F.array(more))), " · ").alias("preview"))


def compound_rules(chained: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, rule: words under a compound of two beats or more; a compound claims all its words or none, longest first.

    chained: chain_matches()'s rows. Rules are numbered by verse, also those that get no words.
    """
    first = F.min(F.struct("beat_idx", *[f"{s}_{c}" for s in "ab" for c in ("line", "start")])).alias("x")
    last = F.max(F.struct("beat_idx", *[f"{s}_{c}" for s in "ab" for c in ("start", "n_words")])).alias("y")
    several = chained.groupBy("verse_id", "compound_idx").agg(F.count("*").alias("n"), first, last).where("n > 1")
    order = Window.partitionBy("verse_id").orderBy(F.desc("n"), "x.a_line", "x.a_start", "compound_idx")

    def words(s: str):
        begin, end = F.col(f"x.{s}_start"), F.col(f"y.{s}_start") + F.col(f"y.{s}_n_words")
        places = F.transform(F.sequence(begin, F.greatest(begin, end - 1)), lambda w: F.struct(F.col(f"x.{s}_line").alias("line"), w.alias("word_idx")))
        return F.when(end > begin, places).otherwise(F.slice(places, 1, 0))

    ranked = several.withColumn("__p", F.row_number().over(order))
    cells = ranked.select("verse_id", "__p", F.explode(F.array_union(words("a"), words("b"))).alias("w"))
    cells = settled(cells.select("verse_id", "__p", F.col("w.line").alias("line"), F.col("w.word_idx").alias("word_idx")))
    taken = first_at_all(cells, "line", "word_idx")
    return cells.join(taken, ["verse_id", "__p"], "left_semi").select("verse_id", "line", "word_idx", (F.col("__p") - 1).alias("rule"))


def tooltips(covering: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, receipts: one line a covering candidate, best first, scores to two digits."""
    # the digits of the shortest decimal are cut half to even on the exact binary value at the edge
    line = F.struct("rank", "words", "partner", "class_idx", "score")
    return covering.groupBy("verse_id", "line", "word_idx").agg(F.array_sort(F.collect_list(line)).alias("receipts"))


def plan_verse(scan: VerseScan) -> DataFrame:
    """verse_id, line, cell_idx, text, is_word, word_idx, fill, ticks, rule, oov, guessed, receipts: a row a cell; a line's texts are the line."""
    best = candidate_best(scan.selected)
    covering = word_covering(scan.groups, best)
    cells = tokenize.verse_cells(scan.verses)
    seen = Window.partitionBy("verse_id", "line").orderBy("cell_idx")
    cells = cells.withColumn("word_idx", F.when(F.col("is_word"), F.sum(F.col("is_word").cast("int")).over(seen) - 1).cast("int"))
    at = ["verse_id", "line", "word_idx"]
    source = scan.provenance.select("verse_id", F.lower("word").alias("key"), "source")
    out = cells.join(word_fill(covering), at, "left").join(compound_rules(scan.compounds), at, "left").join(tooltips(covering), at, "left")
    out = out.withColumn("key", F.when(F.col("is_word"), F.lower("text"))).join(source, ["verse_id", "key"], "left")
    oov = F.coalesce(F.col("source") == "oov", F.lit(False))
    return out.select("verse_id", "line", "cell_idx", "text", "is_word", "word_idx", "fill", "ticks", "rule", oov.alias("oov"), F.when(~oov, F.col("source")).alias("guessed"), "receipts")


def cell_rule(plan: DataFrame) -> DataFrame:
    """plan with under: the rule that runs below a cell; between words it goes on only if the next word has it too."""
    line = Window.partitionBy("verse_id", "line").orderBy("cell_idx")
    none = F.lit(-1)
    following = F.first(F.when(F.col("is_word"), F.coalesce("rule", none)), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(F.when(F.col("is_word"), F.coalesce("rule", none)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    between = F.when((following == before) & (following >= 0), following)
    return plan.withColumn("under", F.when(F.col("is_word"), F.col("rule")).otherwise(between))


def slot_class(prefix: str, slot) -> str:
    return f"{prefix}{'x' if slot is None else int(slot)}"


def css() -> str:
    """The page's style: each class colour is a custom property, which the dark scheme sets anew."""

    def properties(k: int) -> str:
        fills, accents = ((FILL_LIGHT, ACCENT_LIGHT), (FILL_DARK, ACCENT_DARK))[k]
        colours = {f"fill-{i}": c for i, c in enumerate(fills)} | {f"mark-{i}": c for i, c in enumerate(accents)}
        colours |= {"fill-x": NEUTRAL_FILL[k], "mark-x": NEUTRAL_ACCENT[k], "ink": INK[k], "ground": SURFACE[k], "faint": QUIET}
        return " ".join(f"--{name}: {c};" for name, c in colours.items())

    slots = [*map(str, range(SLOTS)), "x"]
    painted = "\n".join(f".verses .fill-{i} {{ background-color: var(--fill-{i}) }}\n.verses .mark-{i} {{ background-color: var(--mark-{i}) }}" for i in slots)
    return f"""article.verses {{ {properties(0)} color: var(--ink); background-color: var(--ground); padding: 20px; font: 17px/1.9 Georgia, serif; }}
@media (prefers-color-scheme: dark) {{ article.verses {{ {properties(1)} }} }}
.verses > div {{ white-space: break-spaces; min-height: 1.9em; }}
.verses .word {{ display: inline-flex; flex-direction: column; line-height: 1.25; }}
.verses .word > b {{ font-weight: inherit; padding-inline: 2px; }}
.verses .word > s {{ height: 2px; margin-block-start: 1px; }}
.verses .joined {{ box-shadow: inset 0 -2px var(--faint); }}
.verses .unknown {{ border-bottom: 2px dotted var(--faint); }}
.verses .guess > b {{ text-decoration: underline dashed var(--faint); }}
.verses footer {{ color: var(--faint); font-size: 14px; padding-top: 16px; }}
.verses footer i {{ display: inline-block; width: 12px; height: 12px; margin-right: 5px; }}
{painted}"""


def tooltip(cell) -> str:
    """A word's receipts as lines."""
    if cell["oov"]:
        return "unknown word — no pronunciation found"
    receipts = cell["receipts"] if cell["receipts"] is not None else []
    out = [f"'{r['words']}' ~ '{r['partner']}' — class {r['class_idx']}, {r['score']:.2f}" for r in receipts]
    return "\n".join(out + ([f"pronunciation guessed ({cell['guessed']})"] if cell["guessed"] else []))


def tooltip_texts(cells: DataFrame) -> DataFrame:
    """verse_id, line, word_idx, tooltip of the words of plan_verse() that have one."""
    kind = cells.schema["verse_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            texts = [tooltip(c) for c in pdf[["oov", "guessed", "receipts"]].to_dict("records")]
            own = pdf[["verse_id", "line", "word_idx"]].assign(tooltip=texts)
            yield own[own["tooltip"] != ""]

    words = cells.where("is_word").select("verse_id", "line", "word_idx", "oov", "guessed", "receipts")
    return words.mapInPandas(run, f"verse_id {kind}, line int, word_idx int, tooltip string")


def html_word(cell, slots: dict) -> str:
    text = html.escape(cell["text"])
    title = html.escape(tooltip(cell)).replace("\n", "&#10;")
    if cell["oov"]:
        return f'<span class="word unknown" title="{title}">{text}</span>'
    if cell["fill"] is None and not cell["guessed"]:
        return text
    paint = "" if cell["fill"] is None else f' class="{slot_class("fill-", slots[cell["fill"]])}"'
    marks = "".join(f'<s class="{slot_class("mark-", slots[k])}"></s>' for k in (cell["ticks"] if cell["ticks"] is not None else []))
    return f'<span class="word{" guess" if cell["guessed"] else ""}" title="{title}"><b{paint}>{text}</b>{marks}</span>'


def html_of(lines: list, legend: list, sources: list) -> str:
    """lines: lists of cells; legend: (class, slot, preview); sources: (word, source)."""
    slots = {k: s for k, s, _ in legend}
    body = []
    for cells in lines:
        # cells that one compound runs below are wrapped together
        parts = []
        for under, group in itertools.groupby(cells, key=lambda c: c["under"]):
            inner = "".join(html_word(c, slots) if c["is_word"] else html.escape(c["text"]) for c in group)
            parts.append(inner if under is None else f'<span class="joined">{inner}</span>')
        body.append(f"<div>{''.join(parts) or '&nbsp;'}</div>")
    rows = [f'<p><i class="{slot_class("fill-", s)}"></i>class {k}: {html.escape(p)}</p>' for k, s, p in legend]
    rows += [f"<p>{html.escape(n)}</p>" for n in notes(sources)]
    return "\n".join([f"<style>{css()}</style>", '<article class="verses">', *body, "<footer>", *rows, "</footer>", "</article>"])


def notes(sources: list) -> list[str]:
    guessed = ", ".join(f"{w} ({s})" for w, s in sources if s != "oov")
    unknown = ", ".join(w for w, s in sources if s == "oov")
    return [f"pronunciation guessed, not dictionary fact: {guessed}"] * bool(guessed) + [f"unknown words (not scanned): {unknown}"] * bool(unknown)


def ansi_background(colour: str) -> str:
    return "\x1b[48;2;{};{};{}m".format(*bytes.fromhex(colour[1:]))


def terminal_of(lines: list, legend: list, sources: list) -> str:
    colour = {k: NEUTRAL_FILL[1] if s is None else FILL_DARK[int(s)] for k, s, _ in legend}
    out = []
    for cells in lines:
        parts = []
        for c in cells:
            codes = (ansi_background(colour[c["fill"]]) + "\x1b[97m") * (c["fill"] is not None) if c["fill"] is not None else ""
            codes += "\x1b[4m" * (c["rule"] is not None) + "\x1b[3m" * bool(c["oov"])
            parts.append(f"{codes}{c['text']}\x1b[0m" if codes else c["text"])
        out.append("".join(parts))
    out.append("")
    out += [f"{ansi_background(colour[k])}  \x1b[0m class {k}: {p}" for k, _, p in legend]
    return "\n".join(out + notes(sources))


def render(scan: VerseScan, medium: str = "html") -> DataFrame:
    """verse_id, rendered: one self-contained string a verse ('html' or 'terminal')."""
    cell = F.struct("line", "cell_idx", "text", "is_word", "fill", "ticks", "rule", "under", "oov", "guessed", "receipts")
    cells = cell_rule(plan_verse(scan)).groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("line", "cell_idx", cell.alias("c")))).alias("cells"))
    entry = slot_assignment(scan.groups).join(legend_preview(scan.groups), ["verse_id", "class_idx"])
    legend = entry.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("class_idx", "slot", "preview"))).alias("legend"))
    sources = scan.provenance.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("line", "word_idx", "word", "source"))).alias("sources"))
    n_lines = scan.verses.select("verse_id", F.size(tokenize.lines_of(F.col("text"))).alias("n_lines"))
    whole = n_lines.join(cells, "verse_id", "left").join(legend, "verse_id", "left").join(sources, "verse_id", "left")
    emit = {"html": html_of, "terminal": terminal_of}[medium]
    kind = scan.verses.schema["verse_id"].dataType.simpleString()

    def run(frames):
        import json

        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                lines: list = [[] for _ in range(r.n_lines)]
                for c in json.loads(r.cells or "[]"):
                    own = {"fill": None, "ticks": None, "rule": None, "under": None, "guessed": None, "receipts": None} | c["c"]
                    lines[own["line"]].append(own)
                classes = [(x["class_idx"], x.get("slot"), x["preview"]) for x in json.loads(r.legend or "[]")]
                out.append((r.verse_id, emit(lines, classes, [(x["word"], x["source"]) for x in json.loads(r.sources or "[]")])))
            yield pd.DataFrame(out, columns=["verse_id", "rendered"])

    as_json = whole.select("verse_id", "n_lines", *[F.to_json(c).alias(c) for c in ("cells", "legend", "sources")])
    return as_json.mapInPandas(run, f"verse_id {kind}, rendered string")


def render_html(scan: VerseScan) -> DataFrame:
    return render(scan, "html")


def render_terminal(scan: VerseScan) -> DataFrame:
    return render(scan, "terminal")
