"""Secret scans: fixed patterns, and guess costs of values in a credential context.

Base spans are the fixed patterns' matches. The method adds the values that follow a
credential word ("pwd: ...", "passphrase is ...") and that are costly to guess: the value is
segmented by dynamic programming into dictionary words, dates, repeats, keyboard walks and
brute-force spans, and the cheapest segmentation's log10 of guesses decides. Base spans
always stay; an added span never overlaps one.

The dictionary is the list of common passwords and, behind it, the corpus's own words by
document frequency, counted over all documents but not in values of a credential context.
Words of LEAST_DOCS documents or more are kept, and of those the WORD_BOUND in most documents:
the frequency from which on there are at most that many is found from counts of frequencies
(exact up to 4,095, with 12 leading bits above), so words of one frequency stay or go together.

In prose ("the password is unbelievable") a value that the dictionary doesn't know may still be
a word: one or more runs of up to PROSE letters, joined by hyphens or apostrophes, each in lower,
upper or title case, whose letters follow each other in the corpus's words at least half as often
as if drawn evenly, on geometric average. Such a value is no secret (at sf0.1 neither are 10 % of
strings of ten letters drawn evenly). The pairs' counts cover all words; values after ":" or
"=" and values with digits, symbols or mixed case go by their guess cost alone.

Defined cases: null or empty text has no spans; texts are scanned whole; spans are in code
points, end exclusive; several spans at one start are in the order of KINDS. Values of any
length work: a segment's cost is bounded by its characters, so time is linear in the length.
Repeated rows are scanned each; of words in equally many documents the first by code points
ranks higher; letters beyond a to z say nothing about a word; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from string import ascii_lowercase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lean, map_texts, stored, table

KINDS = ("assign", "access", "hex", "guess")
#: What the query's contract states.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

_CREDENTIAL = r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)["']?"""
#: Names may be glued (PGPASSWORD=, dbpwd:); in prose ("... is ...") the credential must be a word of its own.
CONTEXT = re.compile(rf"""(?:{_CREDENTIAL}\x20*[:=]\x20*|(?<![A-Za-z0-9]){_CREDENTIAL}\x20+((?i:is))\x20+)["']?([^\s"'<>,;]{{6,}})""", re.ASCII)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

#: Common passwords and their parts, commonest first; the rank is a word's number of guesses.
WORDS = """password pass admin welcome login qwerty letmein dragon monkey master hello freedom shadow sunshine princess
football baseball superman batman trustno iloveyou whatever secret user test guest root server system service
summer winter spring autumn monday friday love money house computer internet network access change default
example sample temp demo dummy your my the and for with key token none null true false value string here
changeme placeholder redacted hidden unknown required optional company office home family happy lucky star
angel tiger lion eagle black white blue green orange purple silver gold""".split()
WALKS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p", "qazwsxedcrfvtgbyhnujmikolp")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
#: log10 of guesses for each further segment: where it begins and of which kind it is.
JOIN = math.log10(5)
GUESS_LIMIT = 10.0

#: Documents that hold a word of the corpus's dictionary, at least; how many words it has, at most; their letters.
LEAST_DOCS, WORD_BOUND, LETTERS = 5, 200_000, range(3, 25)
#: Letters of a word in prose at most; a longer run may be words glued together.
PROSE = 16
#: log10 of how likely a word's letter is against even draws, on average and at least: a half.
WORD_LIKE = math.log10(1 / 2)
_EDGES = ".,;:!?()[]{}\"'`*_-"

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_NEXT: dict[str, set] = {}
for _row in WALKS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)


def _alphabet(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else math.log10(100)
    return math.log10(33)


def segments(value: str, ranks: dict = _RANK) -> list[tuple[int, int, float]]:
    """Every (start, end, log10 guesses) that a pattern finds; brute force isn't listed."""
    out, n, low = [], len(value), value.lower()
    plain = low.translate(_LEET) if len(low) == n else value
    if len(low) != n:
        low = value
    for i in range(n):
        for j in range(i + 3, min(n, i + LETTERS[-1]) + 1):
            rank = ranks.get(low[i:j]) or (ranks.get(plain[i:j], 0) * 4)
            if rank:
                cased = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i:j] in (low[i:j].title(), low[i:j].upper()) else 2 ** min(20, j - i))
                out.append((i, j, math.log10(rank) + cased))
    for m in DATE.finditer(value):
        out.append((m.start(), m.end(), math.log10(365 * 120) if m.end() - m.start() > 4 else math.log10(120)))
    i = 0
    while i + 2 < n:  # maximal keyboard walks of three keys or more
        j = i + 1
        while j < n and low[j] in _NEXT.get(low[j - 1], ()):
            j += 1
        if j - i >= 3:
            out.append((i, j, math.log10(47 * 4) + (j - i) * math.log10(1.5)))
        i = max(j - 1, i + 1)
    return out


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, length of the unit) of maximal runs of a unit of 1 to 8 characters, twice or more, at least 3 long."""
    out = []
    for unit in range(1, 9):
        i = 0
        while i + 2 * unit <= len(value):
            j = i + unit
            while j < len(value) and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                out.append((i, j, unit))
                i = j - unit + 1
            else:
                i += 1
    return out


def guess_cost(value: str, ranks: dict = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value."""
    n = len(value)
    if not n:
        return 0.0
    at: dict[int, list] = {}
    for s, e, c in segments(value, ranks):
        at.setdefault(e, []).append((s, c))
    for s, e, unit in repeats(value):
        whole = sum(_alphabet(c) for c in value[s : s + unit])
        known = min((c for a, b, c in segments(value[s : s + unit], ranks) if (a, b) == (0, unit)), default=whole)
        at.setdefault(e, []).append((s, min(whole, known) + math.log10((e - s) / unit)))
    # brute[i]: cheapest with a brute-force span that ends at i; best[i]: cheapest of any kind
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for i in range(1, n + 1):
        step = _alphabet(value[i - 1])
        brute[i] = min(brute[i - 1] + step, best[i - 1] + step + (JOIN if i > 1 else 0.0))
        best[i] = min([brute[i], *(best[s] + c + (JOIN if s else 0.0) for s, c in at.get(i, ()))])
    return best[n]


def pair_weights(counts: dict) -> dict:
    """log10 of how much likelier a letter follows another in words than in even draws, from counts of pairs; "^" begins a word.

    No pair weighs less than -1, which is also the weight of pairs that no word has.
    """
    firsts = Counter()
    for pair, n in counts.items():
        firsts[pair[0]] += n
    return {p: max(-1.0, math.log10(26 * counts[p] / firsts[a])) if counts.get(p) else -1.0 for a in "^" + ascii_lowercase for b in ascii_lowercase for p in [a + b]}


def like_word(value: str, weights: dict) -> bool:
    """Whether a value looks like a word of prose; without weights none does."""
    parts = re.split(r"[-'\u2019]", value)
    if not all(p.isalpha() and len(p) <= PROSE and p in (p.lower(), p.upper(), p.title()) for p in parts):
        return False
    known = [weights[pair] for p in parts for pair in map("".join, zip("^" + p.lower(), p.lower())) if pair in weights]
    return bool(known) and sum(known) / len(known) > WORD_LIKE


def scan(text: str | None, limit: float = GUESS_LIMIT, ranks: dict = _RANK, weights: dict | None = None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind."""
    if not text:
        return []
    low = text.lower()
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = sorted(out)
        for m in CONTEXT.finditer(text):
            value = m[2].rstrip(".)]}!?")
            s, e = m.start(2), m.start(2) + len(value)
            if len(value) < 6 or any(a < e and s < b for a, b, _ in base) or m[1] and like_word(value, weights or {}):
                continue
            if guess_cost(value, ranks) >= limit:
                out.append((s, e, 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def as_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FIELDS = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string"), ("n_guess", "bigint")]


def digest(text: str | None, ranks: dict = _RANK, weights: dict | None = None) -> tuple:
    spans = scan(text, ranks=ranks, weights=weights)
    n = {k: sum(x[2] == k for x in spans) for k in KINDS}
    base = as_text(x for x in spans if x[2] != "guess")
    return n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), as_text(spans), n["guess"]


def words_of(text: str | None) -> set:
    """Distinct words in lower case, without what follows a credential word."""
    low = (text or "").lower()
    if any(h in low for h in CONTEXT_HINTS):
        low = CONTEXT.sub(" ", low)
    return {w for w in (x if x.isalpha() else x.strip(_EDGES) for x in set(low.split())) if len(w) in LETTERS and w.isalpha()}


def frequent_from(counts: DataFrame, bound: int) -> int:
    """The least document frequency, LEAST_DOCS at least, from which on there are at most `bound` words."""
    shift = F.greatest(F.length(F.bin("n")) - 12, F.lit(0))
    level = F.expr("shiftleft(shiftright(n, shift), shift)")
    # at most 4,096 levels and 2,048 for each further bit
    rows = counts.where(F.col("n") >= LEAST_DOCS).withColumn("shift", shift).groupBy(level.alias("level")).count().collect()
    total, out = 0, None
    for at, n in sorted(rows, reverse=True):
        total += n
        if total > bound:
            return out or at + (1 << max(at.bit_length() - 12, 0))
        out = at
    return LEAST_DOCS


def learned(docs: DataFrame, text: str = "text") -> tuple[dict, dict]:
    """Ranks of common passwords, then of the words of docs by document frequency; weights of pairs of letters."""

    def run(batches):
        for batch in batches:
            n = Counter()
            for t in batch.column(0).to_pylist():
                n.update(words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    made = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(lean(run), "word string, n long")
    counts = stored(docs.sparkSession, made.groupBy("word").agg(F.sum("n").alias("n")), "words")
    rows = counts.where(F.col("n") >= frequent_from(counts, WORD_BOUND)).collect()
    own = [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0])) if w not in _RANK]
    begun = F.concat(F.lit("^"), "word")
    pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(begun, i, F.lit(2)))).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike("^[\\^a-z][a-z]$")).groupBy("pair").agg(F.sum("n")).collect()  # 702 rows at most
    dropped(docs.sparkSession, counts)
    return _RANK | {w: len(_RANK) + i + 1 for i, w in enumerate(own)}, pair_weights(dict(map(tuple, pairs)))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns and what digest() gives for each text."""
    known = docs.sparkSession.sparkContext.broadcast(learned(docs, text))

    def make():
        return lambda texts: list(zip(*(digest(t, *known.value) for t in texts))) if texts else [[] for _ in FIELDS]

    return map_texts(docs, keep, text, FIELDS, make)


def masked(text: str | None, mark: str = "[SECRET]", ranks: dict = _RANK, weights: dict | None = None) -> str | None:
    """text with every span replaced; spans that touch or overlap become one mark."""
    spans = scan(text, ranks=ranks, weights=weights)
    if not spans:
        return text
    parts, end, cut = [], 0, -1
    for s, e, _ in spans:
        if s > cut:
            parts += [text[end:s], mark]
        cut = end = max(cut, e)
    return "".join(parts) + text[end:]


def mask_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with secrets masked; the columns stay, and the length column follows the text if there is one."""
    known = docs.sparkSession.sparkContext.broadcast(learned(docs, text))

    def make():
        ranks, weights = known.value
        return lambda texts: [[masked(t, ranks=ranks, weights=weights) for t in texts]]

    out = map_texts(docs, docs.columns, text, [("__masked", "string")], make)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("__masked").alias(c))
        elif c == length:
            changed = ~F.col(f"`{text}`").eqNullSafe(F.col("__masked"))
            columns.append(F.when(changed, F.length("__masked")).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), ["doc_id"])
