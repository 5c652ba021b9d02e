"""Named queries of the phonetic engine, each over whole tables, and their SQL equivalents.

`documents` (verse_id = doc_id) feeds what is linear in the text; `benchmark` (verse_id =
item_id) feeds the scanner. Word pairs come from the seed lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import audit, components, g2p, kernel, plan, scan, tokenize
from metrika.plans import oracle as O
from metrika.plans import scanner_sql as S
from metrika.sources import annotation, lexicon, verses

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses.documents(spark, sf_dir).select(F.explode(tokenize.words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("word")).distinct()


def _pron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g2p.pronounce(_words(spark, sf_dir), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an outer explode, as for an inner one a filter is inferred that would make every pronunciation twice
    return _pron(spark, sf_dir).select("word", "source", "cost", F.posexplode_outer("prons").alias("variant_idx", "s")).where("s is not null")


def _scan(spark: SparkSession, sf_dir: str) -> scan.VerseScan:
    return scan.scan_verse(verses.benchmark(spark, sf_dir), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))


_ALL_WORDS = f"with recursive {O.words_of('documents')}, {O.LEXICON}, {O.CHAIN}"
_SYL = f"{_ALL_WORDS}, {O.syllables('pron', 'word, source, cost, variant_idx')}"
_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"
_TOKENS = f"""li as (select verse_id, unnest(l) raw, unnest(range(len(l))) line from (select verse_id, case when text is null or text = '' then []::varchar[] when l[len(l)] = '' then l[:len(l) - 1] else l end l from (select @id verse_id, text, {_LINES} l from @table))),
    tk as (select verse_id, line, unnest(w) word, unnest(range(len(w))) word_idx from (select verse_id, line, regexp_extract_all(raw, '[a-zA-Z'']+') w from li))"""


def _tokens(name: str, key: str) -> str:
    return _TOKENS.replace("@id", key).replace("@table", name)


@query(f"with {_tokens('documents', 'doc_id')} select verse_id, line::int line, word_idx::int word_idx, word from tk")
def tokenize_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.tokenize_verse(verses.documents(spark, sf_dir))


@query(f"with {_tokens('documents', 'doc_id')} select verse_id, line::int line, unnest(c) as text, unnest(range(len(c)))::int cell_idx, regexp_matches(unnest(c), '^[a-zA-Z'']') is_word from (select verse_id, line, regexp_extract_all(raw, '[a-zA-Z'']+|[^a-zA-Z'']+') c from li)")
def verse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.verse_cells(verses.documents(spark, sf_dir))


@query(f"{_ALL_WORDS} select word, array_to_string(phones, ' ') phones from lts")
def g2p_letter_to_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = F.array_join(g2p.letter_to_sound(F.col("word")), " ")
    # an outer explode, as a filter on the phones themselves would make them twice
    out = g2p.spread(_words(spark, sf_dir)).select("word", F.explode_outer(F.array(phones)).alias("phones"))
    return out.where("phones is not null")


#: Words that the rare links of the chain know, as the documents' words may not reach them.
PROBES = sorted({r[0] for r in lexicon.SLANG_ROWS} | {w[:-2] + "a" for w, *_ in lexicon.SEED_ROWS if w.endswith("er")} | {w[:-1] + end for w, *_ in lexicon.SEED_ROWS if w.endswith("ing") for end in ("", "'")} | {"brrr", "coogi", "wakin'", "statin", "ba"})
_PROBED = _ALL_WORDS.replace("words as (", f"words as (select * from (values {', '.join('(' + O.quoted([w]) + ')' for w in PROBES)}) probe(word) union ", 1)


def _link(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words = _words(spark, sf_dir).unionByName(spark.createDataFrame([(w,) for w in PROBES], "word string")).distinct()
    made = g2p.chain(words, lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))
    return made.select("word", F.posexplode(name).alias("variant_idx", "p")).select("word", "variant_idx", F.array_join("p", " ").alias("phones"))


def _link_sql(name: str) -> str:
    return f"{_PROBED} select word, variant_idx::int variant_idx, array_to_string(phones, ' ') phones from {name}"


@query(_link_sql("slg"))
def g2p_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link(spark, sf_dir, "slang")


@query(f"{_PROBED} select word, source, variant_idx::int variant_idx, array_to_string(phones, ' ') phones from (select * from ing union all select * from stem)")
def g2p_g_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _link(spark, sf_dir, "g_drop").withColumn("source", F.lit("g-drop")).unionByName(_link(spark, sf_dir, "stem").withColumn("source", F.lit("stem+-in'")))
    return rows.select("word", "source", "variant_idx", "phones")


@query(_link_sql("ers"))
def g2p_a_for_er(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link(spark, sf_dir, "a_for_er")


@query(f"{_SYL} select word, source, cost, variant_idx::int variant_idx, array_to_string({O.SYLLABLE_TEXT}, ' . ') phones from sy3")
def pronounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("word", "source", "cost", "variant_idx", P.syllables_text(F.col("s")).alias("phones"))


@query(f"{_SYL} select word, variant_idx::int variant_idx, unnest(range(len(s)))::int syl_idx, array_to_string(unnest(s).o, ' ') onset, unnest(s).n nucleus, array_to_string(unnest(s).c, ' ') coda, unnest(s).st stress, array_to_string(list_concat([unnest(s).n], unnest(s).c), ' ') rime from sy3")
def syllabify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).select("word", "variant_idx", F.posexplode("s").alias("syl_idx", "x"))
    return rows.select("word", "variant_idx", "syl_idx", F.array_join("x.onset", " ").alias("onset"), F.col("x.nucleus").alias("nucleus"), F.array_join("x.coda", " ").alias("coda"), F.col("x.stress").alias("stress"), F.array_join(P.rime(F.col("x")), " ").alias("rime"))


@query(f"{_SYL} select word, variant_idx::int variant_idx, array_to_string(list_transform(s, lambda x: x.n), ' ') skeleton, array_to_string(list_transform(s, lambda x: x.st), ' ') stresses from sy3")
def vowel_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("word", "variant_idx", F.array_join(P.vowel_skeleton(F.col("s")), " ").alias("skeleton"), F.array_join(F.transform(P.stresses(F.col("s")), lambda x: x.cast("string")), " ").alias("stresses"))


@query(f"{_SYL} select word, variant_idx::int variant_idx, array_to_string(({O.SYLLABLE_TEXT})[{O.TAIL}:len(s)], ' . ') tail from sy3")
def rhyme_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("word", "variant_idx", P.syllables_text(P.rhyme_tail(F.col("s"))).alias("tail"))


_TOP = f"""{_SYL}, n as (select lower(w) word, count(*) c from (select unnest(regexp_extract_all(text, '[a-zA-Z'']+')) w from documents) group by 1),
    t as (select array_to_string(list_transform(s[{O.TAIL}:len(s)], lambda x: array_to_string(list_concat([x.n], x.c), ' ')), ' . ') tail, sum(c)::bigint tokens, count(*)::bigint words from sy3 join n using (word) where variant_idx = 0 group by 1)
    select * from t order by tokens desc, tail limit 50"""


@query(_TOP)
def top_rhyme_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 commonest rhyme tails (rimes only) by tokens; each distinct word is pronounced once."""
    counts = verses.documents(spark, sf_dir).select(F.explode(tokenize.words_of(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("c"))
    pron = g2p.pronounce(counts.select("word"), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))
    tail = F.array_join(F.transform(P.rhyme_tail(F.get("prons", F.lit(0))), lambda x: F.array_join(P.rime(x), " ")), " . ")
    rows = pron.select("word", tail.alias("tail")).join(counts, "word").groupBy("tail").agg(F.sum("c").alias("tokens"), F.count("*").alias("words"), F.max(F.col("tail").isNotNull()).alias("known"))
    # words without a pronunciation are one group; a filter before it would make every pronunciation twice
    return rows.where("known").drop("known").orderBy(F.col("tokens").desc(), "tail").limit(50)


@query(f"""{_ALL_WORDS}, {_tokens('documents', 'doc_id')},
    f as (select verse_id, lower(word) key, min((line, word_idx, word)) m from tk group by 1, 2),
    s as (select distinct word, source from pron)
    select verse_id, m[3] word, coalesce(source, 'oov') source, m[1]::int line, m[2]::int word_idx from f left join s on s.word = f.key where coalesce(source, 'oov') <> 'dictionary'""")
def word_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g2p.provenance(verses.documents(spark, sf_dir), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))


_CLUSTERS = f"""with ph(a) as (select unnest([{O.quoted(T.CONSONANTS)}])), cl as (select []::varchar[] c union all select [a] from ph union all select [x.a, y.a] from ph x, ph y union all select [x.a, y.a, z.a] from ph x, ph y, ph z),
    k as (select c, {O._onset_length('c')} k from cl)
    select array_to_string(c, ' ') as cluster, k = len(c) legal, array_to_string(c[1:len(c) - k], ' ') coda, array_to_string(c[len(c) - k + 1:len(c)], ' ') onset from k"""


@query(_CLUSTERS)
def split_consonants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster of up to three consonants: whether it is a legal onset, and how it is split between vowels."""
    one = spark.createDataFrame([(c,) for c in T.CONSONANTS], "a string")
    x, y, z = (F.broadcast(one.withColumnRenamed("a", n)) for n in "xyz")  # 24 rows
    key = F.lit(1)
    pair = x.withColumn("k", key).join(y.withColumn("k", key), "k")
    triple = pair.join(z.withColumn("k", key), "k")
    rows = spark.createDataFrame([([],)], "c array<string>").unionByName(one.select(F.array("a").alias("c"))).unionByName(pair.select(F.array("x", "y").alias("c"))).unionByName(triple.select(F.array("x", "y", "z").alias("c")))
    s = P.split_consonants(F.col("c"))
    return rows.select(F.array_join("c", " ").alias("cluster"), P.is_legal_onset(F.col("c")).alias("legal"), F.array_join(s["coda"], " ").alias("coda"), F.array_join(s["onset"], " ").alias("onset"))


@query(f"with {O.VOWEL_D} select a, b, round(d, 9) distance, round(1 - d, 9) similarity from vd")
def vowel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.distance_table(spark, T.VOWELS, T.VOWEL_DISTANCES).select("a", "b")
    return rows.select("a", "b", F.round(P.vowel_distance(F.col("a"), F.col("b")), 9).alias("distance"), F.round(P.vowel_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"with {O.CONSONANT_D} select a, b, round(d, 9) distance, round(1 - d, 9) similarity from cd")
def consonant_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.distance_table(spark, T.CONSONANTS, T.CONSONANT_DISTANCES).select("a", "b")
    return rows.select("a", "b", F.round(P.consonant_distance(F.col("a"), F.col("b")), 9).alias("distance"), F.round(P.consonant_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


_MATRIX = f"""sym(s, i) as ({O.values([(s, i) for i, s in enumerate(T.VOWELS)])}),
    rw(i, line) as ({O.values(list(enumerate(audit.VOWEL_LOG_ODDS.strip().splitlines())))}),
    up as (select i, unnest(v)::DOUBLE x, i + unnest(range(len(v))) j from (select i, string_split(line, ' ') v from rw)),
    lo as (select a.s a, b.s b, x, up.i, up.j from up join sym a on a.i = up.i join sym b on b.i = up.j)"""
_AUDIT = f"""with {O.VOWEL_D}, {_MATRIX}, p as (select lo.a, lo.b, row_number() over (order by i, j) - 1 pair_idx, 1 - d ours, x corpus from lo join vd on vd.a = lo.a and vd.b = lo.b where i < j),
    r as (select *, rank() over (order by ours desc) + (count(*) over (partition by ours) - 1) / 2.0 ro, rank() over (order by corpus desc) + (count(*) over (partition by corpus) - 1) / 2.0 rc from p)"""


@query(f"with {_MATRIX} select a, b, x log_odds from lo union all select b, a, x from lo where a <> b")
def parse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.parse_matrix(spark, T.VOWELS, audit.VOWEL_LOG_ODDS)


@query(f"{_AUDIT} select pair_idx::int pair_idx, a, b, round(ours, 6) ours, corpus, ro::DOUBLE rank_ours, rc::DOUBLE rank_corpus from r")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = audit.ranks(audit.ranks(audit.vowel_audit(spark), "ours", "rank_ours"), "corpus", "rank_corpus")
    return both.withColumn("ours", F.round("ours", 6))


@query(f"{_AUDIT} select count(*)::bigint n, round(corr(ro, rc), 6) rho from r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spearman(audit.vowel_audit(spark), "ours", "corpus").withColumn("rho", F.round("rho", 6))


@query(f"{_AUDIT} select pair_idx::int pair_idx, a, b, round(ours, 6) ours, corpus, ro::DOUBLE rank_ours, rc::DOUBLE rank_corpus, abs(ro - rc)::DOUBLE gap from r order by gap desc, pair_idx limit 10")
def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rank_report(audit.vowel_audit(spark), "ours", "corpus").withColumn("ours", F.round("ours", 6))


_MEANS = " , ".join(f"(select avg(1 - d) from cd where (a, b) in ({', '.join(str(p) for p in pairs)})) {name}" for name, pairs in (("nasal", audit.NASALS), ("oral", audit.ORALS)))


@query(f"with {O.CONSONANT_D}, m as (select {_MEANS}) select round(nasal, 6) nasal, round(oral, 6) oral, nasal > oral + 0.05 captured from m")
def group_mean_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.group_mean_check(spark).withColumn("nasal", F.round("nasal", 6)).withColumn("oral", F.round("oral", 6))


def _seed_words(spark: SparkSession) -> DataFrame:
    return g2p.by_word(lexicon.seed_lexicon(spark)).select("word", F.transform("variants", P.syllabify).alias("variants"))


def _seed_tails(spark: SparkSession) -> DataFrame:
    tail = P.rhyme_tail(P.syllabify(F.col("phones")))
    return lexicon.seed_lexicon(spark).select("word", "variant_idx", kernel.coded(tail).alias("t"))


_PAIRS = f"with recursive {O.SEED_TAILS}, pairs as (select a.id va, b.id vb from var a, var b where a.word < b.word), {O.ALIGN}"


@query(f"{_PAIRS} select a.word w1, a.variant_idx::int i1, b.word w2, b.variant_idx::int i2, score, cols::int n_cols, gaps::int n_gaps, path from best join var a on a.id = va join var b on b.id = vb")
def align_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all pairs of variants of different seed words; path: d both, a or b alone."""
    t = _seed_tails(spark)
    a, b = t.select(F.col("word").alias("w1"), F.col("variant_idx").alias("i1"), F.col("t").alias("a")), t.select(F.col("word").alias("w2"), F.col("variant_idx").alias("i2"), F.col("t").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("w1") < F.col("w2"))  # the seed lexicon: 107 rows
    out = kernel.score_tails(pairs, "a", "b")
    return out.select("w1", "i1", "w2", "i2", F.round("score", 6).alias("score"), F.col("alignment.columns").alias("n_cols"), F.col("alignment.gaps").alias("n_gaps"), F.col("alignment.path").alias("path"))


def _word_pairs(spark: SparkSession) -> DataFrame:
    w = _seed_words(spark).select("word")
    return w.select(F.col("word").alias("w1")).join(F.broadcast(w.select(F.col("word").alias("w2"))), F.col("w1") < F.col("w2"))


@query(f"{_PAIRS} select a.word w1, b.word w2, max(score) score, max(score) >= 0.75 is_rhyme from best join var a on a.id = va join var b on b.id = vb group by 1, 2")
def best_rhyme_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernel.best_scores(_word_pairs(spark), _seed_words(spark))
    return out.select("w1", "w2", F.round("score", 6).alias("score"), (F.col("score") >= kernel.THRESHOLD).alias("is_rhyme"))


@query(f"{_PAIRS} select a.word w1, b.word w2, score from best join var a on a.id = va join var b on b.id = vb where a.variant_idx = 0 and b.variant_idx = 0 and score >= 0.75")
def rhyme_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First variants of seed words that rhyme."""
    t = _seed_tails(spark).where("variant_idx = 0")
    a, b = t.select(F.col("word").alias("w1"), F.col("t").alias("a")), t.select(F.col("word").alias("w2"), F.col("t").alias("b"))
    out = kernel.score_tails(a.join(F.broadcast(b), F.col("w1") < F.col("w2")), "a", "b").where(F.col("score") >= kernel.THRESHOLD)
    return out.select("w1", "w2", F.round("score", 6).alias("score"))


_GROUPS = f"""{_PAIRS}, ed as (select a.word x, b.word y from best join var a on a.id = va join var b on b.id = vb group by 1, 2 having max(score) >= @cut),
    sym as (select x, y from ed union select y, x from ed), nd as (select distinct word from var),
    reach as (select word, word r from nd union select reach.word, sym.y from reach join sym on sym.x = reach.r)
    select word, min(r) component from reach group by word"""


def _grouped(spark: SparkSession, threshold: float) -> DataFrame:
    w = _seed_words(spark).withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")))  # the seed lexicon: 90 rows
    found = components.group_rhymes(w, threshold)
    names = w.select(F.col("idx").alias("component"), F.col("word").alias("first"))
    return found.join(names, "component").select("word", F.col("first").alias("component"))


@query(_GROUPS.replace("@cut", "0.75"))
def group_rhymes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, 0.75)


@query(_GROUPS.replace("@cut", "0.92"))
def group_rhymes_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, 0.92)


@query(f"""with recursive {O.LEXICON}, {O.syllables('lex', 'word, variant_idx')},
    x as (select a.word || ' ' || b.word span, list_concat(a.s, b.s) s, row_number() over (partition by a.word, b.word order by a.variant_idx, b.variant_idx) - 1 variant_idx from sy3 a, sy3 b where a.word < b.word)
    select span, variant_idx::int variant_idx, span || ': ' || array_to_string({O.SYLLABLE_TEXT}, ' . ') pronunciation from x""")
def pronunciations_for_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of variants for each pair of seed words."""
    spans = _word_pairs(spark).select(F.concat_ws(" ", "w1", "w2").alias("span_id"), F.array("w1", "w2").alias("words"))
    out = g2p.pronunciations_for_span(spans, lexicon.seed_lexicon(spark))
    return out.select(F.col("span_id").alias("span"), "variant_idx", P.pronunciation_text(F.col("pronunciation")).alias("pronunciation"))


@query(f"""with {_tokens('benchmark', 'item_id')}, g as (select verse_id, line, list(word order by word_idx) w from tk group by 1, 2)
    select verse_id, line::int line, (s - 1)::int start, k::int n_words, array_to_string(w[s:s + k - 1], ' ') words from g, range(1, 100000) r(s), range(1, 5) q(k) where s + k - 1 <= len(w)""")
def span_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.span_ngrams(tokenize.tokenize_verse(verses.benchmark(spark, sf_dir)))
    return out.select("verse_id", "line", "start", "n_words", F.array_join(F.transform("span", lambda w: w["word"]), " ").alias("words"))


_CANDIDATES = f"with recursive {S.readings(_tokens('benchmark', 'item_id'))}"
_SELECTED = f"{_CANDIDATES}, {S.MATCHES}, {S.SELECTED}"
_SCANNED = f"{_SELECTED}, {S.GROUPS}"
_COVERED = f"{_SCANNED}, {S.BEST}, {S.COVERING}"


@query(f"{_CANDIDATES} select * from ca")
def enumerate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).candidates


@query(f"""{_CANDIDATES} select a.verse_id, count(*)::bigint pairs from ca a join ca b on a.verse_id = b.verse_id and b.line between a.line and a.line + 2 and (b.line > a.line or b.start >= a.start + a.n_words) group by 1""")
def are_pairable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scan(spark, sf_dir).candidates.select(*scan.KEY)
    return scan.near(found, found).groupBy("verse_id").agg(F.count("*").alias("pairs"))


@query(f"{_CANDIDATES}, {S.MATCHES} select * replace (round(score, 6) as score) from ma")
def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).matches.withColumn("score", F.round("score", 6))


@query(f"{_SELECTED} select * replace (round(score, 6) as score) from se")
def select_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).selected.withColumn("score", F.round("score", 6))


@query(f"{_SCANNED} select * from grp")
def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).groups


@query(f"{_SELECTED}, {S.CHAINS} select verse_id, compound_idx, count(*)::int beats, '[' || string_agg(a_words, ' ' order by beat_idx) || '] ~ [' || string_agg(b_words, ' ' order by beat_idx) || '] (' || count(*) || case when count(*) = 1 then ' beat)' else ' beats)' end as text from chn group by 1, 2")
def chain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compound_text(_scan(spark, sf_dir).compounds)


@query(f"""{_SCANNED}, pv as (select verse_id, count(*) n from (select distinct verse_id, lower(tk.word) w, source from tk left join (select distinct word, source from pron) p on p.word = lower(tk.word) where coalesce(source, 'oov') <> 'dictionary') group by 1)
    select item_id verse_id, {", ".join(f"coalesce((select {c} from {t} x where x.verse_id = item_id), 0)::bigint {n}" for n, c, t in (("candidates", "count(*)", "ca"), ("matches", "count(*)", "ma"), ("selected", "count(*)", "se"), ("classes", "count(distinct class_idx)", "grp"), ("provenance", "max(n)", "pv")))} from benchmark""")
def scan_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a scan's stages by verse."""
    s = _scan(spark, sf_dir)
    out = s.verses.select("verse_id")
    for name, df in (("candidates", s.candidates), ("matches", s.matches), ("selected", s.selected), ("classes", s.groups.select("verse_id", "class_idx").distinct()), ("provenance", s.provenance)):
        out = out.join(df.groupBy("verse_id").agg(F.count("*").alias(name)), "verse_id", "left")
    return out.fillna(0)


@query(f"{_SELECTED}, {S.BEST} select * replace (round(score, 6) as score) from cb")
def candidate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.candidate_best(_scan(spark, sf_dir).selected).withColumn("score", F.round("score", 6))


@query(f"{_COVERED} select * replace (round(score, 6) as score) from cov")
def word_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scan(spark, sf_dir)
    return plan.word_covering(s.groups, plan.candidate_best(s.selected)).withColumn("score", F.round("score", 6))


@query(f"""{_COVERED}, wf as (select verse_id, line, word_idx, min_by(class_idx, "rank") fill, list(distinct class_idx) a from cov group by 1, 2, 3)
    select verse_id, line, word_idx, fill, array_to_string(list_sort(list_filter(a, lambda c: c <> fill)), ',') ticks from wf""")
def word_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scan(spark, sf_dir)
    return plan.word_fill(plan.word_covering(s.groups, plan.candidate_best(s.selected))).withColumn("ticks", F.array_join(F.transform("ticks", lambda t: t.cast("string")), ","))


@query(f"{_SCANNED}, {S.SLOTS} select * from sl")
def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.slot_assignment(_scan(spark, sf_dir).groups)


@query(f"{_SCANNED}, {S.LEGEND} select * from le")
def legend_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.legend_preview(_scan(spark, sf_dir).groups)


@query(f"{_SELECTED}, {S.CHAINS}, {S.RULES} select * from ru")
def compound_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.compound_rules(_scan(spark, sf_dir).compounds)


#: Verses with matches that describe the same event, so that selecting has to decide.
PROBE_VERSES = [(1, "wake up, take a cake and shake the state up\nfeeling great, no debate"), (2, "see me\nyou to\nplane man\nsane man"), (3, "spaghetti sofa the a and\n\nCoogi groovy brrr")]
_PROBE_TABLE = "benchmark_(item_id, text) as (values " + ", ".join(f"({i}::bigint, {O.quoted([t])})" for i, t in PROBE_VERSES) + ")"


def _of_probes(sql: str) -> str:
    return sql.replace("from benchmark", "from benchmark_").replace("with recursive ", f"with recursive {_PROBE_TABLE}, ", 1)


def _probe_scan(spark: SparkSession) -> scan.VerseScan:
    return scan.scan_verse(spark.createDataFrame(PROBE_VERSES, "verse_id long, text string"), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))


@query(_of_probes(f"{_CANDIDATES}, {S.MATCHES} select * replace (round(score, 6) as score) from ma"))
def find_matches_in_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe_scan(spark).matches.withColumn("score", F.round("score", 6))


@query(_of_probes(f"{_SELECTED} select * replace (round(score, 6) as score) from se"))
def select_matches_in_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe_scan(spark).selected.withColumn("score", F.round("score", 6))


@query(f"""{_CANDIDATES} select {S._AT}, words, idx::int reading_idx, round(cost, 6) as cost, array_to_string(list_transform(t, lambda x, i: array_to_string(list_concat(list_concat(x.o, [x.n || case when i = 1 then '1' else '0' end]), x.c), ' ')), ' . ') tail from cn""")
def anchored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from their anchor on as they are performed: the anchor stressed, what follows not."""
    out = _scan(spark, sf_dir).readings
    return out.select(*scan.KEY, "words", "reading_idx", F.round("cost", 6).alias("cost"), P.syllables_text(F.col("tail")).alias("tail"))


@query(f"{_CANDIDATES}, {S.MATCHES}, {S.SELECTED}, {S.GROUPS}, gt as (select verse_id, class_idx, count(*) n, 'group: ' || string_agg(words || '@' || (line + 1) || '.' || (start + 1) || case when n_words > 1 then '-' || (start + n_words) else '' end, ' ' order by member_idx) g from grp group by 1, 2) select item_id verse_id, 'verse:' || chr(10) || text || chr(10) || chr(10) || coalesce((select string_agg(g, chr(10) order by class_idx) from gt where verse_id = item_id and n > 1), '') annotation from benchmark")
def write_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rhyme classes of each verse as an annotation."""
    s = _scan(spark, sf_dir)
    refs = s.groups.select("verse_id", F.lit("group").alias("kind"), F.col("class_idx").alias("gid"), F.col("member_idx").alias("ref_idx"), F.col("words").alias("text"), "line", F.col("start").alias("w1"), (F.col("start") + F.col("n_words") - 1).alias("w2"))
    return annotation.write_annotations(s.verses, refs)


@query(f"{_CANDIDATES}, {S.MATCHES}, {S.SELECTED}, {S.GROUPS}, g as (select *, count(*) over (partition by verse_id, class_idx) n from grp) select verse_id, 'group' kind, (dense_rank() over (partition by verse_id order by class_idx) - 1)::int group_idx, member_idx ref_idx, words as text, line, start w1, (start + n_words - 1)::int w2 from g where n > 1")
def parse_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What write_annotations() wrote, read again; groups by their order in the text."""
    found = annotation.parse_annotations(write_annotations(spark, sf_dir))
    order = Window.partitionBy("verse_id").orderBy("gid")
    return found.select("verse_id", "kind", (F.dense_rank().over(order) - 1).alias("group_idx"), "ref_idx", "text", "line", "w1", "w2")


_DICTIONARY = f"with recursive {O.words_of('documents')}, {O.LEXICON}, {O.syllables('lex', 'word, variant_idx')}"


def _spelt(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, P.pronunciation_text(F.col("pronunciation")).alias("pronunciation"))


@query(f"{_DICTIONARY} select word, variant_idx::int variant_idx, word || ': ' || array_to_string({O.SYLLABLE_TEXT}, ' . ') pronunciation from sy3 semi join words using (word)")
def pronunciations_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelt(g2p.pronunciations_for(_words(spark, sf_dir), lexicon.seed_lexicon(spark)), "word", "variant_idx")


@query(f"{_DICTIONARY} select w.word, w.word || ': ' || array_to_string({O.SYLLABLE_TEXT}, ' . ') pronunciation from words w left join sy3 on sy3.word = w.word and variant_idx = 0")
def pronunciation_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelt(g2p.pronunciation_for(_words(spark, sf_dir), lexicon.seed_lexicon(spark)), "word")


@query(f"""with recursive {O.LEXICON}, {O.syllables('lex', 'word, variant_idx')},
    x as (select a.word || ' ' || b.word span, list_concat(a.s, b.s) s from sy3 a, sy3 b where a.word < b.word and a.variant_idx = 0 and b.variant_idx = 0)
    select span, span || ': ' || array_to_string({O.SYLLABLE_TEXT}, ' . ') pronunciation from x""")
def pronunciation_for_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first variants of each pair of seed words, joined."""
    spans = _word_pairs(spark).select(F.concat_ws(" ", "w1", "w2").alias("span_id"), F.array("w1", "w2").alias("words"))
    return _spelt(g2p.pronunciations_for_span(spans, lexicon.seed_lexicon(spark), only_first=True), "span_id").withColumnRenamed("span_id", "span")


@query(f"{_SYL} select word, variant_idx::int variant_idx, len(s)::int syllables, array_to_string({O.SYLLABLE_TEXT}, ' . ') phones from sy3")
def parse_arpabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's pronunciation written, read by parse_arpabet() and written again."""
    rows = _variants(spark, sf_dir).select("word", "variant_idx", P.parse_arpabet(P.syllables_text(F.col("s"))).alias("s"))
    return rows.select("word", "variant_idx", F.size("s").alias("syllables"), P.syllables_text(F.col("s")).alias("phones"))


@query(f"""{_DICTIONARY}, j as (select word, list(list_transform(s, lambda x: {{'o': x.o, 'n': x.n, 's': x.st::int, 'c': x.c}}) order by variant_idx) v from sy3 group by 1) select word, to_json(v)::varchar "json" from j semi join words using (word)""")
def lexicon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lexicon_json(lexicon.seed_lexicon(spark), _words(spark, sf_dir))[0]


_CUTS = (0.7, 0.8, 0.95)


@query(f"""{_PAIRS}, wp as (select a.word x, b.word y, max(score) score from best join var a on a.id = va join var b on b.id = vb group by 1, 2), ct(scope) as (values {", ".join(f"({c}::DOUBLE)" for c in _CUTS)}),
    ed as (select scope, x, y from wp, ct where score >= scope), sym as (select * from ed union select scope, y, x from ed),
    reach as (select scope, word, word r from (select distinct word from var), ct union select reach.scope, reach.word, sym.y from reach join sym on sym.scope = reach.scope and sym.x = reach.r)
    select scope threshold, word, min(r) component from reach group by 1, 2""")
def group_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhyme groups of the seed words at several thresholds at once, a scope each."""
    scores = kernel.best_scores(_word_pairs(spark), _seed_words(spark)).select(F.col("w1").alias("a"), F.col("w2").alias("b"), "score")
    cuts = spark.createDataFrame([(c,) for c in _CUTS], "scope double")
    own = scores.join(F.broadcast(cuts), F.round("score", 6) >= F.col("scope"))  # three thresholds
    nodes = _seed_words(spark).select(F.col("word").alias("node")).join(F.broadcast(cuts))
    found = components.group_by_threshold(nodes, own, 0.0)
    return found.select(F.col("scope").alias("threshold"), F.col("node").alias("word"), "component")


@query()
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.render_html(_scan(spark, sf_dir))


@query()
def render_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.render_terminal(_scan(spark, sf_dir))
