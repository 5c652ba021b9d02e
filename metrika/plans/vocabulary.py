"""Named queries over the words of whole tables: rhyme groups, line ends, forests, learned feature spaces.

They join the catalogue's queries. The last words of a document's neighbouring lines are its
ends; all pairs of different ends are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrika.functions import phonology as P
from metrika.functions import tables as T
from metrika.operators import audit, components, g2p, kernel, rhymes, scan, tokenize
from metrika.plans import catalogue as C
from metrika.plans import oracle as O
from metrika.plans import scanner_sql as S
from metrika.plans.catalogue import query
from metrika.sources import lexicon, verses


def _voiced(spark: SparkSession, words: DataFrame) -> DataFrame:
    """word, variants of distinct words."""
    pron = g2p.pronounce(words, lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))
    return pron.select("word", F.col("prons").alias("variants"))


def _groups(spark: SparkSession, words: DataFrame) -> DataFrame:
    voiced = components.settled(_voiced(spark, words))
    found = components.group_rhymes(voiced.select("word", F.col("word").alias("idx"), "variants"))
    return found.select("word", "component")


@query()
def vocabulary_rhyme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the first word of its rhyme group."""
    return _groups(spark, C._words(spark, sf_dir))


_TAILS = f"""vt as (select word, variant_idx, list_transform(s[{O.TAIL}:len(s)], lambda y: {{'n': y.n, 'c': y.c, 'w': y.n = 'AH' and y.st = 0 and len(y.c) = 0}}) t from sy3 where len(s) > 0),
    tails as (select t, row_number() over (order by t) id from (select distinct t from vt)),
    vv as (select word, variant_idx, id from vt join tails using (t))"""
_BENCHMARK_GROUPS = f"""with recursive {O.words_of("benchmark")}, {O.LEXICON}, {O.CHAIN}, {O.syllables("pron", "word, source, cost, variant_idx")}, {_TAILS}, {O.VOWEL_D}, {O.CONSONANT_D},
    near as (select a.id a_id, b.id b_id from tails a, tails b where a.id < b.id and least(len(a.t), len(b.t)) >= 0.75 * greatest(len(a.t), len(b.t))), {S.ALIGNED},
    hd as (select id, min(word) h from vv group by id),
    ed as (select x.h a, y.h b from fin join hd x on x.id = a_id join hd y on y.id = b_id where plain >= 0.75 union select word, h from vv join hd using (id)),
    lk as (select * from ed union select b, a from ed),
    rc as (select word, word r from words union select rc.word, lk.b from rc join lk on lk.a = rc.r)
    select word, min(r) component from rc group by word"""


@query(_BENCHMARK_GROUPS)
def benchmark_rhyme_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark's items with the first word of its rhyme group."""
    words = verses.benchmark(spark, sf_dir).select(F.explode(tokenize.words_of(F.col("text"))).alias("word"))
    return _groups(spark, words.select(F.lower("word").alias("word")).distinct())


def line_ends(verse_table: DataFrame, max_line_gap: int = scan.MAX_LINE_GAP) -> DataFrame:
    """w1 < w2: distinct pairs of different last words (lower case) of lines that are at most max_line_gap apart."""
    ends = F.transform(tokenize.lines_of(F.col("text")), lambda raw: F.lower(F.try_element_at(tokenize.words_of(raw), F.lit(-1))))
    with_next = P.let(ends, lambda e: F.transform(e, lambda w, i: F.struct(w.alias("w"), F.slice(e, i + 2, max_line_gap).alias("next"))))
    rows = verse_table.select(F.explode(with_next).alias("e")).select("e.w", F.explode("e.next").alias("v"))
    return rows.where("w <> v").select(F.least("w", "v").alias("w1"), F.greatest("w", "v").alias("w2")).distinct()


_ENDS = f"""{C._SYL}, {C._tokens("documents", "doc_id")},
    en as (select verse_id, line, lower(w[len(w)]) e from (select verse_id, line, regexp_extract_all(raw, '[a-zA-Z'']+') w from li) where len(w) > 0),
    wp as (select distinct least(x.e, y.e) w1, greatest(x.e, y.e) w2 from en x join en y on y.verse_id = x.verse_id and y.line between x.line + 1 and x.line + 2 where x.e <> y.e),
    {_TAILS.replace("from sy3 where", "from sy3 where word in (select e from en) and")}, {O.VOWEL_D}, {O.CONSONANT_D},
    near as (select w1, w2, x.id a_id, y.id b_id, x.variant_idx a_idx, y.variant_idx b_idx from wp join vv x on x.word = w1 join vv y on y.word = w2), {S.ALIGNED}"""


@query(f"""{_ENDS}, sc as (select w1, w2, max(plain) s, max(plain) filter (a_idx = 0 and b_idx = 0) f from near join fin using (a_id, b_id) group by 1, 2)
    select w1, w2, round(coalesce(s, 0), 6) score, coalesce(s, 0) >= 0.75 is_rhyme, round(coalesce(f, 0), 6) first_score, coalesce(f, 0) >= 0.75 is_first_rhyme from wp left join sc using (w1, w2)""")
def end_rhymes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of neighbouring lines of the documents: the best score of their variants, that of their first ones, and whether they rhyme."""
    pairs = components.settled(line_ends(verses.documents(spark, sf_dir)))
    words = pairs.select(F.col("w1").alias("word")).unionByName(pairs.select(F.col("w2").alias("word"))).distinct()
    voiced = components.settled(_voiced(spark, words))
    first = voiced.select("word", F.slice("variants", 1, 1).alias("variants"))
    out = kernel.best_scores(pairs, voiced).join(kernel.best_scores(pairs, first).withColumnRenamed("score", "first"), ["w1", "w2"])
    return out.select("w1", "w2", F.round("score", 6).alias("score"), (F.col("score") >= kernel.THRESHOLD).alias("is_rhyme"), F.round("first", 6).alias("first_score"), (F.col("first") >= kernel.THRESHOLD).alias("is_first_rhyme"))


def aligned_symbols(aligned: DataFrame) -> DataFrame:
    """kind, a, b: the nuclei of each column of two syllables, and their coda consonants in equal places; aligned: a, b (coded tails), alignment with path."""
    path = F.col("alignment.path")
    upto = lambda k, letter: F.length(F.replace(F.substring(path, F.lit(1), k), F.lit(letter), F.lit("")))
    columns = F.transform(F.sequence(F.lit(1), F.length(path)), lambda k: F.struct(F.substring(path, k, F.lit(1)).alias("step"), F.get("a", upto(k, "b") - 1).alias("x"), F.get("b", upto(k, "a") - 1).alias("y")))
    rows = aligned.select(F.explode(F.filter(columns, lambda c: c["step"] == "d")).alias("c")).select("c.x", "c.y")
    nuclei, consonants = (F.array(*map(F.lit, names)) for names in (T.VOWELS, T.CONSONANTS))
    codas = F.slice(F.arrays_zip(F.col("x.c").alias("p"), F.col("y.c").alias("q")), F.lit(1), F.least(F.size("x.c"), F.size("y.c")))
    vowels = rows.select(F.lit("vowel").alias("kind"), F.get(nuclei, F.col("x.v")).alias("a"), F.get(nuclei, F.col("y.v")).alias("b"))
    return vowels.unionByName(rows.select(F.explode(codas).alias("z")).select(F.lit("consonant").alias("kind"), F.get(consonants, F.col("z.p")).alias("a"), F.get(consonants, F.col("z.q")).alias("b")))


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, a, b of the columns of the documents' rhyming ends, a pair of tails once.

    Pairs go by the numbers of their tails; those that may rhyme are found in arrays, and only they are aligned with a path.
    """
    pairs = components.settled(line_ends(verses.documents(spark, sf_dir)))
    words = pairs.select(F.col("w1").alias("word")).unionByName(pairs.select(F.col("w2").alias("word"))).distinct()
    # an outer explode, as for an inner one a filter is inferred that would make every pronunciation twice
    variants = _voiced(spark, words).select("word", F.explode_outer("variants").alias("v")).where("v is not null")
    spelt = components.settled(variants.select("word", kernel.coded(P.rhyme_tail(F.col("v"))).alias("t")))
    tails = components.settled(spelt.select("t").distinct().select(F.monotonically_increasing_id().alias("id"), "t"))
    ids = spelt.join(tails, "t").select("word", "id").distinct()
    side = lambda k, c: ids.select(F.col("word").alias(f"w{k}"), F.col("id").alias(c))
    both = pairs.join(side(1, "a"), "w1").join(side(2, "b"), "w2").select("a", "b").distinct()
    near = rhymes.reaching(rhymes.with_tails(both, tails), kernel.THRESHOLD - 1e-6).select("a", "b")
    near = g2p.spread(rhymes.with_tails(near, tails).select(F.col("t1").alias("a"), F.col("t2").alias("b")))
    return components.settled(aligned_symbols(components.settled(kernel.score_tails(near, "a", "b")).where(F.col("score") >= kernel.THRESHOLD)))


_LEARNED = f"""{_ENDS}, rp as (select x.t a, y.t b, path, unnest(range(1, len(path) + 1)) k from fin join tails x on x.id = a_id join tails y on y.id = b_id where plain >= 0.75),
    cl as (select a[length(replace(substr(path, 1, k), 'b', ''))] x, b[length(replace(substr(path, 1, k), 'a', ''))] y from rp where substr(path, k, 1) = 'd'),
    sb as (select 'vowel' kind, x.n a, y.n b from cl union all select 'consonant', x.c[i], y.c[i] from (select x, y, unnest(range(1, least(len(x.c), len(y.c)) + 1)) i from cl)),
    se as (select kind, least(a, b) a, greatest(a, b) b, count(*) n from sb group by 1, 2, 3),
    mg as (select kind, s, sum(n) k from (select kind, a s, n from se union all select kind, b, n from se) group by 1, 2),
    tt as (select kind, sum(n) total from se group by 1),
    lo as (select se.kind, se.a, se.b, se.n, ln(se.n / (case when se.a = se.b then 1.0::DOUBLE else 2.0::DOUBLE end * x.k * y.k / (4.0::DOUBLE * total))) v from se join mg x on x.kind = se.kind and x.s = se.a join mg y on y.kind = se.kind and y.s = se.b join tt on tt.kind = se.kind)"""
_SYMBOLS = f"""sm(kind, s, i) as ({O.values([("vowel", s, i) for i, s in enumerate(T.VOWELS)] + [("consonant", s, i) for i, s in enumerate(T.CONSONANTS)])}),
    ds as (select 'vowel' kind, * from vd union all select 'consonant', * from cd),
    au as (select lo.kind, case when x.i < y.i then x.s else y.s end a, case when x.i < y.i then y.s else x.s end b, least(x.i, y.i) i, greatest(x.i, y.i) j, v corpus, n, 1.0::DOUBLE - ds.d ours
        from lo join sm x on x.kind = lo.kind and x.s = lo.a join sm y on y.kind = lo.kind and y.s = lo.b join ds on ds.kind = lo.kind and ds.a = case when x.i < y.i then x.s else y.s end and ds.b = case when x.i < y.i then y.s else x.s end where x.i <> y.i),
    rk as (select *, rank() over (partition by kind order by round(ours, 9) desc) + (count(*) over (partition by kind, round(ours, 9)) - 1) / 2.0 ro, rank() over (partition by kind order by round(corpus, 9) desc) + (count(*) over (partition by kind, round(corpus, 9)) - 1) / 2.0 rc from au)"""


@query(f"{_LEARNED} select kind, a, b, n::bigint n, round(v, 6) log_odds from lo")
def learned_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds of phonemes that stand in one column of rhyming ends of the documents."""
    pairs = _learned(spark, sf_dir)
    found = [audit.log_odds(pairs.where(F.col("kind") == k)).withColumn("kind", F.lit(k)) for k in ("vowel", "consonant")]
    return found[0].unionByName(found[1]).select("kind", "a", "b", "n", F.round("log_odds", 6).alias("log_odds"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, pair_idx, a, b, ours, corpus, n of pairs of different phonemes, with both ranks by kind."""
    pairs = _learned(spark, sf_dir)
    parts = [audit.learned_audit(pairs.where(F.col("kind") == k), s, d).withColumn("kind", F.lit(k)) for k, s, d in (("vowel", T.VOWELS, T.VOWEL_DISTANCES), ("consonant", T.CONSONANTS, T.CONSONANT_DISTANCES))]
    rows = components.settled(parts[0].unionByName(parts[1]).withColumn("ours", F.round("ours", 9)).withColumn("corpus", F.round("corpus", 9)))
    return audit.ranks(audit.ranks(rows, "ours", "rank_ours", "kind"), "corpus", "rank_corpus", "kind")


@query(f"{_LEARNED}, {_SYMBOLS} select kind, (i * (2 * case when kind = 'vowel' then {len(T.VOWELS)} else {len(T.CONSONANTS)} end - 3 - i) / 2 + j - 1)::int pair_idx, a, b, n::bigint n, round(ours, 6) ours, round(corpus, 6) corpus, ro::DOUBLE rank_ours, rc::DOUBLE rank_corpus, abs(ro - rc)::DOUBLE gap from rk")
def learned_rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature space beside what the documents' rhyming ends teach: each pair of phonemes with both ranks."""
    out = _audited(spark, sf_dir).withColumn("gap", F.abs(F.col("rank_ours") - F.col("rank_corpus")))
    return out.select("kind", "pair_idx", "a", "b", "n", F.round("ours", 6).alias("ours"), F.round("corpus", 6).alias("corpus"), "rank_ours", "rank_corpus", "gap")


@query(f"{_LEARNED}, {_SYMBOLS} select kind, count(*)::bigint pairs, round(corr(ro, rc), 6) rho from rk group by 1")
def learned_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the feature space with what the documents' rhyming ends teach, for vowels and consonants."""
    return _audited(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("pairs"), F.round(F.corr("rank_ours", "rank_corpus"), 6).alias("rho"))


_FREQUENCIES = f"""{C._SYL}, n as (select lower(w) word, count(*) c from (select unnest(regexp_extract_all(text, '[a-zA-Z'']+')) w from documents) group by 1),
    t as (select array_to_string(list_transform(s[{O.TAIL}:len(s)], lambda x: array_to_string(list_concat([x.n], x.c), ' ')), ' . ') tail, sum(c)::bigint tokens, count(*)::bigint words from sy3 join n using (word) where variant_idx = 0 group by 1)
    select *, (rank() over (order by tokens desc) + (count(*) over (partition by tokens) - 1) / 2.0)::DOUBLE rank_tokens, (rank() over (order by words desc) + (count(*) over (partition by words) - 1) / 2.0)::DOUBLE rank_words from t"""


@query(_FREQUENCIES)
def tail_frequency_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rhyme tails (rimes only) of the documents with their ranks by tokens and by words, ties sharing their mean rank."""
    counts = verses.documents(spark, sf_dir).select(F.explode(tokenize.words_of(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("c"))
    pron = g2p.pronounce(counts.select("word"), lexicon.seed_lexicon(spark), lexicon.slang_lexicon(spark))
    tail = F.array_join(F.transform(P.rhyme_tail(F.get("prons", F.lit(0))), lambda x: F.array_join(P.rime(x), " ")), " . ")
    rows = pron.select("word", tail.alias("tail")).join(counts, "word").groupBy("tail").agg(F.sum("c").alias("tokens"), F.count("*").alias("words"), F.max(F.col("tail").isNotNull()).alias("known"))
    rows = components.settled(rows.where("known").drop("known"))
    return audit.ranks(audit.ranks(rows, "tokens", "rank_tokens"), "words", "rank_words")


_CUTS = (0.75, 0.85, 0.95)
_AT = "{{'l': {0}_line, 's': {0}_start, 'n': {0}_n_words, 'a': {0}_anchor}}"


@query(f"""{C._CANDIDATES}, {S.MATCHES}, ct(cut) as (values {", ".join(f"({c}::DOUBLE)" for c in _CUTS)}),
    eg as (select verse_id, {_AT.format("a")} a, {_AT.format("b")} b, score from ma), no as (select verse_id, a node from eg union select verse_id, b from eg),
    ec as (select cut, verse_id, a, b from eg, ct where score >= cut), lk as (select * from ec union select cut, verse_id, b, a from ec),
    rc as (select cut, verse_id, node, node r from no, ct union select rc.cut, rc.verse_id, rc.node, lk.b from rc join lk on lk.cut = rc.cut and lk.verse_id = rc.verse_id and lk.a = rc.r)
    select verse_id, cut threshold, node.l line, node.s start, node.n n_words, node.a anchor, min(r).l root_line, min(r).s root_start, min(r).n root_n_words, min(r).a root_anchor from rc group by verse_id, cut, node""")
def grouping_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhyme classes of the benchmark's matched candidates at three thresholds, all cut from one spanning forest."""
    s = C._scan(spark, sf_dir)
    at = lambda x: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in scan.KEY[1:]])
    edges = components.settled(s.matches.select(F.col("verse_id").alias("scope"), at("a").alias("a"), at("b").alias("b"), "score"))
    forest = components.spanning_forest(edges)
    cuts = F.explode(F.array(*map(F.lit, _CUTS))).alias("cut")
    whole = lambda df, *c: df.select("scope", cuts, *c)
    nodes = whole(edges.select("scope", F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select(F.struct("scope", "cut").alias("scope"), "node")
    kept = whole(forest, "a", "b", "score").where("score >= cut").select(F.struct("scope", "cut").alias("scope"), "a", "b")
    found = components.connected_components(nodes, kept)
    return found.select(F.col("scope.scope").alias("verse_id"), F.col("scope.cut").alias("threshold"), "node.*", *[F.col(f"component.{c}").alias(f"root_{c}") for c in scan.KEY[1:]])


_BIGRAMS = f"""{C._SYL}, {C._tokens("documents", "doc_id")},
    bg as (select distinct lower(a.word) w1, lower(b.word) w2 from tk a join tk b on b.verse_id = a.verse_id and b.line = a.line and b.word_idx = a.word_idx + 1),
    vr as (select word, s, row_number() over (partition by word order by variant_idx) - 1 v, count(*) over (partition by word) nv from sy3 where len(s) > 0)
    select w1 || ' ' || w2 span, (a.v * b.nv + b.v)::int variant_idx, w1 || ' ' || w2 || ': ' || array_to_string(list_transform(list_concat(a.s, b.s), lambda x: array_to_string(list_concat(list_concat(x.o, [x.n || x.st::varchar]), x.c), ' ')), ' . ') pronunciation
    from bg join vr a on a.word = w1 join vr b on b.word = w2"""


def _adjacent(spark: SparkSession, sf_dir: str, only_first: bool = False) -> DataFrame:
    """span, variant_idx, pronunciation of neighbouring words; each word's variants are spelt once, and pairs join the spellings."""
    lines = tokenize.verse_lines(verses.documents(spark, sf_dir)).select(tokenize.words_of(F.lower("raw")).alias("ws"))
    pairs = F.transform(F.slice("ws", F.lit(2), F.size("ws")), lambda w, i: F.struct(F.get("ws", i).alias("w1"), w.alias("w2")))
    spans = components.settled(lines.select(F.explode(pairs).alias("p")).select("p.*").distinct())
    words = spans.select(F.col("w1").alias("word")).distinct().unionByName(spans.select(F.col("w2").alias("word")).distinct())
    variants = F.slice("variants", 1, 1) if only_first else F.col("variants")
    lists = components.settled(_voiced(spark, words).select("word", F.transform(variants, P.syllables_text).alias("v"))).where(F.size("v") > 0)
    out = g2p.pair_readings(spans, lists)
    span = F.concat_ws(" ", "w1", "w2")
    return out.select(span.alias("span"), "variant_idx", F.concat(span, F.lit(": "), "v1", F.lit(" . "), "v2").alias("pronunciation"))


@query(_BIGRAMS)
def adjacent_span_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of every distinct pair of neighbouring words of the documents; a pair with a word that can't be voiced has none."""
    return _adjacent(spark, sf_dir)


def _end_tails(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of ends (w1, w2), and the tails (word, idx, t) of all ends' variants."""
    pairs = components.settled(line_ends(verses.documents(spark, sf_dir)))
    words = pairs.select(F.col("w1").alias("word")).unionByName(pairs.select(F.col("w2").alias("word"))).distinct()
    variants = _voiced(spark, words).select("word", F.posexplode("variants").alias("idx", "v"))
    return pairs, components.settled(variants.select("word", "idx", kernel.coded(P.rhyme_tail(F.col("v"))).alias("t")))


@query(f"""{_ENDS} select w1, a_idx::int i1, w2, b_idx::int i2, round(plain, 6) score, cols::int n_cols, length(replace(path, 'd', ''))::int n_gaps, path from near join fin using (a_id, b_id)""")
def end_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all variants of the documents' neighbouring ends; path: d both, a or b alone. Equal pairs of tails are aligned once."""
    pairs, tails = _end_tails(spark, sf_dir)
    side = lambda k, t: tails.select(F.col("word").alias(f"w{k}"), F.col("idx").alias(f"i{k}"), F.col("t").alias(t))
    both = components.settled(pairs.join(side(1, "a"), "w1").join(side(2, "b"), "w2"))
    aligned = kernel.score_tails(both.select("a", "b").distinct(), "a", "b")
    out = both.join(aligned, ["a", "b"])
    return out.select("w1", "i1", "w2", "i2", F.round("score", 6).alias("score"), F.col("alignment.columns").alias("n_cols"), F.col("alignment.gaps").alias("n_gaps"), F.col("alignment.path").alias("path"))


@query(f"""{_LEARNED}, ds as (select 'vowel' kind, * from vd union all select 'consonant', * from cd)
    select se.kind, se.a, se.b, n::bigint n, round(d, 9) distance, round(1 - d, 9) similarity from se join ds on ds.kind = se.kind and ds.a = se.a and ds.b = se.b""")
def column_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two phonemes stand in one column of the documents' rhyming ends, and how far apart they are."""
    seen = _learned(spark, sf_dir).groupBy("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    a, b = F.col("a"), F.col("b")
    of = lambda v, c: F.round(F.when(F.col("kind") == "vowel", v(a, b)).otherwise(c(a, b)), 9)
    return seen.select("kind", "a", "b", "n", of(P.vowel_distance, P.consonant_distance).alias("distance"), of(P.vowel_similarity, P.consonant_similarity).alias("similarity"))


_CLUSTERS = f"""{C._SYL}, cu as (select list_concat(s[i].c, s[i + 1].o) c from (select s, unnest(range(1, len(s))) i from sy3)), cn as (select c, count(*) n from cu group by 1),
    k as (select c, n, {O._onset_length("c")} k from cn)
    select array_to_string(c, ' ') as cluster, n::bigint n, k = len(c) legal, array_to_string(c[1:len(c) - k], ' ') coda, array_to_string(c[len(c) - k + 1:len(c)], ' ') onset from k"""


@query(_CLUSTERS)
def consonant_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of consonants between vowels in the documents' words: how many, whether a run is a legal onset, and how it is split."""
    s = C._variants(spark, sf_dir).select(F.transform(F.slice("s", F.lit(2), F.size("s")), lambda x, i: F.concat(F.get("s", i)["coda"], x["onset"])).alias("c"))
    runs = s.select(F.explode("c").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    split = P.split_consonants(F.col("c"))
    return runs.select(F.array_join("c", " ").alias("cluster"), "n", P.is_legal_onset(F.col("c")).alias("legal"), F.array_join(split["coda"], " ").alias("coda"), F.array_join(split["onset"], " ").alias("onset"))


@query(_BIGRAMS.replace("select w1 || ' ' || w2 span, (a.v * b.nv + b.v)::int variant_idx,", "select w1 || ' ' || w2 span,") + " where a.v = 0 and b.v = 0")
def adjacent_span_pronunciation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading of every distinct pair of neighbouring words of the documents."""
    return _adjacent(spark, sf_dir, only_first=True).drop("variant_idx")


_GROUP_MEANS = " , ".join(f"(select avg(v) from lo where kind = 'consonant' and (a, b) in ({', '.join(str(tuple(sorted(p))) for p in pairs)})) {name}" for name, pairs in (("nasal", audit.NASALS), ("oral", audit.ORALS)))


@query(f"{_LEARNED}, m as (select {_GROUP_MEANS}) select round(nasal, 6) nasal, round(oral, 6) oral, nasal > oral captured from m")
def learned_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean learned log-odds of nasals and of oral stops in different places; null for a group that is never seen."""
    found = audit.log_odds(_learned(spark, sf_dir).where("kind = 'consonant'"))
    mean = lambda pairs: F.round(F.avg(F.when(F.struct("a", "b").isin([F.struct(*map(F.lit, sorted(p))) for p in pairs]), F.col("log_odds"))), 6)
    return found.agg(mean(audit.NASALS).alias("nasal"), mean(audit.ORALS).alias("oral")).withColumn("captured", F.col("nasal") > F.col("oral"))
