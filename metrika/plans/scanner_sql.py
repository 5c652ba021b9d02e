"""SQL of the scanner's queries: every stage in plain relations, alignment cell by cell in a recursion."""

from __future__ import annotations

from metrika.operators import scan
from metrika.plans import oracle as O

_AT = "verse_id, line, start, n_words, anchor"


def readings(tokens: str, most: int = scan.MAX_SPAN_WORDS) -> str:
    """rd: every reading of every span; cn: with its anchors. Needs verses' tokens (tk) by the given SQL, for `benchmark`."""
    spans = ["s1 as (select verse_id, line, word_idx start, 1 n_words, word words, word first, cost, s, len(s) k, v idx from pr)"]
    for n in range(2, most + 1):
        spans.append(
            f"s{n} as (select a.verse_id, a.line, a.start, {n} n_words, a.words || ' ' || b.word words, a.first, a.cost + b.cost as cost, list_concat(a.s, b.s) s, a.k, a.idx * b.nv + b.v idx"
            f" from s{n - 1} a join pr b on b.verse_id = a.verse_id and b.line = a.line and b.word_idx = a.start + {n - 1})"
        )
    every = " union all ".join(f"select * from s{n}" for n in range(1, most + 1))
    return f"""{O.words_of("benchmark")}, {O.LEXICON}, {O.CHAIN}, {O.syllables("pron", "word, source, cost, variant_idx")}, {tokens},
    vr as (select word, cost, s, row_number() over (partition by word order by variant_idx) - 1 v, count(*) over (partition by word) nv from sy3),
    pr as (select t.verse_id, t.line, t.word_idx, t.word, p.cost, p.v, p.nv, p.s from tk t join vr p on p.word = lower(t.word)),
    {", ".join(spans)},
    rd as ({every}),
    an as (select *, unnest(range(1, k + 1)) x from rd where lower(first) not in ({O.quoted(scan.NEVER_ANCHOR)})),
    cn as (select verse_id, line::int line, start::int start, n_words::int n_words, (x - 1)::int anchor, words, idx, s[x:len(s)] t,
        case when s[x].st = 0 or lower(first) in ({O.quoted(scan.FUNCTION_WORDS)}) then {scan.COERCION}::DOUBLE else 0::DOUBLE end + cost as cost from an where not (s[x].st = 0 and s[x].n = 'AH')),
    ca as (select {_AT}, words, count(*)::bigint n_readings, round(min(cost), 9) min_cost from cn group by all)"""


#: fin: the alignments of `near`'s pairs of `tails`, cell by cell, row after row; a cell keeps the best way to it.
ALIGNED = f"""prs as (select distinct a_id, b_id from near),
    sy as (select id, unnest(t) s, unnest(range(len(t))) pos from tails),
    us as (select distinct s.n n, s.c c from sy),
    cd2 as (select ac, bc, case when greatest(len(ac), len(bc)) = 0 then 1.0::DOUBLE else coalesce((select sum(1.0::DOUBLE - cd.d) from range(1, least(len(ac), len(bc)) + 1) r(i) join cd on cd.a = ac[i] and cd.b = bc[i]), 0) / greatest(len(ac), len(bc)) end co
        from (select distinct c ac from us) x, (select distinct c bc from us) y),
    ce as (select p.a_id, p.b_id, len(tb.t) n, x.pos * len(tb.t) + y.pos k, vd.d, (1.0::DOUBLE * (1.0::DOUBLE - vd.d) + 0.35::DOUBLE * cd2.co) / (1.0::DOUBLE + 0.35::DOUBLE) sc, (x.s.w and y.s.w) w
        from prs p join tails tb on tb.id = p.b_id join sy x on x.id = p.a_id join sy y on y.id = p.b_id join vd on vd.a = x.s.n and vd.b = y.s.n join cd2 on cd2.ac = x.s.c and cd2.bc = y.s.c),
    gr as (select a_id, b_id, n, count(*) cells, list({{'d': d, 'sc': sc, 'w': w}} order by k) g from ce group by a_id, b_id, n),
    dp as (
        select a_id, b_id, n, cells, g, 0::bigint k, list_transform(range(n + 1), lambda j: {{'cost': 0.6::DOUBLE * j, 'total': 0::DOUBLE, 'cols': j::bigint, 'inf': 0::bigint, 'p': repeat('b', j::bigint)}}) up, [{{'cost': 0.6::DOUBLE, 'total': 0::DOUBLE, 'cols': 1::bigint, 'inf': 0::bigint, 'p': 'a'}}] cur from gr
        union all
        select a_id, b_id, n, cells, g, k + 1, case when (k + 1) % n = 0 then new else up end,
            case when (k + 1) % n = 0 then [{{'cost': 0.6::DOUBLE * ((k + 1) // n + 1), 'total': 0::DOUBLE, 'cols': ((k + 1) // n + 1)::bigint, 'inf': 0::bigint, 'p': repeat('a', (k + 1) // n + 1)}}] else new end
        from (select a_id, b_id, n, cells, g, k, up, list_append(cur, case
                when lc < (case when uc < dc - 1e-12 then uc else dc end) - 1e-12 then {{'cost': lc, 'total': le.total, 'cols': le.cols + 1, 'inf': le.inf, 'p': le.p || 'b'}}
                when uc < dc - 1e-12 then {{'cost': uc, 'total': ab.total, 'cols': ab.cols + 1, 'inf': ab.inf, 'p': ab.p || 'a'}}
                else {{'cost': dc, 'total': co.total + h.sc, 'cols': co.cols + 1, 'inf': co.inf + case when h.w then 0 else 1 end, 'p': co.p || 'd'}} end) new
            from (select *, co.cost + h.d dc, ab.cost + 0.6::DOUBLE uc, le.cost + 0.6::DOUBLE lc
                from (select *, up[k % n + 1] co, up[k % n + 2] ab, cur[len(cur)] le, g[k + 1] h from dp where k < cells)))),
    fin as (select a_id, b_id, round(up[n + 1].total / up[n + 1].cols, 9) plain, up[n + 1].cols as cols, up[n + 1].inf inf, up[n + 1].p path from dp where k = cells)"""

#: ma: the matches.
MATCHES = f"""{O.VOWEL_D}, {O.CONSONANT_D},
    rt as (select {_AT}, words, idx, round(cost, 9) as cost, t[1].n nucleus, t[1].o onset, t[1].c coda, list_transform(t, lambda y, i: {{'n': y.n, 'c': y.c, 'w': i > 1 and y.n = 'AH' and len(y.c) = 0}}) t from cn),
    tails as (select t, row_number() over (order by t) id from (select distinct t from rt)),
    rr as (select rt.* exclude (t), tails.id from rt join tails on tails.t = rt.t),
    near as (select a.verse_id, {", ".join(f"{s}.{c} {s}_{c}" for s in "ab" for c in ("line", "start", "n_words", "anchor", "words", "idx", "cost", "id"))}
        from rr a join rr b on b.verse_id = a.verse_id and b.line between a.line and a.line + {scan.MAX_LINE_GAP} and (b.line > a.line or b.start >= a.start + a.n_words)
        join vd on vd.a = a.nucleus and vd.b = b.nucleus and 1.0::DOUBLE - vd.d >= {scan.SEED}
        where not (a.nucleus = b.nucleus and a.onset = b.onset and a.coda = b.coda)),
    {ALIGNED},
    hits as (select near.*, round(plain - a_cost - b_cost, 9) score, cols, inf from near join fin using (a_id, b_id) where plain >= 0.75),
    ma as (select verse_id, {", ".join(f"{s}_{c}" for s in "ab" for c in ("line", "start", "n_words", "anchor", "words"))}, score, cols::int length, inf::int informative_length from hits where score >= 0.75
        qualify row_number() over (partition by verse_id, {", ".join(f"{s}_{c}" for s in "ab" for c in ("line", "start", "n_words", "anchor", "words"))} order by score desc, a_idx, b_idx) = 1)"""

_COLUMNS = ["a_line", "a_start", "a_n_words", "a_anchor", "a_words", "b_line", "b_start", "b_n_words", "b_anchor", "b_words", "score", "length", "informative_length"]


def _overlap(s: str) -> str:
    return f"x.{s}_line = m.{s}_line and x.{s}_start < m.{s}_start + m.{s}_n_words and m.{s}_start < x.{s}_start + x.{s}_n_words"


#: se: what is selected, in the order in which it is taken.
SELECTED = f"""
    rk as (select verse_id, {{{", ".join(f"'{c}': {c}" for c in _COLUMNS)}}} m, row_number() over (partition by verse_id order by -score, -informative_length, length, b_line - a_line, b_start, a_line, a_start, a_n_words, a_anchor, b_line, b_n_words, b_anchor) r from ma),
    gd as (select verse_id, 1::bigint r, [m] taken from rk where r = 1 union all
        select gd.verse_id, rk.r, case when len(list_filter(taken, lambda x: {_overlap("a")} and {_overlap("b")})) > 0 then taken else list_append(taken, m) end from gd join rk on rk.verse_id = gd.verse_id and rk.r = gd.r + 1),
    gl as (select verse_id, taken from gd qualify row_number() over (partition by verse_id order by r desc) = 1),
    se as (select verse_id, sel_idx::int sel_idx, m.* from (select verse_id, unnest(taken) m, unnest(range(len(taken))) sel_idx from gl))"""

#: grp: rhyme classes of the matched candidates.
GROUPS = f"""
    nd as (select *, row_number() over (partition by verse_id order by line, start, n_words, anchor, words) i from (select verse_id, a_line line, a_start start, a_n_words n_words, a_anchor anchor, a_words words from se union select verse_id, b_line, b_start, b_n_words, b_anchor, b_words from se)),
    eg as (select x.verse_id, x.i a, y.i b from se join nd x on x.verse_id = se.verse_id and x.line = a_line and x.start = a_start and x.n_words = a_n_words and x.anchor = a_anchor and x.words = a_words
        join nd y on y.verse_id = se.verse_id and y.line = b_line and y.start = b_start and y.n_words = b_n_words and y.anchor = b_anchor and y.words = b_words),
    bo as (select * from eg union select verse_id, b, a from eg),
    rc as (select verse_id, i, i r from nd union select rc.verse_id, rc.i, bo.b from rc join bo on bo.verse_id = rc.verse_id and bo.a = rc.r),
    ro as (select verse_id, i, min(r) root from rc group by 1, 2),
    grp as (select nd.verse_id, (dense_rank() over (partition by nd.verse_id order by root) - 1)::int class_idx, (row_number() over (partition by nd.verse_id, root order by nd.i) - 1)::int member_idx, line, start, n_words, anchor, words from nd join ro on ro.verse_id = nd.verse_id and ro.i = nd.i)"""

#: chn: selected with compound_idx and beat_idx.
CHAINS = """
    sq as (select *, row_number() over (partition by verse_id order by a_line, a_start, sel_idx) i from se),
    ae as (select x.verse_id, x.i a, y.i b from sq x join sq y on y.verse_id = x.verse_id and y.a_line = x.a_line and y.a_start = x.a_start + x.a_n_words and y.b_line = x.b_line and y.b_start = x.b_start + x.b_n_words),
    ab2 as (select * from ae union select verse_id, b, a from ae),
    ac as (select verse_id, i, i r from sq union select ac.verse_id, ac.i, ab2.b from ac join ab2 on ab2.verse_id = ac.verse_id and ab2.a = ac.r),
    ar as (select verse_id, i, min(r) root from ac group by 1, 2),
    chn as (select sq.*, (dense_rank() over (partition by sq.verse_id order by root) - 1)::int compound_idx, (row_number() over (partition by sq.verse_id, root order by sq.i) - 1)::int beat_idx from sq join ar on ar.verse_id = sq.verse_id and ar.i = sq.i)"""

#: cb: each candidate's best match; cov: the candidates over each word.
BEST = """
    cb as (select verse_id, line, start, n_words, anchor, score, partner from (
        select verse_id, a_line line, a_start start, a_n_words n_words, a_anchor anchor, score, sel_idx, 0 side, b_words partner from se union all select verse_id, b_line, b_start, b_n_words, b_anchor, score, sel_idx, 1, a_words from se)
        qualify row_number() over (partition by verse_id, line, start, n_words, anchor order by score desc, sel_idx, side) = 1)"""
COVERING = """
    cw as (select grp.*, cb.score, cb.partner, unnest(range(grp.start, grp.start + grp.n_words))::int word_idx from grp join cb using (verse_id, line, start, n_words, anchor)),
    cov as (select verse_id, line, word_idx, row_number() over (partition by verse_id, line, word_idx order by score desc, n_words desc, start, class_idx, member_idx)::int "rank", class_idx, score, words, partner from cw)"""
SLOTS = 'sl as (select verse_id, class_idx, members, case when p < 8 then p::int end slot from (select verse_id, class_idx, count(*)::bigint members, row_number() over (partition by verse_id order by count(*) desc, class_idx) - 1 p from grp group by 1, 2))'
LEGEND = """
    lu as (select verse_id, class_idx, words, min(member_idx) f from grp group by 1, 2, 3),
    lg as (select verse_id, class_idx, list(words order by f) u from lu group by 1, 2),
    le as (select verse_id, class_idx, array_to_string(case when len(u) <= 6 then u else list_append(u[1:6], '… +' || (len(u) - 6)) end, ' · ') preview from lg)"""
RULES = """
    cp2 as (select verse_id, compound_idx, count(*) beats, min_by({'al': a_line, 'as': a_start, 'bl': b_line, 'bs': b_start}, beat_idx) f, max_by({'ae': a_start + a_n_words, 'be': b_start + b_n_words}, beat_idx) l from chn group by 1, 2 having count(*) > 1),
    cr as (select verse_id, list_concat(list_transform(range(f.as, l.ae), lambda w: {'line': f.al, 'w': w}), list_transform(range(f.bs, l.be), lambda w: {'line': f.bl, 'w': w})) places, row_number() over (partition by verse_id order by beats desc, f.al, f.as, compound_idx) r from cp2),
    cl as (select verse_id, r, places claimed, list_transform(places, lambda p: r) rules from cr where r = 1 union all
        select cl.verse_id, cr.r, case when list_has_any(claimed, places) then claimed else list_concat(claimed, places) end, case when list_has_any(claimed, places) then rules else list_concat(rules, list_transform(places, lambda p: cr.r)) end
        from cl join cr on cr.verse_id = cl.verse_id and cr.r = cl.r + 1),
    cf as (select * from cl qualify row_number() over (partition by verse_id order by r desc) = 1),
    ru as (select distinct verse_id, p.line line, p.w::int word_idx, (q - 1)::int rule from (select verse_id, unnest(claimed) p, unnest(rules) q from cf))"""
