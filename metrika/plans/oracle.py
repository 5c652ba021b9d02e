"""SQL of the queries for an independent engine, put together from the fixed tables."""

from __future__ import annotations

from metrika.functions import tables as T
from metrika.operators import audit, g2p, kernel, scan
from metrika.sources import lexicon


def quoted(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def values(rows) -> str:
    def one(v):
        if isinstance(v, str):
            return quoted([v])
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, list):
            return f"[{quoted(v)}]"
        return str(v)

    return "values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def vowel(p: str) -> str:
    return f"regexp_replace({p}, '[0-9]$', '') in ({quoted(T.VOWELS)})"


def words_of(source: str) -> str:
    """words: distinct lower-cased words of the table's texts."""
    return f"words as (select distinct lower(w) word from (select unnest(regexp_extract_all(text, '[a-zA-Z'']+')) w from {source}))"


LEXICON = f"lex(word, variant_idx, phones) as ({values(lexicon.SEED_ROWS)}), slang(word, variant_idx, phones) as ({values(lexicon.SLANG_ROWS)})"


def _cleaned(s: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, '{c}{{3,}}', '{c}', 'g')"
    for c in "bcdfghjklmnpqrstvwxyz":
        s = f"regexp_replace({s}, '{c}{c}', '{c}', 'g')"
    return s


def _letters() -> str:
    sounds = "map {" + ", ".join(f"'{k}': [{quoted(v)}]" for k, v in g2p.SOUNDS.items()) + "}"
    return f"""
    sp0 as (select word, {_cleaned("replace(word, '''', '')")} s from words where regexp_full_match(replace(word, '''', ''), '[a-z]+')),
    sp1 as (select word, case when length(s) > 2 and (s like '%ie' or (s like '%e' and substr(s, length(s) - 1, 1) not in ('a','e','i','o','u','y'))) then substr(s, 1, length(s) - 1) else s end s from sp0),
    sp2 as (select word, regexp_extract_all(s, '{g2p.PATTERN}|.') t from sp1),
    sp3 as (select word, flatten(list_transform(t, lambda x, i: case
        when x = 'c' then case when substr(coalesce(t[i + 1], ''), 1, 1) in ('e', 'i', 'y') then ['S'] else ['K'] end
        when x = 'y' then case when i = 1 then ['Y'] when i = len(t) then ['IY'] else ['IH'] end
        when x = 'i' and i = len(t) then ['IY']
        else coalesce(({sounds})[x], []) end)) p from sp2),
    sp4 as (select word, p, list_position(list_transform(p, lambda x: x in ({quoted(T.VOWELS)})), true) f from sp3),
    lts as (select word, 'letter-to-sound' source, 0.1::DOUBLE as cost, 0 variant_idx, list_transform(p, lambda x, i: case when x in ({quoted(T.VOWELS)}) then x || case when i = f then '1' else '0' end else x end) phones from sp4 where f > 0)"""


#: pron: word, source, cost, variant_idx, phones (no rows: can't be voiced). Needs words, lex, slang.
CHAIN = f"""{_letters()},
    dict as (select w.word, 'dictionary' source, 0::DOUBLE as cost, variant_idx, phones from words w join lex l on l.word = w.word),
    slg as (select w.word, 'lexicon' source, 0::DOUBLE as cost, variant_idx, phones from words w join slang l on l.word = w.word),
    dr as (select word, regexp_replace(word, '''+$', '') bare from words where regexp_full_match(word, '[a-z]+in''?')),
    ing as (select dr.word, 'g-drop' source, 0::DOUBLE as cost, variant_idx, case when phones[len(phones)] = 'NG' then list_append(phones[:len(phones) - 1], 'N') else phones end phones from dr join lex l on l.word = bare || 'g'),
    st as (select word, substr(bare, 1, length(bare) - 2) s from dr where word not in (select word from ing)),
    cand as (select word, 0 k, s key from st union all select word, 1, s || 'e' from st union all select word, 2, substr(s, 1, length(s) - 1) from st where length(s) >= 2 and substr(s, length(s), 1) = substr(s, length(s) - 1, 1)),
    hit as (select c.word, c.k, l.variant_idx, list_concat(l.phones, ['IH0', 'N']) phones, min(c.k) over (partition by c.word) m from cand c join lex l on l.word = c.key),
    stem as (select word, 'stem+-in''' source, 0::DOUBLE as cost, variant_idx, phones from hit where k = m),
    ers as (select w.word, '-a-for-er' source, 0::DOUBLE as cost, row_number() over (partition by w.word order by variant_idx) - 1 variant_idx, list_append(phones[:len(phones) - 1], 'AH' || substr(phones[len(phones)], 3)) phones from words w join lex l on l.word = substr(w.word, 1, length(w.word) - 1) || 'er' where length(w.word) >= 3 and w.word like '%a' and phones[len(phones)] like 'ER%'),
    every as (select 0 o, * from dict union all select 1, * from slg union all select 2, * from ing union all select 3, * from stem union all select 4, * from ers union all select 5, * from lts),
    pron as (select word, source, cost, variant_idx, phones from (select *, min(o) over (partition by word) m from every) where o = m)"""


def _onset_length(g: str) -> str:
    n = f"len({g})"
    return f"case when {n} >= 3 and array_to_string(({g})[{n} - 2:{n}], ' ') in ({quoted(T.ONSETS_3)}) then 3 when {n} >= 2 and array_to_string(({g})[{n} - 1:{n}], ' ') in ({quoted(T.ONSETS_2)}) then 2 when {n} >= 1 and ({g})[{n}] <> 'NG' then 1 else 0 end"


def syllables(source: str, keys: str) -> str:
    """sy3: keys, s (list of {{o, n, c, st}}) of a table with phones."""
    return f"""
    sy0 as (select {keys}, phones p, list_filter(list_transform(phones, lambda x, i: case when {vowel('x')} then i end), lambda x: x is not null) v from {source}),
    sy1 as (select *, list_transform(range(1, len(v)), lambda k: p[v[k] + 1:v[k + 1] - 1]) g from sy0),
    sy2 as (select *, list_transform(g, lambda x: {_onset_length('x')}) ol from sy1),
    sy3 as (select {keys}, list_transform(v, lambda x, k: {{'o': case when k = 1 then p[1:x - 1] else p[x - ol[k - 1]:x - 1] end, 'n': regexp_replace(p[x], '[0-9]$', ''), 'c': case when k = len(v) then p[x + 1:len(p)] else p[x + 1:v[k + 1] - 1 - ol[k]] end, 'st': coalesce(try_cast(regexp_extract(p[x], '[0-9]$') as int), 0)}}) s from sy2)"""


SYLLABLE_TEXT = "list_transform(s, lambda x: array_to_string(list_concat(list_concat(x.o, [x.n || x.st::varchar]), x.c), ' '))"
#: tl: 1-based start of the tail in s.
TAIL = "greatest(coalesce(list_max(list_transform(s, lambda x, i: case when x.st = 1 then i end)), list_max(list_transform(s, lambda x, i: case when x.st = 2 then i end)), len(s)), 1)"


def distances(name: str, symbols, flat) -> str:
    n = len(symbols)
    return f"{name}(a, b, d) as ({values([(a, b, flat[i * n + j]) for i, a in enumerate(symbols) for j, b in enumerate(symbols)])})"


VOWEL_D = distances("vd", T.VOWELS, T.VOWEL_DISTANCES)
CONSONANT_D = distances("cd", T.CONSONANTS, T.CONSONANT_DISTANCES)

#: All alignments of tails of up to 3 syllables, scored: best(va, vb, score, cols, gaps, path). Needs tails(id, t), pairs(va, vb).
ALIGN = f"""{VOWEL_D}, {CONSONANT_D},
    grow as (select 0 i, 0 j, '' path union all
        select i + case when m in ('d', 'a') then 1 else 0 end, j + case when m in ('d', 'b') then 1 else 0 end, path || m from grow, (values ('d'), ('a'), ('b')) x(m)
        where i + case when m in ('d', 'a') then 1 else 0 end <= 3 and j + case when m in ('d', 'b') then 1 else 0 end <= 3),
    step as (select path, i m, j n, k, substr(path, k, 1) mv, length(regexp_replace(substr(path, 1, k), 'b', '', 'g')) x, length(regexp_replace(substr(path, 1, k), 'a', '', 'g')) y from grow, range(1, 7) r(k) where k <= length(path)),
    sy as (select id, unnest(t) s, unnest(range(1, len(t) + 1)) pos from tails),
    cp as (select a.n an, b.n bn, a.c ac, b.c bc from (select distinct s.n, s.c from sy) a, (select distinct s.n, s.c from sy) b),
    cs as (select an, bn, ac, bc, case when greatest(len(ac), len(bc)) = 0 then 1.0::DOUBLE else coalesce((select sum(1.0::DOUBLE - cd.d) from range(1, least(len(ac), len(bc)) + 1) r(i) join cd on cd.a = ac[i] and cd.b = bc[i]), 0) / greatest(len(ac), len(bc)) end co from cp),
    sim as (select an, bn, ac, bc, d, ((1.0::DOUBLE - d) + 0.35::DOUBLE * co) / 1.35::DOUBLE sc from cs join vd on vd.a = an and vd.b = bn),
    cell as (select p.va, p.vb, x.pos i, y.pos j, sim.d, sim.sc from pairs p join sy x on x.id = p.va join sy y on y.id = p.vb join sim on sim.an = x.s.n and sim.bn = y.s.n and sim.ac = x.s.c and sim.bc = y.s.c),
    size as (select p.va, p.vb, len(a.t) m, len(b.t) n from pairs p join tails a on a.id = p.va join tails b on b.id = p.vb),
    walk as (select z.va, z.vb, s.path, sum(case when s.mv = 'd' then c.d else 0.6::DOUBLE end) cost, sum(case when s.mv = 'd' then c.sc else 0 end) / count(*) score, count(*) cols, count(*) filter (s.mv <> 'd') gaps
        from size z join step s on s.m = z.m and s.n = z.n left join cell c on c.va = z.va and c.vb = z.vb and c.i = s.x and c.j = s.y group by all),
    best as (select va, vb, round(score, 6) score, cols, gaps, path from (select *, row_number() over (partition by va, vb order by round(cost, 11), translate(reverse(path), 'dab', '123')) r from walk) where r = 1)"""

#: var: the seed lexicon's variants with an id and their tails.
SEED_TAILS = f"""{LEXICON},{syllables('lex', 'word, variant_idx')},
    var as (select word, variant_idx, s[{TAIL}:len(s)] t, row_number() over (order by word, variant_idx) id from sy3),
    tails as (select id, t from var)"""
