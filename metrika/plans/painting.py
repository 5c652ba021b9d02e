"""Named queries of the presentation: paint plans, rules below cells and tooltips of the benchmark's items.

They join the catalogue's queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrika.operators import components, plan
from metrika.plans import catalogue as C
from metrika.plans import scanner_sql as S
from metrika.plans.catalogue import query
from metrika.sources import rendered

#: pc: a row a cell with all that is painted on it; its rule goes on between two words that both have it.
_PAINTED = f"""{C._COVERED}, {S.CHAINS}, {S.RULES},
    cc as (select verse_id, line::int line, unnest(c) as text, unnest(range(len(c)))::int cell_idx from (select verse_id, line, regexp_extract_all(raw, '[a-zA-Z'']+|[^a-zA-Z'']+') c from li)),
    ci as (select *, regexp_matches(text, '^[a-zA-Z'']') is_word from cc),
    cx as (select *, case when is_word then (sum(is_word::int) over (partition by verse_id, line order by cell_idx) - 1)::int end word_idx from ci),
    wf as (select verse_id, line, word_idx, min_by(class_idx, "rank") fill, list(distinct class_idx) a from cov group by 1, 2, 3),
    pv as (select distinct verse_id, lower(tk.word) w, coalesce(source, 'oov') source from tk left join (select distinct word, source from pron) p on p.word = lower(tk.word) where coalesce(source, 'oov') <> 'dictionary'),
    rx as (select verse_id, line, word_idx, count(*)::int receipts, string_agg('''' || words || ''' ~ ''' || partner || ''' — class ' || class_idx || ', ' || format('{{:.2f}}', score), chr(10) order by "rank") told from cov group by 1, 2, 3),
    pc as (select cx.*, fill, array_to_string(list_sort(list_filter(a, lambda k: k <> fill)), ',') ticks, rule, coalesce(source = 'oov', false) oov, case when source <> 'oov' then source end guessed, coalesce(receipts, 0)::int receipts, told
        from cx left join wf using (verse_id, line, word_idx) left join ru using (verse_id, line, word_idx) left join rx using (verse_id, line, word_idx) left join pv on pv.verse_id = cx.verse_id and is_word and pv.w = lower(cx.text))"""


@query(f"{_PAINTED} select * exclude (told) from pc")
def plan_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paint plan: every cell of every line with its fill, ticks, rule and doubts, and how many receipts it has."""
    out = plan.plan_verse(C._scan(spark, sf_dir))
    ticks = F.array_join(F.transform("ticks", lambda t: t.cast("string")), ",")
    return out.withColumn("ticks", ticks).withColumn("receipts", F.coalesce(F.size("receipts"), F.lit(0)))


@query(f"""{_PAINTED}, wd as (select verse_id, line, word_idx, rule, lead(rule) over (partition by verse_id, line order by word_idx) following from pc where is_word),
    gp as (select verse_id, line, cell_idx, sum(is_word::int) over (partition by verse_id, line order by cell_idx) - 1 before from pc)
    select verse_id, line, cell_idx, pc.text, case when is_word then pc.rule when wd.rule = following then wd.rule end under from pc join gp using (verse_id, line, cell_idx) left join wd on wd.verse_id = pc.verse_id and wd.line = pc.line and wd.word_idx = before""".replace("select verse_id, line, cell_idx, pc.text", "select pc.verse_id, pc.line, pc.cell_idx, pc.text"))
def cell_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule below every cell; it goes on through what stands between two words of one compound."""
    return plan.cell_rule(plan.plan_verse(C._scan(spark, sf_dir))).select("verse_id", "line", "cell_idx", "text", "under")


@query(f"""{_PAINTED}, tp as (select verse_id, line, word_idx, case when oov then 'unknown word — no pronunciation found' else concat_ws(chr(10), told, 'pronunciation guessed (' || guessed || ')') end tooltip from pc where is_word)
    select * from tp where tooltip <> ''""")
def tooltip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a word's tooltip says: its matches, best first, and doubts about its sound."""
    return plan.tooltip_texts(plan.plan_verse(C._scan(spark, sf_dir)))


@query(C.ORACLE_SQL["write_annotations"].replace("select item_id verse_id,", "select item_id::varchar verse_id,"))
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's annotation, written as a file of its own in the shared folder and read again."""
    rendered.register(spark)
    path = f"{components.shared_folder(spark)}/annotations-{uuid.uuid4().hex}"
    texts = C.write_annotations(spark, sf_dir).select(F.col("verse_id").cast("string").alias("verse_id"), F.col("annotation").alias("text"))
    texts.write.format("verse_files").mode("append").save(path)
    return spark.read.format("verse_files").load(path).withColumnRenamed("text", "annotation")
