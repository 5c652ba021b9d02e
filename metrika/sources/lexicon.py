"""Pronunciation lexicons as tables (word, variant_idx, phones)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pronunciations of common words in the notation of dictionary files, WORD(n)  PHONES.
SEED = """
lincoln  L IH1 NG K AH0 N
reason  R IY1 Z AH0 N
listen  L IH1 S AH0 N
orange  AO1 R AH0 N JH
orange(2)  AO1 R IH0 N JH
season  S IY1 Z AH0 N
sweaty  S W EH1 T IY0
heavy  HH EH1 V IY0
betty  B EH1 T IY0
sweater  S W EH1 T ER0
already  AO0 L R EH1 D IY0
already(2)  AO0 R EH1 D IY0
spaghetti  S P AH0 G EH1 T IY0
ready  R EH1 D IY0
forgetting  F ER0 G EH1 T IH0 NG
forgetting(2)  F AO0 R G EH1 T IH0 NG
confetti  K AH0 N F EH1 T IY0
palms  P AA1 M Z
palms(2)  P AA1 L M Z
arms  AA1 R M Z
calm  K AA1 M
calm(2)  K AA1 L M
bombs  B AA1 M Z
drop  D R AA1 P
drop(2)  D R AO1 P
vomit  V AA1 M AH0 T
nervous  N ER1 V AH0 S
surface  S ER1 F AH0 S
wrote  R OW1 T
whole  HH OW1 L
goes  G OW1 Z
down  D AW1 N
crowd  K R AW1 D
loud  L AW1 D
mouth  M AW1 TH
out  AW1 T
come  K AH1 M
run  R AH1 N
knees  N IY1 Z
how  HH AW1
now  N AW1
day  D EY1
wake  W EY1 K
take  T EY1 K
cake  K EY1 K
shake  SH EY1 K
state  S T EY1 T
up  AH1 P
great  G R EY1 T
debate  D AH0 B EY1 T
ate  EY1 T
one  W AH1 N
who  HH UW1
feeling  F IY1 L IH0 NG
every  EH1 V ER0 IY0
every(2)  EH1 V R IY0
sky  S K AY1
fire  F AY1 ER0
fire(2)  F AY1 R
higher  HH AY1 ER0
choir  K W AY1 ER0
national  N AE1 SH AH0 N AH0 L
national(2)  N AE1 SH N AH0 L
rational  R AE1 SH AH0 N AH0 L
rational(2)  R AE1 SH N AH0 L
cat  K AE1 T
hat  HH AE1 T
time  T AY1 M
rhyme  R AY1 M
lessen  L EH1 S AH0 N
strengthen  S T R EH1 NG TH AH0 N
get  G EH1 T
get(2)  G IH1 T
setup  S EH1 T AH2 P
plane  P L EY1 N
sane  S EY1 N
man  M AE1 N
see  S IY1
me  M IY1
you  Y UW1
to  T UW1
to(2)  T IH0
to(3)  T AH0
hypnotize  HH IH1 P N AH0 T AY2 Z
eyes  AY1 Z
six  S IH1 K S
around  ER0 AW1 N D
around(2)  ER0 AW1 N
empty  EH1 M P T IY0
empty(2)  EH1 M T IY0
read  R EH1 D
read(2)  R IY1 D
seed  S IY1 D
give  G IH1 V
bird  B ER1 D
word  W ER1 D
verse  V ER1 S
first  F ER1 S T
curse  K ER1 S
earth  ER1 TH
worth  W ER1 TH
choking  CH OW1 K IH0 NG
joking  JH OW1 K IH0 NG
flowing  F L OW1 IH0 NG
going  G OW1 IH0 NG
going(2)  G OW1 IH0 N
groovy  G R UW1 V IY0
"""

# Spoken contractions that no dictionary or spelling rule gives.
SLANG = """
imma  AY1 M AH0
finna  F IH1 N AH0
gonna  G AH1 N AH0
gon  G AA1 N
gon'  G AA1 N
shoulda  SH UH1 D AH0
woulda  W UH1 D AH0
coulda  K UH1 D AH0
tryna  T R AY1 N AH0
yall  Y AO1 L
gimme  G IH1 M IY0
lemme  L EH1 M IY0
"""


def parse(text: str) -> list[tuple[str, int, list[str]]]:
    out, seen = [], {}
    for line in text.strip().splitlines():
        word, phones = line.split("  ")
        word = word.split("(")[0].lower()
        out.append((word, seen.get(word, 0), phones.split()))
        seen[word] = seen.get(word, 0) + 1
    return out


SEED_ROWS, SLANG_ROWS = parse(SEED), parse(SLANG)
SCHEMA = "word string, variant_idx int, phones array<string>"


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_ROWS, SCHEMA)


def slang_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SLANG_ROWS, SCHEMA)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file: lines of WORD(n)  P H O N E S; comments begin with ;;; and may follow a #."""
    line = F.trim(F.regexp_replace("value", r"\s+#.*$", ""))
    rows = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith(";;;"))
    head = F.lower(F.regexp_extract("line", r"^(\S+)", 1))
    number = F.regexp_extract(head, r"\((\d+)\)$", 1)
    phones = F.split(F.regexp_extract("line", r"^\S+\s+(.*)$", 1), r"\s+")
    # the unnumbered line is variant 1, numbered ones begin with 2 (or with 1 in some files)
    place = F.when(number == "", F.lit(0)).otherwise(number.cast("int"))
    rows = rows.select(F.regexp_replace(head, r"\(\d+\)$", "").alias("word"), place.alias("place"), phones.alias("phones"))
    grouped = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "phones"))).alias("all"))
    return grouped.select("word", F.posexplode("all").alias("variant_idx", "v")).select("word", "variant_idx", F.col("v.phones").alias("phones"))


def lexicon_json(lexicon: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word, json) of the wanted words: variants of syllables {o, n, s, c}; the words that are missing)."""
    from metrika.functions.phonology import syllabify

    wanted = words.select(F.lower("word").alias("word")).distinct()
    one = F.transform(syllabify(F.col("phones")), lambda s: F.struct(s["onset"].alias("o"), s["nucleus"].alias("n"), s["stress"].alias("s"), s["coda"].alias("c")))
    have = lexicon.join(wanted, "word").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("variant_idx", one.alias("v")))).alias("all"))
    return have.select("word", F.to_json(F.transform("all", lambda x: x["v"])).alias("json")), wanted.join(lexicon.select("word"), "word", "left_anti")
