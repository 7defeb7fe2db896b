"""Skill hits by a taxonomy that is a table, of any number of aliases.

One pattern of all aliases has to be compiled and tried at every place of a text; that suits some hundreds. Here the
aliases are an inverted index: each is filed under one of its words, the one that the fewest texts hold, and the words
of the texts are joined with that index. What is left for a text are the few aliases whose rarest word it holds; they
are confirmed at their places, by a pattern of the text's own aliases. The result is that of ``extraction.with_hits``.

Texts meet the index by a hash of the text and distinct words only; equal texts count once there. A hash that two texts
share gives both more candidates, and no more hits. Null texts are empty texts, an empty taxonomy hits nothing, repeated
rows of the taxonomy count once. An alias without any letter or digit is in no text's words and is never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolefit.functions import extraction as E
from rolefit.functions import text as X
from rolefit.session import merge_join, written

HITS = "array<struct<skill: string, label: int>>"
TEXT, KEY, ALIASES = "__taxonomy_text", "__taxonomy_key", "__taxonomy_aliases"


def _folded(c: Column) -> Column:
    """``translate`` by FOLDED; texts without these letters, nearly all, pass at the cost of a search."""
    for letter, plain in zip(*E.FOLDED):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({X.WORD}+)"), F.lit(1)))


def _pattern(alias: Column) -> Column:
    """Pattern of a folded alias, as ``text.fold_pattern`` makes it."""
    literal = F.regexp_replace(alias, r"([^\p{L}\p{N}_ ])", r"\\$1")
    return F.replace(F.replace(literal, F.lit("i"), F.lit("[iı]")), F.lit("s"), F.lit("[sſ]"))


def aliases(taxonomy: DataFrame) -> DataFrame:
    """(alias, skills, words) of a table of (skill, alias)."""
    alias = _folded(F.lower("alias"))
    return (taxonomy.filter(F.col("skill").isNotNull()).select("skill", alias.alias("alias")).filter("alias != ''")
            .groupBy("alias").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
            .withColumn("words", _words(F.col("alias"))))


def candidates(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(key, array<struct<alias, pattern, skills>>) of the aliases whose rarest word a text holds."""
    known = written(aliases(taxonomy), "aliases")
    used = known.select(F.explode("words").alias("word")).distinct()
    words = texts.select(KEY, F.explode(_words(_folded(F.col(TEXT)))).alias("word"))
    words = written(words.join(used, "word", "left_semi").distinct(), "words")
    frequency = words.groupBy("word").agg(F.count("*").alias("n"))
    filed = (known.select("alias", "skills", F.explode("words").alias("word")).join(frequency, "word")
             .groupBy("alias").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.first("skills").alias("skills")))
    entry = F.struct("alias", _pattern(F.col("alias")).alias("pattern"), "skills")
    return merge_join(words, filed, "word").groupBy(KEY).agg(F.collect_list(entry).alias(ALIASES))


def _starts_of(following: Column) -> Column:
    """The aliases that stand alone at the beginning of ``following``."""
    def stands(folded: Column, alias: Column) -> Column:
        return F.startswith(folded, alias) & ~following.substr(F.length(alias) + 1, F.lit(1)).rlike(X.WORD)

    found = X.bound(_folded(following), lambda folded: F.filter(F.col(ALIASES), lambda c: stands(folded, c["alias"])))
    return F.flatten(F.transform(found, lambda c: F.transform(
        c["skills"], lambda skill: F.struct(skill.alias("skill"), F.length(c["alias"]).alias("length")))))


def with_hits(df: DataFrame, name: str, text: Column, taxonomy: DataFrame, collapsed: bool = False) -> DataFrame:
    """Add ``name``, the hits of a whole lower-cased text, as ``extraction.with_hits`` does."""
    plain = F.concat(F.lit(" "), F.trim(text) if collapsed else X.clean_text(text))
    # Written, since the words and the join below both read them: the texts are made once.
    rows = written(df, "texts").withColumn(TEXT, F.coalesce(plain, F.lit(" "))).withColumn(KEY, F.xxhash64(TEXT))
    found = candidates(rows, taxonomy)
    rows = merge_join(rows, found, KEY, "left").withColumn(
        ALIASES, X.bound(_folded(F.col(TEXT)), lambda folded: F.filter(F.col(ALIASES), lambda c: F.contains(folded, c["alias"]))))
    any_alias = F.array_join(F.transform(ALIASES, lambda c: c["pattern"]), "|")
    hit = F.concat(F.lit(f"(?<![a-z0-9])(?<!{X.WORD})(?=(?:"), any_alias, F.lit(f")(?!{X.WORD}))"))
    cut = F.when(F.size(ALIASES) > 0, F.regexp_replace(TEXT, hit, F.lit(E.MARK)))
    longest = F.array_max(F.transform(ALIASES, lambda c: F.length(c["alias"])))
    hits = E.labelled_hits(F.col(name), _starts_of, longest)
    rows = rows.withColumn(name, cut).withColumn(name, F.coalesce(hits, F.array().cast(HITS)))
    return rows.select(*dict.fromkeys([*df.columns, name]))
