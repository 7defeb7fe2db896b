import random
import re

import pytest
from pyspark.sql import functions as F

from rolefit.functions import extraction as E
from rolefit.functions import vocab
from rolefit.operators import enrich as En


@pytest.mark.parametrize("text,expected", [
    ("5+ years of experience", 5), ("3-5 years", 5), ("10 to 3 years", 10), ("minimum of 3 projects", 3),
    ("at least 18 years old, 2 yrs", 18), ("founded 25 years ago; 2+ years sql", 25), ("1 year", None), ("", None),
    ("12-4 YEARS", 12), ("99999999999999999999 years, 2 yrs", 10**18),
])
def test_years(value, text, expected):
    assert value(lambda c: E.years_of_experience(E.lowered(c)), text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Bachelor's or Master's degree", "master"), ("bachelor's degree or phd", "bachelor"), ("PHDs", None),
    ("a phd.", "phd"), ("High School Diploma", "high_school"), ("M.Sc", "master"), ("", None), ("mbas", None),
])
def test_education(value, text, expected):
    assert value(lambda c: E.education_required(E.lowered(c)), text) == expected


@pytest.mark.parametrize("title,text,years,expected", [
    ("Internal Auditor", "", None, "intern"), ("Principal Engineer", "", 1, "manager"),
    ("Engineer", "", 8, "senior"), ("Engineer", "", 4, "mid"), ("Engineer", "", 0, "entry"),
    ("Engineer", "", None, None), ("Engineer", "an Internship", 9, "intern"), ("Entry-Level Dev", "", 9, "entry"),
])
def test_seniority(value, title, text, years, expected):
    got = value(lambda t, d, y: E.posting_seniority(t, E.lowered(d), y), title, text, F.lit(years).cast("bigint"))
    assert got == expected


def derived_hits(text, taxonomy):
    """Independent derivation: per alias, every standalone occurrence with its context label."""
    text = re.sub(r"\s+", " ", text.lower()).strip()
    found = []
    for skill, aliases in taxonomy.items():
        for alias in aliases:
            start = text.find(alias)
            while start >= 0:
                end = start + len(alias)
                before, after = text[start - 1:start], text[end:end + 1]
                if not re.match(r"\w", before) and not re.match(r"\w", after):
                    context = text[max(0, start - 120):end + 120]
                    if any(h in context for h in vocab.NEGATION_HINTS):
                        label = 0
                    elif any(h in context for h in vocab.REQUIRED_HINTS):
                        label = 2
                    else:
                        label = int(any(h in context for h in vocab.PREFERRED_HINTS))
                    found.append((skill, label))
                start = text.find(alias, start + 1)
    return found


def section(text, headings):
    text = text.lower()
    m = re.search("|".join(headings), text)
    return text[m.end():] if m else ""


def derived_skills(text, taxonomy):
    def best(part):
        out = {}
        for skill, label in derived_hits(part, taxonomy):
            out[skill] = max(out.get(skill, 0), label)
        return out

    required = {s for s, lb in best(section(text, vocab.REQUIREMENT_HEADINGS)).items() if lb == 2}
    preferred = {s for s, lb in best(section(text, vocab.PREFERRED_HEADINGS)).items() if lb == 1} - required
    other = {s for s, lb in best(text).items() if lb == 0} - required - preferred
    return sorted(required), sorted(preferred), sorted(other)


def random_texts(n, seed):
    rng = random.Random(seed)
    words = [a for aliases in vocab.SKILL_ALIASES.values() for a in aliases]
    words += vocab.REQUIRED_HINTS + vocab.PREFERRED_HINTS + vocab.NEGATION_HINTS
    words += vocab.REQUIREMENT_HEADINGS + vocab.PREFERRED_HEADINGS
    words += ["digital", "gitlab", "éxcel", "sql2", "mysqls", "rest", "the", "of", "lorem ipsum dolor sit amet " * 4,
              "naïve", "日本", "😀", "Data  Analysis", "SQL", "_api_", "x" * 130]
    seps = [" ", " ", " ", ". ", "; ", ", ", "-", "\n", "", "/"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_skills_equal_an_independent_derivation(spark):
    texts = random_texts(400, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", E.lowered(F.col("t")))
    rows = E.with_skills(df, "t").orderBy("i").collect()
    for row, text in zip(rows, texts):
        got = row["required_skills"], row["preferred_skills"], row["other_skills_found"]
        assert got == derived_skills(text, vocab.SKILL_ALIASES), text


def test_collapsed_texts_are_cut_once(spark):
    texts = [re.sub(r"\s+", " ", t).strip() for t in random_texts(400, 9)]
    texts += ["requirementssql required", "qualificationsrest api, plus", "requirements\u00e9sql", "preferredsales cycle bonus",
              "requirements sql", "requirements", "nice-to-have git plus " + "z" * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", E.lowered(F.col("t")))
    rows = E.with_skills(df, "t", collapsed=True).orderBy("i").collect()
    for row, text in zip(rows, texts):
        got = row["required_skills"], row["preferred_skills"], row["other_skills_found"]
        assert got == derived_skills(text, vocab.SKILL_ALIASES), text


def test_alias_that_is_part_of_a_heading(spark):
    taxonomy = {"q": ["qualifications", "have"], "r": ["requirements"], "t": ["to"]}
    texts = ["minimum qualifications have sql", "a nice to have, plus to", "minimum requirements requirements", "preferred qualifications to"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = E.with_skills(df, "t", taxonomy, collapsed=True).orderBy("i").collect()
    for row, text in zip(rows, texts):
        got = row["required_skills"], row["preferred_skills"], row["other_skills_found"]
        assert got == derived_skills(text, taxonomy), text


def test_hits_equal_an_independent_derivation(spark):
    texts = random_texts(200, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hits = E.with_hits(df, "h", E.lowered(F.col("t"))).orderBy("i").collect()
    for row, text in zip(hits, texts):
        assert sorted((h["skill"], h["label"]) for h in row["h"]) == sorted(derived_hits(text, vocab.SKILL_ALIASES))


def test_other_taxonomy_with_overlapping_aliases(spark):
    taxonomy = {"a": ["data science", "science"], "b": ["science fiction", "c++"], "c": ["data"], "d": ["fiction", ".net"]}
    texts = ["data science fiction required c++ .net", "science-fiction, data", "c++ c+++ x.net .net5 plus .net"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hits = E.with_hits(df, "h", F.col("t"), taxonomy).orderBy("i").collect()
    for row, text in zip(hits, texts):
        assert sorted((h["skill"], h["label"]) for h in row["h"]) == sorted(derived_hits(text, taxonomy)), text


def test_negated_skill_stays_found(spark):
    df = spark.createDataFrame([("docker is optional",)], "t string")
    assert E.with_skills(df, "t").first()["other_skills_found"] == ["docker"]


def test_enrich_tolerates_missing_columns(spark):
    df = spark.createDataFrame([("j", "Data Analyst", None)], "job_uid string, title string, description string")
    row = En.enrich(df).first()
    assert row["required_skills"] == [] and row["seniority_inferred"] is None
    full = spark.createDataFrame(
        [("j", "Lead", "Requirements: <b>SQL</b> required, 4 yrs; MBA")], "job_uid string, title string, requirements string")
    row = En.enrich(full).first()
    assert (row["required_skills"], row["years_experience_extracted"], row["education_extracted"],
            row["seniority_inferred"]) == (["sql"], 4, "master", "senior")


@pytest.mark.parametrize("text, expected", [
    ("1-2-3 years, 4+ to 9 years", 9), ("7 to 5 years", 7), ("12 - 5years", 12), ("8-9 yrs 3 yrs", 9), ("6+5 years", 5), ("11 to yrs", None),
])
def test_years_are_found_in_one_pass(spark, text, expected):
    out = spark.createDataFrame([(text,)], "t string").select(E.years_of_experience(F.col("t")).alias("y"))
    assert out.first()["y"] == expected
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3


def test_cheap_education_words_are_in_every_phrase_but_not_in_prose():
    from itertools import product

    folded = {"i": "iı", "s": "sſ"}
    for level, phrases in vocab.EDUCATION_PHRASES.items():
        words = E._EDUCATION_LETTERS[level]
        for phrase in phrases:
            for letters in product(*[folded.get(ch, ch) for ch in phrase]):
                assert any(w in "".join(letters) for w in words)
        assert not any(w in "a lorem ipsum. any degree will do, club." for w in words)
