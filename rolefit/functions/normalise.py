"""Title, location and skill-term normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rolefit.functions import text as X
from rolefit.functions import vocab


def _first_rule(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in cases], default)


def title_seniority(title: Column) -> Column:
    basic = X.normalize_text_basic(title)
    return _first_rule(
        [(basic.rlike(X.phrase_pattern(phrases)), F.lit(level))
         for level, phrases in vocab.TITLE_SENIORITY.items()],
        F.lit(""),
    )


def title_slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(X.clean_text(title)), "[^a-z0-9]+", "_"), F.lit("_"))


def title_rule(title: Column) -> Column:
    """Canonical title and family of the first matching rule, as a struct."""
    basic = X.normalize_text_basic(title)
    return _first_rule(
        [(basic.rlike(X.phrase_pattern(phrases)),
          F.struct(F.lit(name).alias("title"), F.lit(family).alias("family")))
         for name, family, phrases in vocab.TITLE_RULES],
        F.struct(title_slug(title).alias("title"), F.lit("").alias("family")),
    )


def job_function(family: Column) -> Column:
    return F.coalesce(X.lookup(vocab.JOB_FUNCTION_BY_FAMILY, family), F.lit(""))


def title_record(title: Column) -> Column:
    rule = title_rule(title)
    return F.struct(
        rule["title"].alias("title_normalized"),
        rule["family"].alias("job_family"),
        job_function(rule["family"]).alias("job_function"),
        title_seniority(title).alias("seniority_level"),
    )


def country(location: Column) -> Column:
    lowered = F.lower(location)
    return _first_rule(
        [(F.contains(lowered, F.lit(word)), F.lit(name)) for word, name in vocab.COUNTRY_KEYWORDS],
        F.lit(""),
    )


def region(country_name: Column) -> Column:
    return F.coalesce(X.lookup(vocab.REGION_BY_COUNTRY, country_name), F.lit(""))


def workplace(location: Column, description: Column) -> Column:
    """Remote, hybrid and onsite flags with the resulting workplace type."""
    place = X.clean_text(location)
    # Neither word holds a blank, so the texts need no collapsing and can be
    # looked at one by one.
    where, about = F.lower(place), F.lower(F.coalesce(description, F.lit("")))

    def named(word):
        return F.contains(where, F.lit(word)) | F.contains(about, F.lit(word))

    remote, hybrid = named("remote"), named("hybrid")
    kind = F.when(remote, "remote").when(hybrid, "hybrid").when(place != "", "onsite").otherwise("")
    return F.struct(
        remote.alias("is_remote"),
        hybrid.alias("is_hybrid"),
        (~remote & ~hybrid).alias("is_onsite"),
        kind.alias("workplace_type"),
    )


def skill_alias_keys(taxonomy: dict[str, list[str]]) -> dict[str, str]:
    """Term to canonical skill; later entries win, as in a plain map fill."""
    out = {}
    for skill, aliases in taxonomy.items():
        for term in [skill, *aliases]:
            # The taxonomy is lower-case ASCII; only punctuation has to go.
            key = "".join(ch if ch.isalnum() or ch in "_+#. " else " " for ch in term.lower())
            out[" ".join(key.split())] = skill
    return out


def normalize_skill_terms(terms: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Canonical skill per term, unknown terms as snake case, first-seen order."""
    known = skill_alias_keys(taxonomy or vocab.SKILL_ALIASES)

    def canonical(term: Column) -> Column:
        key = X.normalize_text_basic(term)
        return F.coalesce(X.lookup(known, key), F.replace(key, F.lit(" "), F.lit("_")))

    return F.array_distinct(F.transform(F.coalesce(terms, X.empty_strings()), canonical))
