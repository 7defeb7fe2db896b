"""Requirement extraction from posting text: skills, years, education, seniority.

All of it is per-row column work, so a corpus of any size needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rolefit.functions import text as X
from rolefit.functions import vocab

UNSPECIFIED, PREFERRED, REQUIRED = 0, 1, 2
# fixed values: letters that case-insensitive matching equates with i and s
FOLDED = ("ıſ", "is")


def lowered(text: Column) -> Column:
    """Text as all functions below take it, lower-cased once for all of them."""
    return F.lower(F.coalesce(text, F.lit("")))


# --- sections ------------------------------------------------------------------

MARK = "\n"


def _after_first(text: Column, headings: list[str], mark: str = "") -> Column:
    """Text after the first heading. ``mark`` may stand before any word of a heading."""
    words = [h.replace(" ", f" {mark}").replace("-", f"-{mark}") for h in headings]
    return F.regexp_extract(text, "(?s)(?:" + "|".join(words) + ")(.*)", 1)


def section_requirements(text: Column) -> Column:
    return _after_first(text, vocab.REQUIREMENT_HEADINGS)


def section_preferred(text: Column) -> Column:
    return _after_first(text, vocab.PREFERRED_HEADINGS)


# --- skills --------------------------------------------------------------------

class SkillPatterns:
    """Patterns and tables made once, on the driver, from a taxonomy.

    Every alias occurrence that stands alone is a hit. A hit is found by its
    start, with the longest alias there; an alias that is also the beginning
    of a longer one (``sales`` in ``sales cycle``) starts at the same place
    and is taken from ``at_start``.
    """

    def __init__(self, taxonomy: dict[str, list[str]] | None = None):
        taxonomy = taxonomy or vocab.SKILL_ALIASES
        owners: dict[str, list[str]] = {}
        for skill, aliases in taxonomy.items():
            for alias in aliases:
                owners.setdefault(alias.lower(), []).append(skill)
        by_length = sorted(owners, key=lambda a: (-len(a), a))
        groups: dict[str, list[str]] = {}
        for alias in by_length:
            groups.setdefault(alias[0], []).append(alias)
        # Alternatives grouped by first letter: one failed letter skips them all.
        terms = "|".join(
            X.fold_pattern(first) + "(?:" + "|".join(X.fold_pattern(a[1:]) for a in members) + ")"
            for first, members in sorted(groups.items())
        )
        self.term = f"(?:{terms})(?!{X.WORD})"
        # The first, narrower test is the cheap one for most places inside a word.
        self.hit = f"(?<![a-z0-9])(?<!{X.WORD})(?={self.term})"
        self.longest = max(len(a) for a in owners)
        # alias -> every (skill, alias length) that starts where it starts
        self.at_start = {}
        for alias in owners:
            starts = [b for b in owners
                      if alias == b or (alias.startswith(b) and not _is_word(alias[len(b)]))]
            self.at_start[alias] = sorted((skill, len(b)) for b in starts for skill in owners[b])


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _context_label(context: Column) -> Column:
    """Rank of the hint found around a hit; a negated hit stays unspecified."""
    return (
        F.when(X.any_contains(context, vocab.NEGATION_HINTS), UNSPECIFIED)
        .when(X.any_contains(context, vocab.REQUIRED_HINTS), REQUIRED)
        .when(X.any_contains(context, vocab.PREFERRED_HINTS), PREFERRED)
        .otherwise(UNSPECIFIED)
    )


def cut_at_hits(text: Column, patterns: SkillPatterns, collapsed: bool = False) -> Column:
    """Lower-cased text with a mark at the start of every hit.

    Collapsed text holds no line feed, so that is the mark. The leading blank
    keeps an alias at the very start from having nothing before it.
    """
    plain = F.trim(text) if collapsed else X.clean_text(text)
    return F.regexp_replace(F.concat(F.lit(" "), plain), patterns.hit, MARK)


def cut_section(cut: Column, headings: list[str], patterns: SkillPatterns) -> Column:
    """Section of a text that is already cut, so that hits are searched only once.

    Only one hit can differ: an alias that follows the heading without anything
    between stands alone in the section but not in the text.
    """
    section = F.ltrim(_after_first(cut, headings, f"{MARK}?"))
    glued = (section.rlike(f"^{X.WORD}")
             & F.replace(section, F.lit(MARK), F.lit("")).rlike(f"^{patterns.term}"))
    return F.concat(F.when(glued, f" {MARK}").otherwise(" "), section)


def skill_hits(cut: Column, patterns: SkillPatterns) -> Column:
    """All hits of a cut text as array<struct<skill, label>>, in text order."""
    starts_table = F.expr("map(" + ", ".join(
        f"{X.sql_literal(alias)}, array(" + ", ".join(
            f"named_struct('skill', {X.sql_literal(skill)}, 'length', {length})" for skill, length in starts) + ")"
        for alias, starts in sorted(patterns.at_start.items())) + ")")

    def starts_of(following: Column) -> Column:
        alias = F.regexp_extract(following, "^" + patterns.term, 0)
        return F.try_element_at(starts_table, F.translate(alias, *FOLDED))

    return labelled_hits(cut, starts_of, patterns.longest)


def labelled_hits(cut: Column, starts_of: Callable[[Column], Column], longest: int | Column) -> Column:
    """Hits of a text that is cut at the start of each.

    ``starts_of`` gives array<struct<skill, length>> of the aliases that begin what
    follows a cut, none of more than ``longest`` characters. The context of a hit is
    put together from the pieces around it. A piece has at least one character, so a
    bounded number of pieces always suffices: the work per hit is bounded and grows
    with the text length, not its square.
    """
    n, ahead = vocab.CONTEXT_CHARS, vocab.CONTEXT_CHARS + longest
    some = ahead if isinstance(ahead, Column) else F.lit(ahead)

    def ends(pieces: Column) -> Column:
        return F.struct(
            F.transform(pieces, lambda p, i: F.right(
                F.when(i == 0, p.substr(F.lit(2), F.length(p))).otherwise(p), F.lit(n))).alias("tails"),
            F.transform(pieces, lambda p: F.left(p, some)).alias("heads"))

    def around(e: Column) -> Column:
        """What stands before and after the start of each hit; hit i starts piece i + 1."""
        def sides(_, i):
            first = F.greatest(i - (n - 2), F.lit(1))
            return F.struct(
                F.right(F.array_join(F.slice(e["tails"], first, i - first + 2), ""), F.lit(n)).alias("before"),
                F.left(F.array_join(F.slice(e["heads"], i + 2, ahead), ""), some).alias("following"))

        return F.transform(F.slice(e["heads"], 2, F.size(e["heads"])), sides)

    def named(hit: Column) -> Column:
        return F.struct(hit["before"].alias("before"), hit["following"].alias("following"),
                        starts_of(hit["following"]).alias("starts"))

    def contexts(hit: Column) -> Column:
        return F.transform(hit["starts"], lambda s: F.struct(
            s["skill"].alias("skill"),
            F.concat(hit["before"], hit["following"].substr(F.lit(1), s["length"] + n)).alias("context")))

    # Every step binds its result to a lambda variable: a plain column would be
    # worked out anew inside the next lambda for every hit.
    pieces = F.array(F.split(cut, MARK))
    located = F.flatten(F.transform(F.transform(pieces, ends), around))
    return F.transform(
        F.flatten(F.transform(F.transform(located, named), contexts)),
        lambda h: F.struct(h["skill"].alias("skill"), _context_label(h["context"]).alias("label")))


def skills_with_label(hits: Column, label: int) -> Column:
    """Sorted skills whose best label over all their hits is ``label``."""
    def named(at_least: int) -> Column:
        return F.array_distinct(F.transform(
            F.filter(hits, lambda h: h["label"] >= at_least), lambda h: h["skill"]))

    found = named(label)
    if label < REQUIRED:
        found = F.array_except(found, named(label + 1))
    return F.sort_array(found)


def with_hits(df, name: str, text: Column, taxonomy: dict[str, list[str]] | None = None,
              collapsed: bool = False):
    """Add a column with the hits of a whole text."""
    patterns = SkillPatterns(taxonomy)
    df = df.withColumn(name, cut_at_hits(text, patterns, collapsed))
    return df.withColumn(name, skill_hits(F.col(name), patterns))


def hit_rows(df, hits: str, *keys: str):
    """One row per hit. The outer form keeps the planner from working out the hits a
    second time just to test for empty lists."""
    rows = df.select(*keys, F.inline_outer(hits))
    return rows.filter(F.col("skill").isNotNull())


def with_skills(df, text: str, taxonomy: dict[str, list[str]] | None = None, collapsed: bool = False):
    """Add required_skills, preferred_skills and other_skills_found for a lowered text column."""
    patterns = SkillPatterns(taxonomy)
    t = F.col(text)
    headings = {"__req": vocab.REQUIREMENT_HEADINGS, "__pref": vocab.PREFERRED_HEADINGS}
    cut = df.withColumn("__all", cut_at_hits(t, patterns, collapsed))
    if collapsed:
        sections = {n: cut_section(F.col("__all"), h, patterns) for n, h in headings.items()}
    else:
        # Headings are looked for before blanks are collapsed, so each section is cut by itself.
        sections = {n: cut_at_hits(_after_first(t, h), patterns) for n, h in headings.items()}
    cut = cut.withColumns(sections)
    hits = cut.withColumns({n: skill_hits(F.col(n), patterns) for n in ["__all", *headings]})
    required = hits.withColumns({
        "required_skills": skills_with_label(F.col("__req"), REQUIRED),
        "__pref": skills_with_label(F.col("__pref"), PREFERRED),
        "__all": skills_with_label(F.col("__all"), UNSPECIFIED),
    })
    preferred = required.withColumn(
        "preferred_skills", F.array_except("__pref", "required_skills"))
    return preferred.withColumn(
        "other_skills_found",
        F.array_except(F.array_except("__all", "required_skills"), "preferred_skills"),
    ).drop("__req", "__pref", "__all")


# --- years -----------------------------------------------------------------------

def years_of_experience(text: Column) -> Column:
    """Largest number named as years, a minimum or a range end; NULL if none."""
    t = text
    ws, num = X.WS, f"({X.DIGIT}+)"
    years, yrs = X.fold_pattern("years"), X.fold_pattern("yrs")
    # What follows a number that counts, looked at from the number, so that one pass finds all of them: "3 years",
    # "3+ yrs", "3 - 5 years", "3 to 5 years". Ends of ranges are numbers before "years" themselves.
    span = f"(?:-|to){ws}*{X.DIGIT}+{ws}*"
    named = f"({X.DIGIT}++)(?={ws}*+(?:{span})?{years}|" + r"\+?" + f"{ws}*+(?:{years}|{yrs}))"
    # fixed values: number patterns, with plain words of which each needs one (a cheap test first)
    patterns = [
        (["year", "yr"], named),
        (["mum"], f"{X.fold_pattern('minimum')}{ws}+of{ws}+{num}"),
        (["lea"], f"at{ws}+{X.fold_pattern('least')}{ws}+{num}"),
    ]
    numbers = [
        F.when(X.any_contains(t, words), F.regexp_extract_all(t, F.lit(p), F.lit(1)))
        .otherwise(X.empty_strings())
        for words, p in patterns
    ]
    return F.array_max(F.transform(F.concat(*numbers), X.whole_number))


# --- education ---------------------------------------------------------------------

def _education_pattern(phrase: str) -> str:
    body = X.fold_pattern(phrase)
    return f"(?<!{X.WORD}){body}(?!{X.WORD})" if phrase in vocab.EDUCATION_WORDS else body


# fixed values: words of which each phrase of a level holds one (a cheap test first, so they have to be rare in prose)
_EDUCATION_LETTERS = {
    "high_school": ["chool"],
    "associate": ["ate degree", "ate'"],
    "bachelor": ["bachelor", "ba degree", "bs degree", "bſ degree", "b.sc", "b.ſc", "bsc", "bſc"],
    "master": ["ter degree", "ter'", "ms degree", "mſ degree", "m.sc", "m.ſc", "msc", "mſc", "mba"],
    "phd": ["phd", "ph.d", "doctor"],
}


def education_required(text: Column) -> Column:
    """Lowest education level named in a text; NULL if none."""
    ordered = sorted(vocab.EDUCATION_PHRASES, key=vocab.EDUCATION_RANK.get)

    def named(level):
        pattern = "|".join(_education_pattern(p) for p in vocab.EDUCATION_PHRASES[level])
        return X.any_contains(text, _EDUCATION_LETTERS[level]) & text.rlike(pattern)

    return F.coalesce(*[F.when(named(level), F.lit(level)) for level in ordered])


# --- seniority -----------------------------------------------------------------------

def posting_seniority(title: Column, text: Column, years: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    # fixed values: words and year limits, in order
    return (
        F.when(F.contains(t, F.lit("intern")) | F.contains(text, F.lit("internship")), "intern")
        .when(X.any_contains(t, ["junior", "entry-level", "entry level"]), "entry")
        .when(X.any_contains(t, ["manager", "director", "head", "vp", "principal"]), "manager")
        .when(X.any_contains(t, ["senior", "sr", "lead", "staff"]), "senior")
        .when(years >= 8, "senior")
        .when(years >= 4, "mid")
        .when(years.isNotNull(), "entry")
    )
