"""Text, list, JSON, hash and number functions as Spark columns."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from rolefit.functions import vocab

# Explicit classes: Java's \s, \w, \d are ASCII, and (?U) is not the same set
# as the one these results are defined on. Also valid in RE2.
WS = r"[\p{Z}\t-\r\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# One blank that is alone stays as it is, so only the other runs are matched.
_BLANK_RUN = r"[\p{Z}\t-\r\x1c-\x1f\x85&&[^ ]]" + WS + "*| " + WS + "+"
# The same characters one by one, for trimming without a pattern.
_BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def empty_strings() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def sql_literal(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def literal_array(values: list) -> Column:
    return F.expr("array(" + ", ".join(map(sql_literal, values)) + ")")


def literal_map(entries: dict) -> Column:
    """A fixed table as one expression (one call instead of one per entry)."""
    return F.expr("map(" + ", ".join(sql_literal(x) for kv in entries.items() for x in kv) + ")")


def folded_map(entries: dict[str, str]) -> Column:
    """A large fixed table of texts, as one literal from the start."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string, string>")


def lookup(entries: dict, key: Column) -> Column:
    """Value of a fixed table, NULL where the key is unknown or NULL."""
    return F.try_element_at(literal_map(entries), key)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` has it and also inside a lambda."""
    return F.transform(F.array(value), use)[0]


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANK_RUN, " "))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def clean_text(c: Column) -> Column:
    return F.coalesce(collapse(c.cast("string")), F.lit(""))


def normalize_text_basic(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(clean_text(c)), r"[^\p{L}\p{N}_ +#.]", " ")
    return F.trim(F.regexp_replace(kept, "  +", " "))


def norm_key(c: Column) -> Column:
    """Strip and lower, NULL as ''."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def stable_hash(c: Column) -> Column:
    return F.sha2(clean_text(c), 256)


def clean_html(c: Column) -> Column:
    no_tags = F.regexp_replace(c, "<[^>]+>", " ")
    no_entities = F.regexp_replace(no_tags, "&(?:nbsp|amp|lt|gt|#39|quot);", " ")
    return clean_text(no_entities)


# A tag, whose quoted attribute values may hold ">"; else the shortest thing that looks like one.
_TAG = """<(?:[^>"']++|"[^"]*+"|'[^']*+')++>|<[^>]+>"""

# Comments, and elements whose content is never shown as text.
_HIDDEN = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
           r"|<template\b.*?</template\s*>")
_NUMBERED = "^#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?"
# Some names are known without a semicolon; the longest one counts.
_OPEN_NAME = "^(" + "|".join(sorted(vocab.OPEN_HTML_ENTITIES, key=len, reverse=True)) + ")"


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numbered_character(part: Column) -> Column:
    """Character of a number with any count of digits; one that is no character gives the replacement character."""
    decimal, hexadecimal = (F.regexp_extract(part, _NUMBERED, k) for k in (1, 2))
    number = (
        F.when(F.length(decimal).between(1, 7), decimal.try_cast("int"))
        .when(F.length(hexadecimal).between(1, 6), F.conv(hexadecimal, 16, 10).try_cast("int"))
        .otherwise(0)
    )
    mapped = F.coalesce(F.try_element_at(literal_map(vocab.C1_CHARACTERS), number), number)
    valid = (mapped > 0) & (mapped < 0x110000) & ~mapped.between(0xD800, 0xDFFF)
    return F.when(valid, _code_point(mapped)).otherwise("\ufffd")


def _decode_entity(part: Column) -> Column:
    """``part`` is what follows one '&' up to the next."""
    number = F.regexp_extract(part, _NUMBERED, 0)
    name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
    open_name = F.regexp_extract(part, _OPEN_NAME, 1)

    def after(length):
        return part.substr(length + 1, F.length(part))

    known = F.coalesce(lookup(vocab.HTML_ENTITIES, name), F.try_element_at(folded_map(vocab.RARE_HTML_ENTITIES), name))
    return (
        F.when(number != "", F.concat(_numbered_character(part), after(F.length(number))))
        .when((name != "") & known.isNotNull(), F.concat(known, after(F.length(name) + 1)))
        .when(open_name != "", F.concat(F.try_element_at(folded_map(vocab.OPEN_HTML_ENTITIES), open_name), after(F.length(open_name))))
        .otherwise(F.concat(F.lit("&"), part))
    )


def decode_entities(c: Column) -> Column:
    """Each character reference is decoded once; unknown names stay."""
    def decoded(text: Column) -> Column:
        parts = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(_decode_entity(p)))
        return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)

    return bound(c, decoded)


def html_to_text(c: Column) -> Column:
    visible = F.regexp_replace(F.regexp_replace(c, _HIDDEN, " "), _TAG, " ")
    return clean_text(decode_entities(visible))


def normalize_location_text(c: Column) -> Column:
    cleaned = clean_text(c)
    key = F.replace(F.lower(cleaned), F.lit("."), F.lit(""))
    return F.coalesce(lookup(vocab.LOCATION_REPLACEMENTS, key), cleaned)


def first_years_of_experience(c: Column) -> Column:
    """First "N years of experience" number in a text, or NULL."""
    pattern = (f"(?iu)({DIGIT}+)" + r"\+?" + f"{WS}*(?:years|year|yrs|yr){WS}+"
               f"(?:of{WS}+)?experience")
    return whole_number(F.regexp_extract(clean_text(c), pattern, 1))


# --- lists ---------------------------------------------------------------------

def clean_items(items: Column) -> Column:
    """Strip and lower each item, drop blanks; order and repeats stay."""
    lowered = F.transform(F.coalesce(items, empty_strings()), norm_key)
    return F.filter(lowered, lambda v: v != "")


def item_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(clean_items(items)))


def merge_unique(*lists: Column) -> Column:
    """Items of all lists, first-seen order, no repeats."""
    return F.array_distinct(clean_items(F.concat(*[F.coalesce(x, empty_strings()) for x in lists])))


def candidate_list(c: Column, is_array: bool) -> Column:
    """Cleaned, lowered, sorted and distinct items of a list or a delimited string."""
    items = c if is_array else F.split(c, r"[;,|/]+")
    cleaned = F.transform(F.coalesce(items, empty_strings()), lambda v: F.lower(clean_text(v)))
    return F.sort_array(F.array_distinct(F.filter(cleaned, lambda v: v != "")))


# The one-letter escapes of a quoted item.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": ""}
_CELL_TOKENS = r"""(?s)\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)|['",\[\]]|\s+|[^\\'",\[\]\s]+|\\"""
_CELL_BARE = r"^(?:None|True|False|0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]*)\.(?:0|[0-9]*[1-9]))$"


def _unescaped(token: Column) -> Column:
    """What an escape stands for; unknown ones stand for themselves."""
    kind, digits = F.substring(token, 2, 1), F.substring(token, 3, 8)
    out = F.when((kind == "u") & (F.length(token) == 6), F.from_json(F.concat(F.lit('["'), token, F.lit('"]')), "array<string>")[0])
    out = out.when((kind == "x") & (F.length(token) == 4), F.char(F.conv(digits, 16, 10).cast("int")))
    out = out.when(token.rlike(r"^\\[0-7]{1,3}$"), F.char(F.conv(F.substring(token, 2, 3), 8, 10).cast("int")))
    for letter, meaning in ESCAPES.items():
        out = out.when((kind == letter) & (F.length(token) == 2), meaning)
    return out.otherwise(token)


def literal_list(text: Column) -> Column:
    """Items of a list literal of quoted items, numbers, None, True and False; NULL if the text is none.

    One pass over its quotes, escapes, commas, brackets and the runs between them. ``mode`` is what the next token is
    read as: a value, the inside of a quote, what follows a value, the end, or broken.
    """
    tokens = F.regexp_extract_all(text, F.lit(_CELL_TOKENS), F.lit(0))

    def state(mode, item, items, quoted):
        return F.struct(mode.alias("mode"), item.alias("item"), items.alias("items"), quoted.alias("quoted"))

    broken, empty = F.lit("x"), F.lit("")

    def step(at, t):
        mode, item, items, quoted = at["mode"], at["item"], at["items"], at["quoted"]
        is_quote, space = t.isin("'", '"'), t.rlike(r"^\s+$")
        inside = (
            F.when(t == mode, state(F.lit("after"), item, items, F.lit(True)))
            .when(F.length(t) > 1, F.when(t.startswith("\\"), state(mode, F.concat(item, _unescaped(t)), items, quoted))
                  .when(t.rlike(r"[\n\r]"), state(broken, item, items, quoted))
                  .otherwise(state(mode, F.concat(item, t), items, quoted)))
            .when(t.isin("\n", "\r", "\\"), state(broken, item, items, quoted))
            .otherwise(state(mode, F.concat(item, t), items, quoted)))
        value = (
            F.when(space, at).when(is_quote, state(t, empty, items, F.lit(True)))
            .when(t == "]", state(F.lit("end"), empty, items, quoted))
            .when(t.rlike(_CELL_BARE), state(F.lit("after"), t, items, F.lit(False)))
            .otherwise(state(broken, item, items, quoted)))
        after = (
            F.when(space, at).when(is_quote & quoted, state(t, item, items, quoted))
            .when(t == ",", state(F.lit("value"), empty, F.concat(items, F.array(item)), quoted))
            .when(t == "]", state(F.lit("end"), empty, F.concat(items, F.array(item)), quoted))
            .otherwise(state(broken, item, items, quoted)))
        return (F.when(mode.isin("'", '"'), inside).when(mode == "value", value).when(mode == "after", after)
                .otherwise(state(broken, item, items, quoted)))

    start = state(F.lit("value"), empty, empty_strings(), F.lit(False))
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    last = F.aggregate(rest, start, step)
    return F.when(text.startswith("["), F.when(last["mode"] == "end", last["items"]))


def cell_list(c: Column) -> Column:
    """List held in one table cell: a list literal, else comma text. Literals with nested values count as comma text."""
    text = strip(c)
    items = F.when(text != "", F.coalesce(literal_list(text), F.split(text, ",")))
    stripped = F.transform(items, strip)
    return F.coalesce(F.filter(stripped, lambda v: v != ""), empty_strings())


def comma_list(c: Column) -> Column:
    """Comma text to list."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(items, lambda v: v != "")


def join_list(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


# --- JSON ------------------------------------------------------------------------

def list_to_json(items: Column) -> Column:
    return F.to_json(F.coalesce(items, empty_strings()))


def json_to_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), empty_strings())


def json_of_map(m: Column) -> Column:
    """JSON object with its keys sorted; a missing map gives '{}'."""
    entries = F.sort_array(F.map_entries(m))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


# --- numbers ---------------------------------------------------------------------

def round_binary(x: Column, digits: int) -> Column:
    """Round the binary value, ties to even, as IEEE text formatting does.

    Only values next to a tie need the exact decimal expansion; all others are
    settled by plain arithmetic.
    """
    scale = 10.0 ** digits
    scaled = x * F.lit(scale)
    floor = F.floor(scaled).cast("double")
    rest = scaled - floor
    exact = F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")
    return (
        F.when(F.abs(rest - 0.5) < 1e-6, exact)
        .when(rest > 0.5, (floor + 1.0) / scale)
        .otherwise(floor / scale)
    )


def general_number(x: Column) -> Column:
    """Six significant digits without trailing zeros: 6, 2.5, 33.3333, 1.23457e+06."""
    x = x.cast("double")
    text = F.format_string("%.5e", x)
    exponent = F.substring_index(text, "e", -1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", "")
    exact = x.try_cast("decimal(38,18)")
    # Ties go to the even digit; below 1 there are none worth a name.
    rounded = F.coalesce(*[F.when(exponent == e, F.bround(exact, 5 - e).cast("string")) for e in range(6)],
                         F.concat(digits, F.lit("e"), exponent).try_cast("decimal(38,12)").cast("string"))
    plain = F.when(F.contains(rounded, F.lit(".")), F.regexp_replace(rounded, r"\.?0+$", "")).otherwise(rounded)
    return (
        F.when(x.isNull(), None)
        .when((x == F.floor(x)) & (F.abs(x) < 1e6), x.cast("bigint").cast("string"))
        .when(exponent.between(-4, 5), plain)
        .otherwise(F.concat(digits, F.lit("e"), F.substring_index(text, "e", -1)))
    )


# Fits a BIGINT, and a DOUBLE without rounding.
LARGEST_NUMBER = 10**18


@cache
def _digit_tables() -> tuple[str, str]:
    """All decimal digits but ASCII's, and the ASCII digits of their values."""
    digits = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def whole_number(digits: Column) -> Column:
    """Number of a run of decimal digits of any script; NULL for no digits. Larger ones count as LARGEST_NUMBER."""
    number = F.translate(digits, *_digit_tables()).try_cast("bigint")
    return F.when(digits != "", F.least(F.coalesce(number, F.lit(LARGEST_NUMBER)), F.lit(LARGEST_NUMBER)))


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fold_pattern(literal: str) -> str:
    """Pattern of a lower-case literal that also takes the letters which
    case-insensitive Unicode matching equates with i and s."""
    out = []
    for ch in literal:
        if ch == "i":
            out.append("[iı]")
        elif ch == "s":
            out.append("[sſ]")
        elif ch.isalnum() or ch in " _":
            out.append(ch)
        else:
            out.append("\\" + ch)
    return "".join(out)


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as a standalone term."""
    body = "|".join(fold_pattern(p) for p in phrases)
    return f"(?<!{WORD})(?:{body})(?!{WORD})"
