"""Text as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Hangul syllables are made of these letters by arithmetic: the first ones, the vowels, and the last ones, of which none is one.
HANGUL = "[\\uAC00-\\uD7A3]"
LEADS, VOWELS, TAILS = (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3))


@cache
def _plain_letters() -> tuple[str, str, dict[str, str], str]:
    """Of all code points but Hangul syllables: those that one other stands for without accents, and these; those that several or none stand for; the combining ones."""
    one_from, one_to, more, marks = [], [], {}, []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "\uac00" <= c <= "\ud7a3" or "\ud800" <= c <= "\udfff":
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one_from.append(c)
            one_to.append(plain)
        elif plain != c:
            more[c] = plain
    return "".join(one_from), "".join(one_to), more, "".join(marks)


def _class_of(letters: str) -> str:
    """A character class of letters in order, as ranges."""
    points, spans = sorted(map(ord, letters)), []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


NOT_ASCII = "[^\\x00-\\x7F]"


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition (NFKD) of all code points without combining marks. ASCII texts are themselves."""
    return let(text, lambda t: F.when(t.rlike(NOT_ASCII), _decomposed(t)).otherwise(t))


def _decomposed(text: Column) -> Column:
    one_from, one_to, more, marks = _plain_letters()
    odd = _class_of("".join(more))[:-1] + HANGUL[1:]
    # a map is searched from end to end, so only what is in it is looked up
    known = F.lit("".join(more))

    def compose(c: Column) -> Column:
        s, letters = F.ascii(c) - 0xAC00, ["".join(map(chr, r)) for r in (LEADS, VOWELS, TAILS)]
        place = (F.floor(s / 588), F.floor(s % 588 / 28), s % 28 - 1)
        return F.concat(*(F.when(p >= 0, F.substring(F.lit(x), (p + 1).cast("int"), F.lit(1))).otherwise("") for x, p in zip(letters, place, strict=True)))

    def spell(c: Column) -> Column:
        return F.when(c == "", c).when(F.contains(known, c), F.try_element_at(constant_map(more), c)).when(c.rlike(HANGUL), compose(c)).otherwise(c)

    # few texts have letters that stand for several; the others' letters, and what has no partner, are a matter of one table
    spelled = F.when(text.rlike(odd), F.array_join(F.transform(F.split(text, ""), spell), "")).otherwise(text)
    return F.translate(spelled, one_from + marks, one_to)


def constant_map(table: Mapping[str, str]) -> Column:
    """A map that the optimizer folds into one literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(dict(sorted(table.items())))), "map<string,string>")


#: White space in the Unicode sense, written out, as regular expressions' own class of it is slow; and that other than the blank.
ODD_SPACE = "[\\x09-\\x0D\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SPACE = ODD_SPACE.replace("x1F", "x20", 1)


def squeeze(text: Column) -> Column:
    """White space, in the Unicode sense, as single blanks, none at the ends. Most runs are single blanks already, which stay as they are."""
    return F.trim(F.regexp_replace(text, f"{ODD_SPACE}{SPACE}*| {SPACE}+", " "))


def basic(text: Column) -> Column:
    """Lower case, no accents, plain dashes, American spelling of behavior, single blanks."""
    def plain(t: Column) -> Column:
        # what isn't ASCII may lose accents, and become white space
        dashes = F.translate(_decomposed(t), "–—‐", "---")
        return F.when(t.rlike(NOT_ASCII), squeeze(dashes)).otherwise(t)

    return F.replace(let(F.lower(squeeze(text)), plain), F.lit("behaviour"), F.lit("behavior"))


def without_parentheses(text: Column) -> Column:
    return F.trim(F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, f"{SPACE}*+\\([^)]*\\)", "")).otherwise(text))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def unicode_slug(text: Column) -> Column:
    """Lower-case letters and digits of any script only."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def for_quotes(text: Column) -> Column:
    """How quotes and sources are compared: single blanks, lower case."""
    return F.lower(squeeze(text))


def author_year(citation: Column) -> tuple[Column, Column]:
    """The first word, lower-cased, and the first year of a citation."""
    author = F.lower(F.regexp_extract(F.trim(citation), "^([^\\s,(&]+)", 1))
    return author, F.regexp_extract(citation, "((?:19|20)\\d{2})", 1)


def general(number: Column) -> Column:
    """A double with twelve significant digits, without trailing zeros: 3, 4.5, 1e+15."""

    def spell(told: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(told, "e.*$", ""), "[-.]", "")
        power = F.regexp_extract(told, "e(.*)$", 1).try_cast("int")
        sign = F.when(told.startswith("-"), "-").otherwise("")
        bare = F.regexp_replace(digits, "0+$", "")
        whole = F.rpad(F.substring(digits, 1, 12), 12, "0")
        plain_big = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.substring(whole, power + 2, F.lit(12)))
        plain_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole)
        plain = F.regexp_replace(F.regexp_replace(F.when(power >= 0, plain_big).otherwise(plain_small), "0+$", ""), "\\.$", "")
        mantissa = F.regexp_replace(F.concat(F.substring(bare, 1, 1), F.lit("."), F.substring(bare, 2, 12)), "\\.$", "")
        power_text = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
        out = F.when((power >= -4) & (power < 12), plain).otherwise(F.concat(mantissa, F.lit("e"), power_text))
        return F.concat(sign, out)

    # most numbers are whole ones of few digits, which need no format
    whole = (number == F.floor(number)) & (F.abs(number) < 1e11)
    return F.when(number == 0, "0").when(whole, number.cast("long").cast("string")).otherwise(let(F.format_string("%.11e", number), spell))


def chunks(text: Column, size: int) -> Column:
    """A text cut into pieces of so many characters; an empty text has none."""
    if size <= 0:
        raise ValueError("a chunk has at least one character")
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: The first and the last line of a text that is one code fence of Markdown.
FENCE_LINES = r"^```[^\n]*(?:\n|$)|(?:^|\n)[^\S\n]*```[^\S\n]*$"
FENCED = r"```(?:[a-zA-Z]+)?\s*(.*?)```"


def without_fence(text: Column) -> Column:
    """An answer without the code fence around it, or what a fence amid prose holds. What begins as JSON is itself, whatever its strings hold."""

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")

    def read(t: Column) -> Column:
        inner = F.regexp_extract(t, f"(?s){FENCED}", 1)
        return F.when(t.startswith("```"), F.regexp_replace(t, FENCE_LINES, "")).when(~t.rlike("^[{\\[]") & (inner != ""), inner).otherwise(t)

    return strip(let(strip(text), read))


def plain_answer(answer: str) -> str:
    """without_fence of a text in Python, where an answer comes in."""
    text = answer.strip()
    if text.startswith("```"):
        return re.sub(FENCE_LINES, "", text).strip()
    found = None if text[:1] in ("{", "[") else re.search(FENCED, text, re.DOTALL)
    return (found[1] if found and found[1] else text).strip()


def split_labels(text: Column) -> Column:
    """Parts between ; , / and |, without blank ones."""
    return F.filter(F.transform(F.split(text, "[;,/|]"), lambda x: F.trim(x)), lambda x: x != "")


def told(value: Column) -> Column:
    """A variant as a label's text: None for null, True and False, strings as they are, other things as their JSON; trimmed."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.to_json(value))).when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.regexp_replace(text, "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$", "")
