"""Values to sets of canonical strings, as Catalyst expressions.

The order of steps decides results and is kept: a value is made plain, read as counts by gender, as an age, as a number
with a unit, and then looked up. The readings as gender and age apply to every field. A value's set is a sorted array,
empty for an absent value, never null.

Aliases of one's own are a dict of dicts: a field's name, or ``global``, to {raw: canonical}.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Mapping
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.similarity import cosine, diagnosis_tokens
from cellweave.functions.text import basic, constant_map, general, let, squeeze, without_parentheses

Aliases = Mapping[str, Mapping[str, str]]
NUMBER = "\\d+(?:\\.\\d+)?"


def _look_up(table: Mapping[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(constant_map(table), key)


def _plain(text: object) -> str:
    """What text.basic makes of a text, here in Python."""
    text = "".join(c for c in unicodedata.normalize("NFKD", str(text).lower().strip()) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub("[–—‐]", "-", text).replace("behaviour", "behavior")).strip()


def plain_keys(aliases: Aliases | None) -> dict[str, dict[str, str]]:
    """An alias file's sections with both sides made plain; its metadata is left out."""

    return {k: {_plain(a): _plain(b) for a, b in v.items()} for k, v in (aliases or {}).items() if k != "metadata" and isinstance(v, Mapping)}


def alias(text: Column, field: Column, aliases: Aliases | None = None) -> Column:
    """The canonical value of a text: one's own for the field first, with and without parentheses; then for either the field's, a
    country's, a general one or one's own general one; else the text."""
    aliases = aliases or {}

    def per_field(tables: Mapping[str, Mapping[str, str]], key: Column) -> Column:
        # one table for all fields, by field and value
        joined = {f"{name}\x1f{a}": b for name, table in tables.items() if name != "global" for a, b in table.items()}
        return _look_up(joined, F.concat(field, F.lit("\x1f"), key))

    def built_in(key: Column) -> Column:
        more = [_look_up(aliases["global"], key)] if aliases.get("global") else []
        return F.coalesce(per_field(fields.FIELD_VALUES, key), _look_up(fields.COUNTRIES | fields.VALUES, key), *more)

    def chain(both: Column) -> Column:
        text, bare = both["text"], both["bare"]
        own = [per_field(aliases, text), per_field(aliases, bare)] if any(k != "global" for k in aliases) else []
        return F.coalesce(*own, built_in(text), built_in(bare), text)

    return let(F.struct(text.alias("text"), without_parentheses(text).alias("bare")), chain)


@cache
def iso_countries() -> dict[str, str]:
    """The plain ISO 3166 name of a country by its codes of two and three letters, its name, and for some its common name; from the JVM's table, none without one.

    Numbers and official long names aren't in that table."""
    context = SparkContext._active_spark_context
    if context is None:
        return {}
    locale, out = context._jvm.java.util.Locale, {}
    for code in locale.getISOCountries():
        country = locale("", code)
        common = country.getDisplayCountry(locale.ENGLISH).replace("&", "and").replace("St. ", "Saint ")
        name = _plain(fields.ISO_NAMES.get(code, common))
        found = [code.lower(), country.getISO3Country().lower(), name, *([_plain(common)] if code in fields.ISO_COMMON else [])]
        out.update(dict.fromkeys(found, name))
    return out


def country(text: Column, aliases: Aliases | None = None) -> Column:
    """A country's canonical name: of its alias, or else of the text, the ISO 3166 name, if there is one."""
    return let(alias(text, F.lit("Country"), aliases), lambda t: F.coalesce(_look_up(iso_countries(), t), t))


def gender_counts(text: Column) -> Column:
    """female:n|male:m of a text that counts girls and boys, else the text. Counts after the word win over those before it."""
    plain = F.lower(squeeze(text))
    for word, sex in (("females", "female"), ("males", "male"), ("girls", "female"), ("girl", "female"), ("boys", "male"), ("boy", "male"), ("women", "female"), ("woman", "female"), ("men", "male"), ("man", "male")):
        plain = F.replace(plain, F.lit(word), F.lit(sex))
    for letter, sex in (("f", "female"), ("m", "male")):
        plain = F.regexp_replace(plain, f"(\\d+)\\s*{letter}\\b", f"$1 {sex}")
    for letter, sex in (("f", "female"), ("m", "male")):
        plain = F.regexp_replace(plain, f"\\b{letter}\\s*(\\d+)", f"$1 {sex}")

    def counts(plain: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("decimal(38,0)"))

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("decimal(38,0)"), lambda s, n: (s + n).cast("decimal(38,0)")).cast("string")

    def tell(plain: Column) -> Column:
        before = [counts(plain, f"(\\d+)\\s*{sex}\\b") for sex in ("female", "male")]
        after = [counts(plain, f"\\b{sex}\\s*(\\d+)") for sex in ("female", "male")]
        return F.struct(before[0].alias("f"), before[1].alias("m"), after[0].alias("fa"), after[1].alias("ma"))

    def spell(found: Column) -> Column:
        late = (F.size(found["fa"]) > 0) | (F.size(found["ma"]) > 0)
        f, m = F.when(late, found["fa"]).otherwise(found["f"]), F.when(late, found["ma"]).otherwise(found["m"])
        parts = [F.when(F.size(x) > 0, F.concat(F.lit(f"{sex}:"), total(x))) for sex, x in (("female", f), ("male", m))]
        return F.concat_ws("|", *parts)

    return let(let(let(plain, tell), spell), lambda told: F.when(told == "", text).otherwise(told))


def _span(text: Column, pattern: str) -> Column:
    """The two numbers that a pattern finds, as a range."""
    low, high = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(low != "", F.concat(general(low.try_cast("double")), F.lit("-"), general(high.try_cast("double"))))


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", general(found.try_cast("double")))


def age(text: Column) -> Column:
    """A number or a range of an age, else the text."""
    plain = F.regexp_replace(F.regexp_replace(basic(text), "^(?:age|ages|aged)\\s+", ""), "^age range\\s+", "")
    for word in ("years old", "year old", "years", "year", "yrs", "yr", "y/o", "yo"):
        plain = F.replace(plain, F.lit(word), F.lit(""))
    plain = F.regexp_replace(squeeze(F.replace(plain, F.lit("to"), F.lit("-"))), "\\s*-\\s*", "-")
    return let(F.struct(text.alias("text"), plain.alias("age")), lambda x: F.coalesce(_number(x["age"], f"^({NUMBER})$"), _span(x["age"], f"^({NUMBER})-({NUMBER})$"), x["text"]))


def with_units(text: Column, field: Column) -> Column:
    """A number of weeks or sessions, or a range of them, in the fields that have such; else the text."""
    plain = squeeze(F.regexp_replace(text, "\\bapproximately\\b|\\babout\\b|\\baround\\b|\\bapprox\\.?\\b", ""))
    week, session = "(?:week|weeks|wk|wks)", "(?:session|sessions)"

    def read(x: Column) -> Column:
        value, text = x["value"], x["text"]
        weeks = F.coalesce(_number(value, f"^({NUMBER})\\s*{week}\\b"), _span(value, f"^({NUMBER})\\s*(?:to|-)\\s*({NUMBER})\\s*{week}$"), _number(value, f"^({NUMBER})\\s*{session}$"))
        sessions = F.coalesce(_number(value, f"^({NUMBER})\\s*{session}$"), _span(value, f"^({NUMBER})\\s*(?:to|-)\\s*({NUMBER})\\s*{session}?$"))
        bracketed = _number(value, f"^({NUMBER})\\s*\\(")
        late = _number(value, f"^({NUMBER})\\s+sessions?\\b")
        return F.coalesce(F.when(field == "Treatment length", weeks), F.when(field == "Number of sessions", sessions), bracketed, F.when(field == "Number of sessions", late), text)

    return F.when(field.isin(*fields.UNITS), let(F.struct(text.alias("text"), plain.alias("value")), read)).otherwise(text)


def label_tokens(label: str) -> list[str]:
    """What diagnosis_tokens gives for a plain ASCII label."""
    plain = label.replace("attention-deficit", "attention deficit").replace("obsessive-compulsive", "obsessive compulsive").replace("behaviour", "behavior").lower()
    found = [t for t in re.findall("[a-z0-9]+", plain) if t not in fields.DIAGNOSIS_STOPS]
    return [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in found]


def nearest_label(text: Column, labels: tuple[str, ...] = fields.DIAGNOSIS_LABELS, least: float = fields.SIMILAR_DIAGNOSIS) -> Column:
    """The label that a text is most like, the first in order among equals, if it's alike enough; else the text."""
    told = [{"label": x, "tokens": label_tokens(x)} for x in sorted(labels)]
    words = F.from_json(F.lit(json.dumps(told)), "array<struct<label:string,tokens:array<string>>>")

    def best(x: Column) -> Column:
        start = F.struct(x["text"].alias("label"), F.lit(0.0).alias("score"))

        def closer(held: Column, label: Column) -> Column:
            return let(cosine(x["tokens"], label["tokens"]), lambda s: F.when(s > held["score"], F.struct(label["label"].alias("label"), s.alias("score"))).otherwise(held))

        return let(F.aggregate(words, start, closer), lambda b: F.when(b["score"] >= least, b["label"]).otherwise(x["text"]))

    return let(F.struct(text.alias("text"), diagnosis_tokens(text).alias("tokens")), best)


def atom(text: Column, field: Column, aliases: Aliases | None = None) -> Column:
    """The canonical string of one value given as text; null if it's absent."""
    trimmed = F.trim(F.regexp_replace(text, "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$", ""))
    own = (aliases or {}).get("Primary diagnosis", {}).values()
    labels = tuple(sorted({*fields.DIAGNOSIS_LABELS, *(x for x in own if x)}))
    diagnosis, treatment, design = field.isin(*fields.DIAGNOSES), field == "Type of treatments", field == "Type of SCED design"

    def before(t: Column) -> Column:
        """What a field alone does before the general aliases; fields that have such a step have one."""
        known = let(alias(t, field, aliases), lambda a: F.when(a != t, a).otherwise(without_parentheses(t)))
        out = F.when(field.isin(*fields.UNITS), with_units(t, field)).when(field == "Country", country(t, aliases)).when(diagnosis, known)
        return out.when(field == "Ethnicity / Race", F.trim(F.regexp_replace(t, "\\s+\\d+$", ""))).otherwise(t)

    def after(t: Column) -> Column:
        """And what it does after them."""
        bare = F.trim(F.regexp_replace(t, "\\s+(?:treatment|intervention|medication)$", ""))
        out = F.when(treatment, alias(bare, field, aliases)).when(design, alias(F.replace(t, F.lit("multiple-baseline"), F.lit("multiple baseline")), field, aliases))
        return out.when(diagnosis, nearest_label(t, labels)).otherwise(t)

    # each step is a level of the expression, and these are bounded
    steps: list[Callable[[Column], Column]] = [gender_counts, age, before, lambda t: alias(t, field, aliases), after]

    def run(t: Column) -> Column:
        out = basic(t)
        for step in steps:
            out = let(out, step)
        unreported = field.isin(*fields.UNREPORTED_IS_ABSENT) & basic(t).isin(*fields.UNREPORTED)
        return F.when((t == "") | F.lower(t).isin(*fields.ABSENT) | unreported, F.lit(None).cast("string")).otherwise(out)

    return let(trimmed, run)


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, f"\\s*(?:{pattern})\\s*"), lambda x: F.trim(x)), lambda x: x != "")


def treatments(text: Column, aliases: Aliases | None = None) -> Column:
    """The treatments that a plain text names, or null if it's one that has no other name."""
    field = F.lit("Type of treatments")

    def phrase(t: Column) -> Column:
        bare = without_parentheses(basic(t))

        def known(b: Column) -> Column:
            a = alias(b, field, aliases)
            return F.coalesce(
                F.when(a != b, a),
                F.when(b.rlike("(?:^|[^a-z0-9])c\\.?\\s*b\\.?\\s*t\\.?(?:$|[^a-z0-9])"), "cognitive behavioral therapy"),
                F.when(F.contains(b, F.lit("parent child interaction therapy")), "parent child interaction therapy"),
                F.when(b.rlike("\\bcognitive behavior(?:al)? therapy\\b"), "cognitive behavioral therapy"),
                F.when(F.contains(b, F.lit("interpersonal psychotherapy")), "interpersonal psychotherapy"),
                F.when(F.contains(b, F.lit("attention bias modification")), "attention bias modification"),
            )

        return let(bare, known)

    def parts(t: Column) -> Column:
        whole = F.replace(F.replace(without_parentheses(t), F.lit("compassion-focused therapy"), F.lit("compassion focused therapy")), F.lit("cft"), F.lit("compassion focused therapy"))
        named = F.transform(_split(squeeze(whole), "\\+|;|/|,"), lambda p: squeeze(F.coalesce(phrase(p), alias(p, field, aliases))))
        return let(named, lambda n: F.when(F.size(n) > 0, n))

    def read(t: Column) -> Column:
        a = alias(t, field, aliases)
        single = let(phrase(t), lambda p: F.when(p.isNotNull(), F.array(p)))
        return let(a, lambda a: F.when(t == "", F.lit(None)).when(a != t, F.array(a)).when(~t.rlike("[+;/,(]"), single).otherwise(parts(t)))

    return let(text, read)


def split_value(text: Column, field: Column, aliases: Aliases | None = None) -> Column:
    """The values that one text of a field lists, or null if it's not to be split."""

    def read(t: Column) -> Column:
        country = F.replace(F.replace(t, F.lit("new zealand-aus"), F.lit("new zealand/australia")), F.lit("aus-new zealand"), F.lit("australia/new zealand"))
        both = F.array(F.lit("diagnosis"), F.lit("frequent assessment"))
        data = let(alias(t, field, aliases), lambda a: F.when(a == "diagnosis and frequent assessment", both).when(t.rlike("/|\\band\\b|\\+"), _split(t, "/|\\band\\b|\\+")))
        out = (
            F.when(field == "Primary diagnosis", F.when(F.contains(t, F.lit(";")), _split(t, ";")))
            .when(field == "Country", let(country, lambda c: F.when(c.rlike(",|/|\\band\\b"), _split(c, ",|/|\\band\\b"))))
            .when(field.isin("Ethnicity / Race", "Setting"), F.when(t.rlike("[,;/]"), _split(t, "[,;/]")))
            .when(field == "Data availability", data)
            .when(field == "Type of treatments", treatments(t, aliases))
        )
        return F.when(t != "", let(out, lambda o: F.when(F.size(o) > 0, o)))

    return F.when(field.isin(*fields.SPLIT), let(basic(text), read))


def covering_range(values: Column) -> Column:
    """Of several ages the range from the lowest, rounded down, to the highest, rounded up; other sets as they are."""
    from cellweave.functions.similarity import interval

    def read(x: Column) -> Column:
        low, high = F.array_min(F.transform(x["spans"], lambda s: s["low"])), F.array_max(F.transform(x["spans"], lambda s: s["high"]))
        one = F.array(general(low))
        span = F.array(F.concat(general(F.floor(low).cast("double")), F.lit("-"), general(F.ceil(high).cast("double"))))
        all_ages = (F.size(x["values"]) > 1) & ~F.exists(x["spans"], F.isnull)
        return F.when(all_ages, F.when(low == high, one).otherwise(span)).otherwise(x["values"])

    return let(F.struct(values.alias("values"), F.transform(values, interval).alias("spans")), read)


def item_text(item: Column) -> Column:
    """A variant as the text that is normalized: numbers with twelve digits, objects as JSON; null for null."""
    kind = F.schema_of_variant(item)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    plain = F.when(kind == "VOID", F.lit(None)).when(kind == "STRING", F.try_variant_get(item, "$", "string"))
    return plain.when(kind == "BOOLEAN", F.lower(F.try_variant_get(item, "$", "string"))).when(number, general(F.try_variant_get(item, "$", "double"))).otherwise(F.to_json(item))


def value_set(value: Column, field: Column, aliases: Aliases | None = None) -> Column:
    """The set of a variant value: its items', or its own; a sorted array."""
    listed = F.schema_of_variant(value).startswith("ARRAY")
    items = F.when(listed, F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))

    def of_item(item: Column) -> Column:
        def read(x: Column) -> Column:
            parts = F.when(x["kind"] == "STRING", split_value(x["text"], field, aliases))
            # numbers and booleans are canonical already, objects go through as text
            told = x["kind"].rlike("^(STRING|OBJECT|ARRAY)")
            return F.transform(F.coalesce(parts, F.array(x["text"])), lambda t: F.when(told, atom(t, field, aliases)).otherwise(t))

        return let(F.struct(item_text(item).alias("text"), F.schema_of_variant(item).alias("kind")), read)

    flat = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(items, of_item)))))
    flat = let(flat, lambda s: F.when(listed & (field == "Age"), covering_range(s)).otherwise(s))
    return F.coalesce(F.when(value.isNotNull(), flat), F.array().cast("array<string>"))
