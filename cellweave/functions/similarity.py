"""How alike two values are, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.text import basic, let, without_parentheses


def tokens(text: Column, stops: tuple[str, ...], apart: tuple[str, ...] = ()) -> Column:
    """Runs of ASCII letters and digits, without stop words; a final s of longer ones is dropped. The hyphen in ``apart`` becomes a blank."""
    plain = without_parentheses(basic(text))
    for word in apart:
        plain = F.replace(plain, F.lit(word), F.lit(word.replace("-", " ")))
    found = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*stops))
    return F.transform(found, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def value_tokens(text: Column) -> Column:
    return tokens(text, fields.STOPS)


def diagnosis_tokens(text: Column) -> Column:
    return tokens(text, fields.DIAGNOSIS_STOPS, ("attention-deficit", "obsessive-compulsive"))


def cosine(left: Column, right: Column) -> Column:
    """Of two token arrays as multisets; the norms are multiplied as square roots, which decides ties at a threshold."""

    def times(tokens: Column, token: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == token))

    def squares(tokens: Column) -> Column:
        return F.aggregate(F.array_distinct(tokens), F.lit(0), lambda s, t: s + times(tokens, t) * times(tokens, t))

    both = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda s, t: s + times(left, t) * times(right, t))
    some = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(some, both / (F.sqrt(squares(left)) * F.sqrt(squares(right)))).otherwise(F.lit(0.0))


def interval(text: Column) -> Column:
    """STRUCT(low, high) of a number or a range of two, in order; null for other texts."""
    number = "\\d+(?:\\.\\d+)?"
    low = F.regexp_extract(text, f"^\\s*({number})\\s*(?:-\\s*{number}\\s*)?$", 1)
    high = F.regexp_extract(text, f"^\\s*{number}\\s*-\\s*({number})\\s*$", 1)

    def ends(x: Column) -> Column:
        a = x["a"].try_cast("double")
        b = F.when(x["b"] == "", a).otherwise(x["b"].try_cast("double"))
        return F.when(x["a"] != "", F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))

    return let(F.struct(low.alias("a"), high.alias("b")), ends)


def _shared_part(left: Column, right: Column) -> Column:
    l0, l1, r0, r1 = left["low"], left["high"], right["low"], right["high"]
    whole = (l0 == F.floor(l0)) & (l1 == F.floor(l1)) & (r0 == F.floor(r0)) & (r1 == F.floor(r1))
    reach = F.greatest(l1, r1) - F.least(l0, r0)
    shared = F.least(l1, r1) - F.greatest(l0, r0)
    counted = F.greatest(shared + 1, F.lit(0.0))
    by_count = counted / ((l1 - l0 + 1) + (r1 - r0 + 1) - counted)
    by_length = F.when(reach == 0, F.when(l0 == r0, 1.0).otherwise(0.0)).otherwise(F.greatest(shared, F.lit(0.0)) / reach)
    return F.when(left.isNotNull() & right.isNotNull(), F.when(whole & (reach <= 1000), by_count).otherwise(by_length))


def interval_overlap(left: Column, right: Column) -> Column:
    """Shared by covered whole numbers, or by length if a bound isn't whole or the span is over 1000; null unless both are intervals."""
    return let(F.struct(left.alias("l"), right.alias("r")), lambda x: _shared_part(x["l"], x["r"]))


def likeness(left: Column, right: Column, field: Column) -> Column:
    """One for equal values; else by intervals in fields of numbers, or by tokens."""
    by_tokens = let(F.struct(value_tokens(left).alias("l"), value_tokens(right).alias("r")), lambda x: cosine(x["l"], x["r"]))
    by_numbers = interval_overlap(interval(left), interval(right))
    return F.when(left == right, F.lit(1.0)).otherwise(F.coalesce(F.when(field.isin(*fields.INTERVALS), by_numbers), by_tokens))


def read_value(value: Column, field: Column) -> Column:
    """STRUCT(value, tokens, span): all that likeness needs of a value of a field, for values that are compared often."""
    return F.struct(value.alias("value"), value_tokens(value).alias("tokens"), F.when(field.isin(*fields.INTERVALS), interval(value)).alias("span"))


def read_likeness(left: Column, right: Column) -> Column:
    """likeness of two values as read_value gives them."""
    # tokens that share nothing need no counting
    by_tokens = F.when(~F.arrays_overlap(left["tokens"], right["tokens"]), 0.0).otherwise(cosine(left["tokens"], right["tokens"]))
    return F.when(left["value"] == right["value"], F.lit(1.0)).otherwise(F.coalesce(_shared_part(left["span"], right["span"]), by_tokens))
