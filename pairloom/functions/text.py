"""Cleaning of titles and attributes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of units that are brought to one form after a digit.
INCH = r'(?U)(?<=\d)\s*-?\s*(?:-?inches|-?inch|Inches|Inch|")'
HERTZ = r"(?U)(?<=\d)\s*-?\s*(?:-?hz|-?Hz|HZ|Hertz|hertz)"
POUNDS_FIRST = r"(?U)(?<=\d)\s+lbs"
POUNDS = r"(?U)(?<=\d)\s*(?:pounds| lbs)"
FRACTION = r"(\d+-\d+/\d+)inch"
#: Whatever one of them replaces has this; other texts, which are most, are left alone.
UNIT = r'(?U)\d\s*-?\s*-?(?:inch|Inch|"|hz|Hz|HZ|Hertz|hertz|lbs|pounds)'


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fractional_inches(text: Column) -> Column:
    """11-1/8inch becomes 11.1inch, rounded half to even; a denominator of zero stays as it is."""

    def decimal(found: Column) -> Column:
        whole, rest = F.split_part(found, F.lit("-"), F.lit(1)), F.split_part(found, F.lit("-"), F.lit(2))
        over, under = (F.split_part(rest, F.lit("/"), F.lit(k)).cast("double") for k in (1, 2))
        return F.bround(whole.cast("double") + F.try_divide(over, under), 1)

    def step(done: Column, found: Column) -> Column:
        return F.coalesce(F.replace(done, F.concat(found, F.lit("inch")), F.concat(decimal(found).cast("string"), F.lit("inch"))), done)

    return let(text, lambda t: F.when(t.rlike(FRACTION), F.aggregate(F.regexp_extract_all(t, F.lit(FRACTION), F.lit(1)), t, step)).otherwise(t))


def clean(text: Column) -> Column:
    """Units in one form, then lower case."""

    def replaced(t: Column) -> Column:
        hertz = F.regexp_replace(fractional_inches(F.regexp_replace(t, INCH, "inch")), HERTZ, "hz")
        return F.regexp_replace(F.regexp_replace(hertz, POUNDS_FIRST, "lbs"), POUNDS, "lbs")

    return F.lower(let(text, lambda t: F.when(t.rlike(UNIT), replaced(t)).otherwise(t)))


def clean_map(features: Column) -> Column:
    """Keys and values cleaned; of keys that become one the last value stays."""
    entries = F.transform(F.map_entries(features), lambda e: F.struct(clean(e["key"]).alias("key"), clean(e["value"]).alias("value")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def put(done: Column, e: Column) -> Column:
        return F.map_concat(F.map_filter(done, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))

    def made(own: Column) -> Column:
        keys = F.transform(own, lambda e: e["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(own)).otherwise(F.aggregate(own, empty, put))

    return let(entries, made)


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def plain_title(title: Column) -> Column:
    """Without joining signs and the words and, or, the."""
    signs = F.regexp_replace(title, r"[&/\-_,]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(signs, r"(?i)\b(?:and|or|the)\b", " "), r"(?U)\s+", " "))
