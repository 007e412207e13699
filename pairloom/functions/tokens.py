"""Model words and other features of products, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Words of titles that count without a digit, and the patterns of model words.
TITLE_WORDS = ("hdtv", "led", "lcd", "smart", "ledlcd", "hd")
MODEL_WORD = r"[0-9][^0-9, ]|[^0-9, ][0-9]"
TITLE_FIND = r"([a-zA-Z0-9]*([0-9]+[^0-9, ]+)|([^0-9, ]+[0-9]+))[a-zA-Z0-9]*"
VALUE_FIND = r"([0-9]+(?:\.[0-9]+)?[a-zA-Z]+\z)|[0-9]+(?:\.[0-9]+)?\z"


def model_words(text: Column) -> Column:
    """Distinct words of a title that mix digits and other signs, or are among the fixed ones; sorted."""
    return F.array_sort(F.array_distinct(F.filter(words(text), lambda w: w.rlike(MODEL_WORD) | F.lower(w).isin(*TITLE_WORDS))))


def value_words(features: Column) -> Column:
    """Model words of all attribute values."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values(features), model_words))))


def _found(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(VALUE_FIND), F.lit(1)), lambda w: F.regexp_replace(w, "[a-zA-Z]+$", ""))


def numbers_with_unit(features: Column) -> Column:
    """Of values that end in a number with a unit the number, as text; distinct and sorted."""
    found = F.flatten(F.transform(F.map_values(features), _found))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: w != "")))


def counted_title_words(title: Column) -> Column:
    """What the vocabulary counts in a title: the first group of each match."""
    return F.filter(F.regexp_extract_all(title, F.lit(TITLE_FIND), F.lit(1)), lambda w: w != "")


def counted_numbers(features: Column) -> Column:
    """What the extended vocabulary counts: numbers with a unit, and an empty word for each without."""
    return F.flatten(F.transform(F.map_values(features), _found))


def screen_sizes(features: Column) -> Column:
    """Numbers before "inch" in attributes about the screen's or display's size; of values without, all numbers."""
    about = F.filter(F.map_entries(features), lambda e: e["key"].contains("screen size") | e["key"].contains("display size"))

    def sizes(e: Column) -> Column:
        inches = F.regexp_extract_all(e["value"], F.lit(r"(?i)(\d+\.?\d*)inch"), F.lit(1))
        return F.when(F.size(inches) > 0, inches).otherwise(F.regexp_extract_all(e["value"], F.lit(r"(\d+\.?\d*)"), F.lit(1)))

    return F.transform(F.flatten(F.transform(about, sizes)), lambda s: s.cast("double"))


def brand(features: Column) -> Column:
    """The attribute brand, or brand name."""
    return F.coalesce(F.nullif(features["brand"], F.lit("")), F.nullif(features["brand name"], F.lit("")))


def hybrid(word: Column) -> Column:
    """(word, number, letters) of a word; the number's digits without leading zeros, "0" for zero."""
    digits = F.regexp_replace(word, "[^0-9]", "")
    number = F.when(digits == "", digits).otherwise(F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0")))
    return F.struct(word.alias("word"), number.alias("number"), F.regexp_replace(word, r"\P{L}", "").alias("letters"))


def hybrids(found: Column) -> Column:
    """Those of the words that have digits and letters."""
    return F.filter(F.transform(found, hybrid), lambda h: (h["number"] != "") & (h["letters"] != ""))
