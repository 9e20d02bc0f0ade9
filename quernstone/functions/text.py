"""Normalisation of order texts and item names, as column expressions.

The steps run in the order given; the order matters, and the whole is not
idempotent.  Classes of characters are Unicode's (``(?U)``), as in the texts'
origin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote marks that stand for inches, words that carry no meaning, and words with one meaning.
INCH = "(?:''|\"|”)"
LEADING = "item|product|order|qty"
FILLERS = "please|pls|need|urgent|send"
CHATTER = "pls|please|urgent|need|send|thanks|bro"
SYNONYMS = (("zp", "zinc plated"), ("ss304", "stainless 304"), ("ss316", "stainless 316"), ("putih", "white"))
FRACTION = "<FRAC>"
VARIANTS = ("flap", "cutting", "grinding")
BULK = r"\s*\(\s*bulk\s*\)\s*"


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form; texts of ASCII alone are in it already.

    Spark has no function for it, but carries the library that its collations use.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def normalize_text(c: Column) -> Column:
    c = F.lower(nfkc(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, rf"(?U)(\d+)\s*/\s*(\d+)\s*{INCH}", f"$1{FRACTION}$2in")
    c = F.regexp_replace(c, rf"(?U){INCH}\s*(\d+(?:\.\d+)?)\s*(?=[a-z])", "$1in ")
    c = F.regexp_replace(c, rf"(?U)(\d+(?:\.\d+)?)\s*{INCH}", "$1in")
    c = F.regexp_replace(c, r"[/_|,;:]+", " ")
    c = F.replace(c, F.lit(FRACTION), F.lit("/"))
    c = F.regexp_replace(c, rf"(?U)^\s*({LEADING})\s*[-:=]?\s*", "")
    c = F.regexp_replace(c, rf"(?U)\b(?:{FILLERS})\b", " ")
    for word, meaning in SYNONYMS:
        c = F.regexp_replace(c, rf"(?U)\b{word}\b", meaning)
    c = F.regexp_replace(c, r"(?U)\s+-\s+", " ")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """The distinct words of a normalised text, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda x: x != "")))


def extract_numbers(c: Column) -> Column:
    """Distinct sizes and numbers of a text: fractions of inches, inches, then all other numbers."""
    fraction, inch = r"(?U)\b\d+/\d+in\b", r"(?U)\b\d+(?:\.\d+)?in\b"

    def found(t: Column) -> Column:
        rest = F.regexp_replace(t, fraction, " ")
        last = F.regexp_replace(rest, inch, " ")
        return F.concat(F.regexp_extract_all(t, F.lit(fraction), F.lit(0)), F.regexp_extract_all(rest, F.lit(inch), F.lit(0)), F.regexp_extract_all(last, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0)))

    # an array of one, so that the text is normalised once
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(normalize_text(c)), found))))


def extract_variant(c: Column) -> Column:
    """The first variant in order of rank that is among the text's words, or null."""
    # one test for all, so that the text is normalised once
    return F.get(F.array_intersect(F.array(*map(F.lit, VARIANTS)), F.split(normalize_text(c), " ")), F.lit(0))


def filled(c: Column) -> Column:
    """Whether a text has more than white space; null has not."""
    return F.coalesce(c.cast("string").rlike(r"(?U)\S"), F.lit(False))


def text_tests(raw: Column) -> dict[str, Column]:
    """The noise tags that a line's text alone decides, with their tests."""
    low = F.lower(raw)
    return {
        "short_text": F.size(F.regexp_extract_all(raw, F.lit(r"(?U)\w+"), F.lit(0))) <= 3,
        "conversational_noise": low.rlike(rf"(?U)\b(?:{CHATTER})\b"),
        "separator_noise": raw.rlike(r"[/_|]"),
        "spacing_noise": raw.rlike(r"(?U)\s{2,}"),
        "numeric_attributes": raw.rlike(r"(?U)\d"),
        "measurement_text": raw.rlike(r"(?U)\d+\s*[\"']") | low.rlike(r"(?U)\d+\s*(?:mm|kg|g|l)\b"),
    }


def field_tests(buyer_sku: Column, barcode: Column, price: Column, uom: Column) -> dict[str, Column]:
    """The noise tags of a line's other fields, with their tests."""
    return {"has_buyer_sku": filled(buyer_sku), "has_barcode": filled(barcode), "has_price": filled(price), "has_uom": filled(uom)}


def met(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def tag_array(found: Column) -> Column:
    return F.when(F.size(found) == 0, F.array(F.lit("plain_text"))).otherwise(F.array_sort(found))


def noise_tags(raw: Column, buyer_sku: Column, barcode: Column, price: Column, uom: Column) -> Column:
    """What makes a line hard to read, as a sorted array; ``plain_text`` if nothing does."""
    return tag_array(met(text_tests(raw) | field_tests(buyer_sku, barcode, price, uom)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def is_bulk(c: Column) -> Column:
    return normalize_text(c).rlike(r"(?U)\bbulk\b")


def without_bulk(c: Column) -> Column:
    return strip(F.regexp_replace(normalize_text(c), BULK, " "))


def word_set(c: Column) -> Column:
    """Words of more than one letter, as label hygiene counts them."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) > 1))
