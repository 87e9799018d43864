"""Scalar rules: header names from tags, ordinals of list markers, tokens without numbers, cell types, geometry."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_case_split(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[A-Z](?:[a-z]+|[A-Z]*(?=[A-Z]|$))"), F.lit(0))


def make_header(name: Column) -> Column:
    """A readable header of a tag or column name: snake_case and CamelCase to Title Case, one lower-case word capitalised."""
    return (
        F.when(name.contains("_"), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))
        .when(name.rlike(r"\p{Ll}") & ~name.rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))
        .otherwise(F.initcap(F.array_join(camel_case_split(name), " ")))
    )


def roman_to_decimal(text: Column) -> Column:
    """The value of a roman numeral, 0 if it isn't one."""
    value = F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv))
    up = F.upper(text)
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.length(up), F.lit(1))), lambda i: F.coalesce(value[up.substr(i, F.lit(1))], F.lit(0)))
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.when(up.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, d: a + d)).otherwise(0)


def marker_ordinal(marker: Column) -> Column:
    """The ordinal of a list marker: a roman numeral's value, an integer of its digits (parts of two digits, joined), else the sum of its code points."""
    bare = F.regexp_replace(marker, r"[().]+$|^[(]+", "")
    parts = F.split(bare, r"\.")
    joined = F.array_join(F.transform(parts, lambda p: F.lpad(p, 2, "0")), "").try_cast("long")
    points = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1))), lambda i: F.ascii(bare.substr(i, F.lit(1)))), F.lit(0), lambda a, b: a + b)
    return F.when(bare.rlike("^[ivxIVX]+$"), roman_to_decimal(bare).cast("long")).when(bare.rlike(r"^[0-9.]+$"), joined).otherwise(points.cast("long"))


def stem(text: Column) -> Column:
    return F.regexp_replace(text, "['’]s", "")


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation, numbers with units, numbers, shares and amounts; ['unknown'] if none is left."""
    # Characters that count as spaces and those that go, and numbers with units.
    low = F.translate(F.translate(F.lower(F.coalesce(text, F.lit(""))), "-/", "  "), "�\\(*,.?•➢ƒ–)'\"—", "")
    words = F.split(stem(F.regexp_replace(low, "[0-9]+[a-zA-Z’]+", "")), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$") & ~w.endswith("%") & ~w.startswith("$") & ~w.endswith("$"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown")))


def number_type(text: Column) -> Column:
    return F.when(text.rlike(r"^[(]*\$\d[\d.,)]*$|^[(]*\d[\d.,)]*\$$"), "dollar").when(text.rlike(r"^[(]*%\d[\d.,)]*$|^[(]*\d[\d.,)]*%$"), "percent").otherwise("num")


def floating_characters(line: Column) -> Column:
    """True if no word is longer than two characters."""
    return ~F.exists(F.split(line, " "), lambda w: F.length(w) > 2)


def incomplete_sentence(text: Column) -> Column:
    return text.rlike(r"(?i)(?:^|\s)(?:and|or|the|of|to|in|for|with|by|a|an)\s*$|[,/-]\s*$")


def spaced_numbers(text: Column) -> Column:
    """At least three numbers one after the other."""
    return text.rlike(r"(?:^|\s)[$(]?\d[\d.,]*[%)]?(?:\s+[$(]?\d[\d.,]*[%)]?){2}(?:\s|$)")


def fix_spaced_letters(text: Column) -> Column:
    return F.when(text.rlike(r"(?:^|\s)\p{L} \p{L} \p{L}(?:\s|$)"), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column, shorter: bool = True) -> Column:
    """The overlap of two intervals over the shorter (or longer) one's length."""
    length = (F.least if shorter else F.greatest)(a1 - a0, b1 - b0) + F.lit(1e-5)
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / length


def discrete_overlap(a0: Column, a1: Column, b0: Column, b1: Column, shorter: bool = True) -> Column:
    """The share of whole numbers in both ranges (ends excluded)."""
    both = F.greatest(F.lit(0), F.least(a1.cast("int"), b1.cast("int")) - F.greatest(a0.cast("int"), b0.cast("int")))
    length = (F.least if shorter else F.greatest)(a1.cast("int") - a0.cast("int"), b1.cast("int") - b0.cast("int"))
    return F.when(length > 0, both / length).otherwise(0.0)


def centered(left: Column, width: Column, page_width: Column | float, tolerance: float = 0.01) -> Column:
    page = F.lit(page_width) if isinstance(page_width, int | float) else page_width
    return (F.abs(left + width / 2 - page / 2) < page * tolerance) & (width * 2 < page)


def style_map(style: Column) -> Column:
    """A css string as a map; parts without a colon are dropped, values may hold more colons."""
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p.contains(":"))
    key = F.transform(parts, lambda p: F.trim(F.substring_index(p, ":", 1)))
    return F.map_from_arrays(F.array_distinct(key), F.transform(F.array_distinct(key), lambda k: F.trim(F.regexp_replace(F.element_at(parts, F.array_position(key, k).cast("int")), "^[^:]*:", ""))))


def pixels(value: Column) -> Column:
    return F.round(F.regexp_extract(value, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double"), 2)


def font_weight(family: Column, weight: Column) -> Column:
    """A numeric weight: as given, else by the words in the family's or the weight's name."""
    name = F.lower(F.concat_ws(" ", family, weight))
    return F.coalesce(weight.try_cast("double"), F.when(name.rlike("bold|black|heavy"), 600.0).when(name.rlike("light|thin"), 200.0).otherwise(400.0))


def spaced_letters(line: Column) -> Column:
    """Whether more than four in five of a line's words are single characters."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.greatest(F.size(words), F.lit(1)) > 0.8).otherwise(False)


def word_boundary(character: Column) -> Column:
    """Whether a character ends a word: no letter, digit, hyphen or underscore."""
    return ~character.rlike(r"^[\p{L}\p{N}_-]")


def trailing_number(text: Column) -> Column:
    """The amount or number that a text ends with; null without one."""
    found = F.regexp_extract(text, r"\$?(\d*(\d\.?|\.\d{1,2}))$", 0)
    return F.when(found != "", found)


def replaced(text: Column, parts: list[str], by: str = "") -> Column:
    """A text with every one of the parts replaced, one after the other."""
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(by))
    return text


def short_words(words: Column) -> Column:
    """Whether an array's words, without white space, have less than three characters on average; false for none."""
    lengths = F.transform(words, lambda w: F.length(F.regexp_replace(w, r"(?U)\s+", "")))
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    return F.when(F.size(words) > 0, F.floor(total / F.greatest(F.size(words), F.lit(1))) <= 2).otherwise(False)


def same_words(a: Column, b: Column, share: float = 0.8) -> Column:
    """Whether two arrays have at least the share of the longer one's words in common, as often as both have them; letters and digits only.

    Counted in an Arrow pass, linear in the words.
    """

    def counted(words: list[str] | None) -> Counter:
        return Counter(w for w in (re.sub("[^a-zA-Z0-9]", "", x or "") for x in words or ()) if w)

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            c, d = counted(x), counted(y)
            n, m = c.total(), d.total()
            out.append((c & d).total() / max(n, m) >= share if n and m else n == m)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b)


def spaced_capitals(text: Column) -> Column:
    """A space between a letter that isn't a capital and a capital behind it."""
    return F.regexp_replace(text, r"(?<=[\p{L}&&[^\p{Lu}]])(?=\p{Lu})", " ")


def index_prefixes(index: Column) -> Column:
    """The prefixes of a multi-level index, the shortest first."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(index), F.lit(1))), lambda n: F.slice(index, F.lit(1), n))


def chunk_of(place: Column, size: int) -> Column:
    """The number of the chunk of so many rows that a place (from 0) falls into."""
    return F.floor(place / size)
