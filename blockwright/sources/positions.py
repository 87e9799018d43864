"""Positioned lines from extracted pages: style attributes, leader dots, scanned words (hOCR)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pixels, style_map

# Named weights, words in family names that set one, and the scale of font sizes.
WEIGHTS = {"normal": 400, "bold": 600, "bolder": 900, "lighter": 200}
FAMILIES = {"bold": 600, "light": 200}
SCALE = 1.2
LEADERS = r"[._�]{2,}"


def numeric_weight(family: Column, weight: Column) -> Column:
    """A weight as a number: named or given, unless the family's name says bold or light."""
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), weight), F.round(weight.try_cast("double")).cast("int"))
    low = F.lower(family)
    return F.when(low.endswith(".b"), WEIGHTS["bold"]).when(low.contains("light"), FAMILIES["light"]).when(low.contains("bold"), FAMILIES["bold"]).otherwise(named)


def tuples(text: Column) -> Column:
    """[(a, b), (c, d)] as an array of arrays of strings."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda t: F.transform(F.split(t, ","), lambda x: F.trim(x)))


def _number(c: Column) -> Column:
    return F.round(c.try_cast("double"), 2)


def parse_style(lines: DataFrame, style: str = "style", text: str = "text") -> DataFrame:
    """Lines with top, left, width, height, font_family, font_style, font_size, font_weight, space_width and word_styles, from a css-like attribute.

    Words give the left and right edge. Where the right edge lies before the left one on the same line, it is set by
    the last word's length, or by the whole text's if that word starts before the line does.
    """
    out = lines.withColumn("__s", style_map(F.col(style)))
    out = out.withColumns({"__b": tuples(F.col("__s")["word-start-positions"]), "__e": tuples(F.col("__s")["word-end-positions"]), "__f": tuples(F.col("__s")["word-fonts"])})
    x = lambda at, name: _number(F.try_element_at(F.try_element_at(name, F.lit(at)), F.lit(1)))
    left, right, last = x(1, "__b"), x(-1, "__e"), x(-1, "__b")
    space = lambda at: _number(F.try_element_at(F.try_element_at("__f", F.lit(at)), F.lit(6)))
    ys = F.transform("__e", lambda e: F.try_element_at(e, F.lit(2)).try_cast("double"))
    level = F.coalesce(F.array_max(ys) - F.array_min(ys) <= 2, F.lit(True))
    word = F.length(F.element_at(F.split(F.trim(F.col(text)), r"\s+"), -1))
    fixed = F.when((right < left) & level & (last >= right) & (last >= left), last + word * space(-1)).when((right < left) & level, left + F.length(text) * space(1)).otherwise(right)
    s = F.col("__s")
    styles = F.transform(
        "__f",
        lambda f: F.struct(
            F.get(f, F.lit(0)).alias("font_family"), F.get(f, F.lit(2)).alias("font_style"), F.round(F.get(f, F.lit(3)).try_cast("double") * SCALE, 1).alias("font_size"), numeric_weight(F.get(f, F.lit(0)), F.get(f, F.lit(1))).alias("font_weight"), _number(F.get(f, F.lit(5))).alias("space_width")
        ),
    )
    height = pixels(s["font-size"])
    return out.withColumns(
        {
            "top": pixels(s["top"]),
            "left": left,
            "width": fixed - left,
            "height": height,
            "font_family": s["font-family"],
            "font_style": s["font-style"],
            "font_size": F.round(height * SCALE, 1),
            "font_weight": numeric_weight(s["font-family"], s["font-weight"]),
            "space_width": space(1),
            "word_styles": styles,
        }
    ).drop("__s", "__b", "__e", "__f")


def without_leaders(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines without leader dots and underscores, with changed; a line with leaders between words becomes one row a part.

    A part gets the share of the line's box that its characters have.
    """
    pieces = F.filter(F.transform(F.split(F.col(text), LEADERS), lambda x: F.trim(x)), lambda p: p != "")
    found = lines.withColumn("changed", F.col(text).rlike(LEADERS)).withColumn("__t", F.col(text))
    rows = found.withColumn("__p", F.when(F.col("changed"), pieces).otherwise(F.array(text)))
    rows = rows.select(*[c for c in rows.columns if c != "__p"], F.posexplode("__p").alias("part", "__part"))
    share = F.greatest(F.length("__t"), F.lit(1))
    begin = F.when(F.col("changed"), F.expr("locate(__part, __t)") - 1).otherwise(0)
    out = rows.withColumn(text, F.col("__part"))
    if "left" in lines.columns and "width" in lines.columns:
        out = out.withColumn("__w", F.col("width") / share).withColumn("left", F.col("left") + F.col("__w") * begin).withColumn("width", F.when(F.col("changed"), F.col("__w") * F.length("__part")).otherwise(F.col("width"))).drop("__w")
    return out.drop("__t", "__part")


def hocr_lines(words: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx"), scale: float = 1.0) -> DataFrame:
    """Lines of scanned words (keys, line_no, word_no, text, title "bbox x0 y0 x1 y1"): text, box and size 12, in page units."""
    box = F.transform(F.split(F.regexp_extract("title", r"bbox ([\d. ]+)", 1), " "), lambda v: v.try_cast("double") * scale)
    out = words.withColumn("__b", box)
    x0, y0, x1, y1 = (F.get("__b", F.lit(i)) for i in range(4))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    rows = out.groupBy(*keys, "line_no").agg(said.alias("text"), F.min(x0).alias("left"), F.min(y0).alias("top"), F.max(x1).alias("__r"), F.max(y1).alias("__d"))
    return rows.select(*keys, "line_no", "text", "top", "left", (F.col("__r") - F.col("left")).alias("width"), (F.col("__d") - F.col("top")).alias("height"), F.lit(12.0).alias("font_size"))


def sparse_pages(lines: DataFrame, keys: Sequence[str] = ("doc_id",), few: int = 4, share: float = 0.3) -> DataFrame:
    """keys and needs_ocr: more than the share of a document's pages have fewer lines than few."""
    pages = lines.groupBy(*keys, "page_idx").agg(F.count("*").alias("n"))
    return pages.groupBy(*keys).agg((F.count_if(F.col("n") < few) / F.count("*") > share).alias("needs_ocr"))


def page_slice(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Pages from first to last, both included."""
    return lines.filter(F.col("page_idx").between(first, last))
