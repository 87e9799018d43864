"""Lines of documents: splitting, cleaning, and the first of lines that differ in digits only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import strip


def clean_line(line: Column) -> Column:
    return strip(F.translate(line, "\n\t", "  "))


def split_lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, line_no and line of every line of every text; narrow, no shuffle."""
    return docs.select(*keys, F.posexplode_outer(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "raw")).select(*keys, "line_no", clean_line(F.col("raw")).alias("line"))


def kept_lines(lines: DataFrame, keys: Sequence[str] = ("doc_id",), xml: bool = False) -> DataFrame:
    """Lines longer than two characters (in XML: not empty), each the first of its document with its text but for digits."""
    long = lines.filter(F.length("line") > (0 if xml else 2)).withColumn("__bare", F.regexp_replace("line", r"\p{Nd}+", ""))
    first = Window.partitionBy(*keys, "__bare").orderBy("line_no")
    return long.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__bare")


def exploded(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", xml: bool = False) -> DataFrame:
    """keys, line_no (among the lines that stay) and line.

    The outer form, since Spark puts a filter on the array's size below the plain one, and so makes the array twice.
    """
    return kept_in_order(docs, keys, text, xml).select(*keys, F.posexplode_outer("lines").alias("line_no", "line")).filter("line is not null")


def kept_in_order(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", xml: bool = False) -> DataFrame:
    """The same lines straight from the texts, without a shuffle: an array for each document, reduced and then exploded.

    line_no counts the lines that stay.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), clean_line), lambda x: F.length(x) > (0 if xml else 2))
    tagged = F.transform("__lines", lambda x, i: F.struct(F.regexp_replace(x, r"\p{Nd}+", "").alias("bare"), i.alias("i"), x.alias("line")))
    firsts = F.filter("__sorted", lambda p, j: (j == 0) | (F.get("__sorted", j - 1)["bare"] != p["bare"]))
    out = docs.select(*keys, lines.alias("__lines")).select(*keys, F.array_sort(tagged).alias("__sorted"))
    return out.select(*keys, F.transform(F.array_sort(F.transform(firsts, lambda p: F.struct(p["i"].alias("i"), p["line"].alias("line")))), lambda p: p["line"]).alias("lines"))
