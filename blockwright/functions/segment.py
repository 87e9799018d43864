"""Words out of running letters: the split of lowest cost by word frequency, and the nearest dictionary word."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Splitter:
    """Costs of words by their rank in a list, most frequent first: log((rank + 1) * log(size))."""

    def __init__(self, words: list[str]):
        self.costs = {w: math.log((k + 1) * math.log(max(len(words), 3))) for k, w in enumerate(words)}
        self.longest = max(map(len, words), default=1)

    def split(self, text: str) -> list[str]:
        low, best, back = text.lower(), [0.0], [0]
        for end in range(1, len(low) + 1):
            choices = []
            for begin in range(max(0, end - self.longest), end):
                piece = low[begin:end]
                cost = self.costs.get(piece, 0.0 if piece.isdigit() else 1.0 if not piece.isalnum() and len(piece) == 1 else 25.0 * len(piece))
                choices.append((best[begin] + cost, begin))
            cost, begin = min(choices)
            best.append(cost)
            back.append(begin)
        out, end = [], len(low)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        out.reverse()
        glued: list[str] = []
        for piece in out:  # digits stay together, an apostrophe joins what it stands between
            if glued and (glued[-1].isdigit() and piece.isdigit() or piece in ("'", "’") or glued[-1][-1] in "'’" or piece in ("%", ")", ",", ".") or glued[-1] in ("$", "(")):
                glued[-1] += piece
            else:
                glued.append(piece)
        return glued


def fix_spaced_characters(text: Column, words: list[str]) -> Column:
    """Text written letter by letter, as words; capitals become Title Case. words: a list by frequency, sent along."""
    splitter = Splitter(words)

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        def one(said: str | None) -> str:
            said = re.sub(r"\s+", "", said or "")
            joined = " ".join(splitter.split(said))
            return " ".join(w.capitalize() for w in joined.split(" ")) if said.isupper() or not said.islower() else joined

        return texts.map(one)

    return fix(text)


def nearest_words(words: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """Each word with its nearest dictionary word (word, frequency) at most distance edits away, the most frequent of equals; itself if it has none.

    Words meet by their deletes: two words within d edits share a form with at most d characters deleted, so the join
    is an equi-join on those forms.
    """

    def forms(c: Column) -> Column:
        out = F.array(c)
        for _ in range(distance):
            longer = F.filter(out, lambda w: F.length(w) > 0)
            shorter = F.flatten(F.transform(longer, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))))
            out = F.array_distinct(F.concat(out, shorter))
        return out

    known = dictionary.select(F.col("word").alias("near"), "frequency", F.explode(forms(F.col("word"))).alias("form"))
    asked = words.select("word").distinct()
    met = asked.select("word", F.explode(forms(F.col("word"))).alias("form")).join(known, "form").select("word", "near", "frequency").distinct()
    scored = met.withColumn("d", F.levenshtein("word", "near")).filter(F.col("d") <= distance)
    best = scored.groupBy("word").agg(F.min_by("near", F.struct("d", -F.col("frequency"), "near")).alias("near"), F.min("d").alias("distance"))
    return asked.join(best, "word", "left").select("word", F.coalesce("near", "word").alias("corrected"), "distance")


def corrected_texts(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", distance: int = 2) -> DataFrame:
    """key and text with each word as its nearest dictionary word, in the case that it had; numbers, signs and words with either stay."""
    place = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("at", "said"))
    place = place.withColumn("word", F.when(F.col("said").rlike(r"^\p{L}+$"), F.lower("said")))
    known = nearest_words(place.filter("word is not null"), dictionary, distance).select("word", "corrected")
    said, fixed = F.col("said"), F.col("corrected")
    cased = F.when(fixed.isNull(), said).when(said.rlike(r"^\p{Lu}{2,}$"), F.upper(fixed)).when(said.rlike(r"^\p{Lu}"), F.initcap(fixed)).otherwise(fixed)
    made = place.join(known, "word", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", cased.alias("w")))).alias("x"))
    return made.select(key, F.array_join(F.transform("x", lambda p: p["w"]), " ").alias("text"))
