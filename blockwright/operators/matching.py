"""Join-shaped operators: similarity to an ignore list, dictionary phrases in texts, word coverage, expected against found."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon

#: A side is broadcast only if its bytes, as summed up before, stay below the limit.
BROADCAST_BYTES = 32 << 20
#: Openings of phrases (their first two tokens) up to which words of a text are looked up in a set of them first.
OPENINGS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def check_duplicates(vectors: DataFrame, settings: DataFrame, threshold: float = 0.9, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per vector (vec_id, level, embedding): its most similar setting of its level (setting_id, level, embedding, ignore_all_after), and whether the score is above the threshold.

    Settings whose counted numbers fit into most_bytes are broadcast as one array a level, so a vector stays one row.
    More of them are joined by level row by row and reduced by partial maxima, in blocks of settings so that no level's
    list is in one task. A vector without a setting of its level has none.
    """
    size = settings.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 32), F.lit(0))).first()[0]
    score = lambda s: F.struct(dot(s["embedding"], F.col("embedding")).alias("score"), (-s["setting_id"]).alias("minus"), s["ignore_all_after"].alias("after"))
    one = F.struct("setting_id", "embedding", "ignore_all_after")
    if size <= most_bytes:
        lists = settings.groupBy("level").agg(F.sort_array(F.collect_list(one)).alias("settings"))
        scored = vectors.join(F.broadcast(lists), "level", "left").select("vec_id", "level", F.array_max(F.transform("settings", score)).alias("best"))
    else:
        blocks = min(64, -(-size // max(most_bytes, 1)))  # each vector goes to all of them
        spread = settings.select("level", F.pmod(F.hash("setting_id"), F.lit(blocks)).alias("__block"), one.alias("s"))
        asked = vectors.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = asked.join(spread, ["level", "__block"]).select("vec_id", "level", score(F.col("s")).alias("x"))
        scored = vectors.select("vec_id", "level").join(met.groupBy("vec_id", "level").agg(F.max("x").alias("best")), ["vec_id", "level"], "left")
    best = F.col("best")  # the highest score, then the smallest id
    hit = F.coalesce(best["score"] > threshold, F.lit(False))
    return scored.select("vec_id", "level", (-best["minus"]).alias("setting_id"), best["score"].alias("score"), hit.alias("is_duplicated"), F.coalesce(hit & best["after"], F.lit(False)).alias("ignore_all_after"))


def by_document(report: DataFrame) -> DataFrame:
    """is_duplicated and ignore_all_after of a vec_id with vectors on several levels: true if so on any."""
    return report.groupBy("vec_id").agg(F.max("is_duplicated").alias("is_duplicated"), F.max("ignore_all_after").alias("ignore_all_after"))


@cache
def _accents() -> tuple[str, str]:
    """Letters of all scripts that Unicode makes of a letter and marks, and the letters without them."""
    letters, bare = [], []
    for point in range(0xC0, 0x2000):
        c = chr(point)
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.category(apart[0])[0] == "L" and all(unicodedata.combining(m) for m in apart[1:]):
            letters.append(c)
            bare.append(apart[0])
    return "".join(letters), "".join(bare)


def write_dictionary(phrases: DataFrame, path: str) -> None:
    """A dictionary's phrases (phrase_id, phrase) as lines of JSON."""
    phrases.select("phrase_id", "phrase").write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("phrase_id long, phrase string").json(path)


def phrase_token(t: Column) -> Column:
    """A token as the dictionary knows it: accents off; plain Title-case words in lower case, others as they are."""
    plain = F.regexp_replace(F.translate(t, *_accents()), "ß", "ss")
    return F.when(plain.rlike("[^0-9a-zA-Z]") | (plain.rlike("[0-9]") & plain.rlike("[a-zA-Z]")), plain).when(plain.rlike("^[A-Z][a-z]*$"), F.lower(plain)).otherwise(plain)


def content_tokens(text: Column) -> Column:
    """Words of a text, stop words left out (a first capital doesn't save one)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.filter(words, lambda w: ~F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)).isin(*lexicon.STOP_WORDS))


def dictionary(phrases: DataFrame) -> DataFrame:
    """phrase, tokens and the set of its metas (phrase_id); single tokens need two letters or digits."""
    tokens = F.transform(F.filter(F.split(F.trim("phrase"), r"\s+"), lambda w: w != ""), phrase_token)
    out = phrases.select("phrase_id", tokens.alias("tokens")).filter((F.size("tokens") > 1) | (F.length(F.regexp_replace(F.element_at("tokens", 1), "[^0-9a-zA-Z]", "")) > 1))
    return out.groupBy("tokens").agg(F.sort_array(F.collect_set("phrase_id")).alias("meta"))


def dictionary_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, start, result and meta of each phrase in a text: the longest from the left that doesn't overlap the one before.

    A text's words meet the dictionary by a phrase's first token; each carries as many words as the longest phrase has,
    so the rest is compared on the spot and no row holds a whole text. Of a dictionary with few openings, only words that
    begin with one of them get so far.
    """
    words = dictionary(phrases).select(F.element_at("tokens", 1).alias("head"), "tokens", "meta")
    longest_phrase, size = words.agg(F.coalesce(F.max(F.size("tokens")), F.lit(1)), F.coalesce(F.sum(F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 16) + F.size("meta") * 8 + 64), F.lit(0))).first()
    lists = words.groupBy("head").agg(F.collect_list(F.struct(F.size("tokens").alias("n"), "tokens", "meta")).alias("known"))
    texts = docs.select("doc_id", content_tokens(F.col("text")).alias("raw")).withColumn("t", F.transform("raw", phrase_token))
    opening = lambda x, i: F.concat_ws(" ", x, F.get("t", i + 1))
    openings = [r[0] for r in words.select(F.concat_ws(" ", F.slice("tokens", 1, 2))).distinct().limit(OPENINGS + 1).collect()]
    begins = F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    if len(openings) <= OPENINGS:
        begins = F.filter(begins, lambda p: p["x"].isin(openings) | opening(p["x"], p["i"]).isin(openings))
    ahead = F.transform(begins, lambda p: (lambda x, i: F.struct(i.alias("start"), x.alias("head"), F.slice("t", i + 1, F.lit(longest_phrase)).alias("t"), F.slice("raw", i + 1, F.lit(longest_phrase)).alias("raw")))(p["x"], p["i"]))
    places = texts.select("doc_id", F.explode(ahead).alias("p")).select("doc_id", "p.*").join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "head")
    fits = F.filter("known", lambda k: F.slice("t", F.lit(1), k["n"]) == k["tokens"])
    longest = places.withColumn("k", F.array_max(F.transform(fits, lambda k: F.struct(k["n"].alias("n"), k["tokens"].alias("tokens"), k["meta"].alias("meta"))))).filter(F.col("k").isNotNull())
    hit = longest.select("doc_id", "start", F.col("k.n").alias("n"), F.array_join(F.slice("raw", F.lit(1), F.col("k.n")), " ").alias("result"), F.col("k.meta").alias("meta"))
    hits = hit.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n", "result", "meta"))).alias("hits"))
    begin = F.struct(F.lit(0).alias("free"), F.slice("hits", 1, 0).alias("out"))
    greedy = F.aggregate("hits", begin, lambda s, h: F.when(h["start"] >= s["free"], F.struct((h["start"] + h["n"]).alias("free"), F.concat(s["out"], F.array(h)).alias("out"))).otherwise(s), lambda s: s["out"])
    return hits.select("doc_id", F.explode(greedy).alias("h")).select("doc_id", F.col("h.start").alias("start"), F.col("h.result").alias("result"), F.col("h.meta").alias("meta"))


def word_coverage(pairs: DataFrame) -> DataFrame:
    """Of rows with baseline and found texts: distinct lower-case words, those in both, their share, and the missing ones."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    out = pairs.withColumn("__b", words(F.col("baseline"))).withColumn("__f", words(F.col("found")))
    both = F.size(F.array_intersect("__b", "__f"))
    return out.withColumns(
        {
            "total_baseline_words": F.size("__b"),
            "total_found_words": F.size("__f"),
            "words_found": both,
            "coverage": F.when(F.size("__b") > 0, both / F.size("__b")).otherwise(0.0),
            "missing_words": F.sort_array(F.array_except("__b", "__f")),
        }
    ).drop("__b", "__f", "baseline", "found")


def compare_results(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per expected table (key, table): correct, incorrect or missed, by the actual table of the same key."""
    got = actual.select("key", F.col("table").alias("__got"))
    verdict = F.when(F.col("__got").isNull(), "missed").when(F.col("__got") == F.col("table"), "correct").otherwise("incorrect")
    return expected.join(got, "key", "left").select("key", verdict.alias("verdict"))


def first_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
