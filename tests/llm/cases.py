"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, node string, row string"


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghilmnorst", k=rng.randint(1, 9))) for _ in range(400)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55 or not texts:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 30, 90, 300]))))
        elif kind < 0.7:
            texts.append(rng.choice(texts))
        else:
            copy = rng.choice(texts).split(" ")
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n", "A  b\tc", "a b c", "A b c", "word " * 3000, "é ü 😀 ß " * 50, "<|endoftext|> hi"]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None, "x", 0.5, "n", "r") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, "x", None, None, None), rows[5], rows[5], (None, "no id", None, None, None, "x", None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
