"""Splitting text into sentences: abbreviations and brackets are masked, then breaks are found by rules without training."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations before which a period does not end a sentence.
OWN = "u.s u.s.a n.w p.o po st ave blvd ctr cir ct dr mtn apt hwy esq fig no sec n.a s.a.b non-u.s cap u.s.c ste".split()
COMMON = "mr mrs ms prof gen rep sen gov capt lt col sgt rev hon jr sr vs etc e.g i.e al co corp ltd dept univ assn bros jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun vol pp ed eds a.m p.m d.c".split()

_ABBREVIATION = re.compile(r"(?:^|(?<=\s))(" + "|".join(sorted(map(re.escape, {*OWN, *COMMON}), key=len, reverse=True)) + r").(?=\s)", re.I)
_INC = re.compile(r"(inc)\.", re.I)
_BRACKETS = re.compile(r"\(([^)]+)\)")
_LEADING = re.compile(r"^(?:[.,?!]\s+)+")
_SPACED = re.compile(r"\s([.'](?:\s|$|\D))")
_QUOTES = re.compile(r"[”“\"‘’']")
#: A word with a mark in it, tried at the begin of words only; the next word's first character.
_MARKED = re.compile(r"(?<!\S)[^\s.?!]*+[.?!]\S*")
_NEXT = re.compile(r"\s+(\S)")
#: What may follow a mark at once.
_FOLLOWERS = frozenset("?!)\";}]*:@'({[")
_CLOSERS = re.compile(r"[\"')\]}]+(?=\s|$)")
_INITIAL = re.compile(r"(?:^|[^\w])[^\W\d]$")
_NUMBER = re.compile(r"^-?[.,]?\d[\d,.-]*$")


def _masked(line: str) -> str:
    """The line with periods that end nothing replaced; of the same length."""
    closed = line.rfind(")") + 1  # behind the last bracket none closes
    line = _BRACKETS.sub(lambda m: "_" + m[1].replace(".", "_") + "_", line[:closed]) + line[closed:]
    line = _ABBREVIATION.sub(lambda m: m[1].replace(".", "_") + "_", line)
    return _QUOTES.sub('"', _INC.sub(r"\1_", line))


def _ends(before: str, mark: str, follower: str) -> bool:
    """Whether a sentence ends after a token and its mark, before a following character."""
    if mark != ".":
        return True
    if before.endswith("."):  # an ellipsis
        return False
    if _INITIAL.search(before):
        return not follower.isalpha()
    return not (_NUMBER.match(before) and follower.islower())


def _mark(word: str, last: bool) -> int:
    """The place of a word's last mark that something may follow: at once, or (last: not for the line's last word) behind white space; -1 for none."""
    at = len(word)
    while (at := max(word.rfind(c, 0, at) for c in ".?!")) >= 0:
        if word[at + 1] in _FOLLOWERS if at + 1 < len(word) else not last:
            return at
    return -1


def spans(line: str) -> list[tuple[int, int]]:
    """(begin, end) of each sentence in a masked line; closing quotes and brackets stay with the sentence before them."""
    found, begin = [], 0
    for m in _MARKED.finditer(line):
        word, after = m[0], _NEXT.match(line, m.end())
        at = _mark(word, after is None)
        if at < 0 or m.start() + at < begin:
            continue
        behind = at + 1 == len(word)
        if not _ends(word[:at], word[at], after[1] if behind else ""):
            continue
        end = m.start() + at + 1
        if not behind:
            closing = _CLOSERS.match(line, end)
            if not closing:
                continue
            end = closing.end()
        found.append((begin, end))
        begin = after.start(1) if after and end == m.end() else end
    if line[begin:].strip():
        found.append((begin, len(line.rstrip())))
    return found


def split_sentences(text: str | None) -> list[str]:
    """The sentences of a text, newline by newline; an empty text has none."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        line = _SPACED.sub(r"\1", line)
        bare = _LEADING.sub("", line)
        off = len(line) - len(bare)
        out += [line[off + a : off + b] for a, b in spans(_masked(bare))]
    if len(out) > 1 and len(out[0]) == 2 and out[0][1] == ".":
        out[:2] = [out[0] + " " + out[1]]
    return [s.strip(" ") for s in out if s.strip()]


def sentences(text: Column) -> Column:
    """An array of sentences; Arrow batches, since the rules look back and ahead."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_sentences)

    return split(text)
