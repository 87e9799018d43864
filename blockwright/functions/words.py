"""What the words of a line are and how many of each kind: one pass over Arrow batches.

A line has few kinds of words but many words, and a text repeats them. Judging a word takes a dozen patterns, so each
distinct one is judged once in a worker and remembered (REMEMBERED at most); a line is then a loop of additions. The
same judgements as nested array functions took 80 microseconds a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .strings import NUMERIC, TITLE, UPPER

#: Words that a worker remembers; beyond, it begins anew.
REMEMBERED = 200_000

_MONTHS31 = "jan(?:uary)?|mar(?:ch)?|may|july?|aug(?:ust)?|oct(?:ober)?|dec(?:ember)?|1[02]|0?[13578]"
_MONTHS30 = "apr(?:il)?|june?|sep(?:tember)?|nov(?:ember)?|11|0?[469]"
_FEBRUARY = "feb(?:ruary)?|0?2"
_YEAR = r"(?:-(?:\d\d|(?!0000)\d{4}))"
_LEAP = r"-(?:(?:[02468][048]|[13579][26])|(?!0000)(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00))"
_DAY = r"0?[1-9]|1\d|2[0-8]"
#: Month and day, with or without a year, as far as there is such a day (29 February only in leap years).
DATE = rf"(?i)^(?:(?:(?:{_MONTHS31})-(?:{_DAY}|29|30|31)|(?:{_MONTHS30})-(?:{_DAY}|29|30)|(?:{_FEBRUARY})-(?:{_DAY})){_YEAR}?|(?:{_FEBRUARY})-29{_LEAP})$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
VALUE = r"^(?=.*\p{N})\p{N}*\.?\p{N}*$"
RANGE = r"^\p{N}+-\p{N}+$"

_date = re.compile(DATE, re.A)
_value, _range, _numeric, _title, _upper = (regex.compile(p) for p in (VALUE, RANGE, NUMERIC, TITLE, UPPER))
_capital, _word_start = regex.compile(r"\p{Lu}"), regex.compile(r"[\p{L}\p{N}]")
_brackets, _roman, _letters = re.compile(r"^\((.*)\)$"), re.compile("^[ixvIXV]+$"), re.compile("[a-zA-Z]+")
#: White space of Unicode, without the separators of ASCII.
_space = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_stop, _state = frozenset(lexicon.STOP_WORDS), frozenset([*lexicon.STATES, *lexicon.STATE_CODES])


class Word(NamedTuple):
    """A token as judged: its text without a mark behind it and what it is."""

    text: str
    title: int
    alpha: int
    number: int
    dollar: int
    percent: int
    date: int
    stop: int
    single: int
    ranged: bool
    state: bool
    page: bool
    shouted_or_single: bool


def judged(raw: str, first: bool) -> Word:
    """A token; the first of a line loses a mark at its end only if that is a colon."""
    t = raw
    if (raw[-1] in PUNCTUATION or raw[-1] == "”") and raw[0] not in PUNCTUATION and raw[0] != "“" and (not first or raw[-1] == ":"):
        t = raw[:-1]
    low, alpha = t.lower(), t.isalpha()
    numeral = not alpha and bool(_numeric.match(low))
    dollar = percent = False
    v = "" if alpha else low
    if not alpha and not numeral:
        v = re.sub("^-", "", _brackets.sub(r"\1", low))
        dollar = v[:1] == "$" or v[-1:] == "$"
        percent = not dollar and v[-1:] == "%"
        if v[:1] == "$":
            v = v[1:]
        elif dollar or percent:
            v = v[:-1]
        v = _brackets.sub(r"\1", v).replace(",", "")
    value = numeral or (not alpha and bool(_value.match(v)))
    year = value and "," not in t and v.isascii() and 1000 <= round(float(v)) <= 9999
    dated = not alpha and ("/" in t or "-" in t) and bool(_date.match(t.replace("/", "-")))
    plain = t.isascii() and t == low  # without capitals: neither title nor upper case
    upper = not plain and bool(_upper.match(t))
    title = upper or (not plain and bool(_title.match(t)))
    ranged = not alpha and bool(_range.match(v))
    return Word(t, title, alpha, value and not year, dollar, percent, dated, low in _stop, len(t) == 1, ranged, low in _state, low.startswith("page"), upper or len(t) == 1)


def numbered(token: str) -> tuple[bool, bool, bool, bool, bool, str]:
    """How a line is numbered by its first token: at all, by an integer, roman numeral, letter, dots; and the number itself."""
    closed, bracketed, opened = token[-1:] in (".", ")"), token[-1:] == ")", token[:1] == "("
    cut = token[:-1] if closed and token else token
    cut = (cut[1:] if opened else cut).split(")(")[0]
    if token.lower() in ("i", "a") or (opened and not bracketed) or token[-1:] in ("%", "$", ","):
        return False, False, False, False, False, cut
    parts = cut.split(".")
    many = len(parts) > 1
    integer = roman = letter = dot = mixed = False
    on = True
    for at, part in enumerate(parts):
        digits = part.isdecimal()
        if len(part) <= 2:
            integer, dot = digits and (many or bracketed), digits and (many or token[-1:] == ".")
            rest = _letters.sub("", part)
            letter = bool(part) and part[0].isascii() and part[0].isalpha() and ((closed and len(part) == 1 and not many) or rest.isdecimal() or at > 0)
        if len(part) <= 6:
            roman = at == 0 and bool(_roman.match(part))
        mixed = mixed or (part[-1:] == ")" and "(" in part and bool(_word_start.match(part)))
        on = (integer or roman or letter or dot) and not mixed
        if not on:
            break
    return on, integer, roman, letter, dot, cut


#: The fields of a line's counts, in their order.
COUNTS = ("title", "alpha", "number", "dollar", "percent", "date", "stop", "single", "used", "dollar_signs", "words")
FLAGS = ("last_number", "last_date", "last_stop", "state", "page", "capital", "numbered", "integer", "roman", "letter", "dot")
TEXTS = ("first", "last", "second", "number_text", "head")
_FIELDS = [pa.field(n, pa.int32()) for n in COUNTS] + [pa.field(n, pa.bool_()) for n in FLAGS] + [pa.field(n, pa.string()) for n in TEXTS]
_WORDS = pa.list_(pa.struct([("t", pa.string()), ("number", pa.bool_()), ("range", pa.bool_())]))
_TYPE = "struct<" + ",".join([*(f"{n}:int" for n in COUNTS), *(f"{n}:boolean" for n in FLAGS), *(f"{n}:string" for n in TEXTS)])


def split(line: str) -> list[str]:
    """The words of a line between white space; none in an empty one."""
    if line.isascii() and "\x1c" not in line and "\x1d" not in line and "\x1e" not in line and "\x1f" not in line:
        return line.split()
    return [w for w in _space.split(line) if w]


class Judge:
    """Lines to rows of counts, with the words and first tokens that it remembers."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, bool], Word] = {}
        self.numbers: dict[str, tuple] = {}

    def words(self, tokens: list[str]) -> list[Word]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for i, raw in enumerate(tokens):
            word = known.get((raw, i == 0))
            if word is None:
                word = known[raw, i == 0] = judged(raw, i == 0)
            out.append(word)
        return out

    def number(self, token: str) -> tuple:
        if len(self.numbers) > REMEMBERED:
            self.numbers.clear()
        if (found := self.numbers.get(token)) is None:
            found = self.numbers[token] = numbered(token)
        return found

    def line(self, text: str) -> tuple[tuple, list[Word]]:
        tokens = split(text)
        n = len(tokens)
        every = self.words(tokens)
        colon = next((i for i, t in enumerate(tokens) if ":" in t), n) if ":" in text else n
        title = alpha = number = dollar = percent = date = stop = single = used = 0
        state = page = False
        commas = "," in text
        for i, w in enumerate(every):
            if not w.text:
                continue
            used += 1
            title += w.title
            alpha += w.alpha
            number += w.number
            dollar += w.dollar
            percent += w.percent
            date += w.date
            single += w.single
            if i < colon:
                stop += w.stop
            page = page or w.page
            if commas and i and w.state and tokens[i - 1][-1] == ",":
                state = True
        here = [w for w in every if w.text]
        head, second = here[0].text if here else "", here[1].text if len(here) > 1 else ""
        end = every[-1] if n and every[-1].text else None
        flags = (False, False, False) if end is None else (bool(end.number or end.dollar or end.percent), bool(end.date), bool(end.stop) and not end.shouted_or_single)
        on, *kinds, cut = self.number(head)
        signs = tokens.count("$") if "$" in text else 0
        counts = (title, alpha, number, dollar, percent, date, stop, single, used, signs, n)
        return (*counts, *flags, state, page, bool(_capital.match(head)), on, *kinds, tokens[0] if n else "", tokens[-1] if n else "", second, cut if on else None, head), here


def word_counts(text: Column, chunks: bool = False) -> Column:
    """A struct of COUNTS, FLAGS and TEXTS for each line of stripped text; with chunks also words (t, number, range)."""
    judge: list[Judge] = []

    def run(lines: pa.Array) -> pa.Array:
        if not judge:
            judge.append(Judge())
        rows = [judge[0].line(line or "") for line in lines.to_pylist()]
        columns = list(zip(*(r for r, _ in rows), strict=True)) if rows else [()] * len(_FIELDS)
        arrays, fields = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], list(_FIELDS)
        if chunks:
            arrays.append(pa.array([[{"t": w.text, "number": bool(w.number), "range": w.ranged} for w in words] for _, words in rows], _WORDS))
            fields.append(pa.field("each", _WORDS))
        return pa.StructArray.from_arrays(arrays, fields=fields)

    made: Callable[[Column], Column] = F.arrow_udf(run, _TYPE + (",each:array<struct<t:string,number:boolean,range:boolean>>>" if chunks else ">"))
    return made(text)
