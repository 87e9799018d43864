"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

One regular expression finds all entities; each has a type and a normal form (what stays when it is written another
way). All but names are permuted: the characters of a normal form are units (a digit, a letter, an octet) and a keyed
Feistel network adds to one half of them what a hash of the other half gives, so entities of one format have different
surrogates of that format by construction. Check digits of cards and accounts follow. Names have no format to permute:
a surname's surrogate is made of syllables by a keyed hash, and a full name (gender, script, first name, surname) is an
entity of its own, which gives the first name; a surname on its own has the same surrogate as after a first name.

Two checks over all documents keep entities apart: no two have one surrogate, and no surrogate is an entity that occurs.
Those that fail try the next attempt, which takes another permutation and then a wider format (widened() says how), so
there always is room: formats that are full are left, and nothing raises. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored, whole_text

#: Rounds of the Feistel network; even, so that both halves end where they began.
ROUNDS = 8
#: Attempts within an entity's own format; each later one adds a character to it.
OWN_FORMAT = 4

# Titles and first names by gender, endings of surnames by script.
TITLES = {"m": "Mr Herr Señor Sr Monsieur", "f": "Mrs Ms Miss Frau Señora Sra Mme Madame Mlle", "u": "Dr Prof"}
FIRST = {
    "latin_m": "James John Robert Michael William David Richard Joseph Thomas Daniel Hans Karl Pierre Jean Luis Carlos",
    "latin_f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Greta Marie Claire Lucia Carmen",
    "cyrillic_m": "Иван Пётр Сергей Андрей Николай Дмитрий Алексей Михаил",
    "cyrillic_f": "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана",
    "greek_m": "Γιώργος Δημήτρης Νίκος Κώστας",
    "greek_f": "Μαρία Ελένη Κατερίνα Σοφία",
}
SYLLABLES = {
    "latin": "ba be bi bo ca co da de di do fa fe ga go ha he la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi",
    "cyrillic": "ба бо ва во га го да до за ка ко ла ло ма мо на но па по ра ро са со та то",
    "greek": "βα γα δα θα κα λα μα να πα ρα σα τα φα χα βο γο δο θο κο λο μο νο πο ρο",
}
ENDINGS = {"latin": "son ley ton man ner ard", "cyrillic": "ов ев ин ский", "greek": "ος ης ας"}
FIRST_ENDINGS = {"latin_m": "n s rd l", "latin_f": "a na lia ssa", "cyrillic_m": "н р й", "cyrillic_f": "на ра я", "greek_m": "ος ης", "greek_f": "α η"}
#: Attempts that take a first name from the lists; later ones make one of syllables.
LISTED = 2

def _any_of(words: str) -> str:
    """A pattern for any of the words, the shared first letter in front: most places fail on one character."""
    by_first: dict[str, list[str]] = {}
    for word in words.split():
        by_first.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by_first.items())


_TITLE = "|".join(" ".join(TITLES.values()).split())
_FIRST = "|".join(" ".join(FIRST.values()).split())
_NAMED = _any_of(" ".join(TITLES.values()))
_CALLED = _any_of(" ".join(FIRST.values()))
#: Each type's pattern; earlier ones win where two begin at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+-])(?:[3-6]\d{3}(?:[\x20-]\d{4}){2}[\x20-]\d{1,7}|3[47]\d{2}[\x20-]\d{6}[\x20-]\d{5}|\d{13,19})(?![\w-])",
    "phone": r"(?<![\w+.])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,5}\)[\x20.-]?)?\d{1,5}(?:[\x20./-]?\d{2,5}){1,5}|\(\d{2,5}\)[\x20.-]?\d{3,5}(?:[\x20.-]?\d{2,5}){0,3}|\d{3}([\x20.-])\d{3}\1\d{4}|0\d{1,5}[\x20/-]\d{2,8}(?:[\x20-]\d{2,5}){0,3})(?!\w|[.-]\d)",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{_NAMED})\.?\x20\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?|(?:{_CALLED})\x20\p{{Lu}}[\p{{L}}'-]+)(?!\p{{L}})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity but a name has one of these; texts without any are only looked through for names.
SIGNS = "[0-9@]"
TYPES = list(PATTERNS)
#: A phone number has that many digits, or SHORT ones if a plus or a slash shows what it is; matches with fewer are left alone.
PHONE_DIGITS, SHORT_PHONE_DIGITS = 9, 7
# Country calling codes of one and of two digits; all others have three.
CODES_1 = "1 7"
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: The kind of entity that a full name is, beside the types, and what its parts are joined by.
FULL = "full"
PART = "\x1f"


def keyed(key: str, n: int | Column, *parts: Column | str) -> Column:
    """A number below n that only the key gives away, from a hash of the parts."""
    said = F.concat_ws("\x1f", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 14), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def pick(words: str, at: Callable[[int], Column]) -> Column:
    listed = words.split()
    return F.element_at(F.array(*map(F.lit, listed)), (at(len(listed)) + 1).cast("int"))


def type_of(mention: Column) -> Column:
    """The type of a match; null where it is left alone (too few digits for a phone number)."""
    out = F.when(mention.contains("@"), "email")
    for kind in ("iban", "ip", "ipv6", "ssn", "card"):
        out = out.when(mention.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    least = F.when(mention.rlike("^[+]|/"), SHORT_PHONE_DIGITS).otherwise(PHONE_DIGITS)
    return out.when(mention.rlike(r"^[+(\d]"), F.when(digits >= least, "phone")).otherwise("name")


def normal(kind: Column, mention: Column) -> Column:
    """What stays of a mention however it is written: a name's surname, else the letters and digits (an e-mail address keeps its signs, a phone number its plus)."""
    return (
        F.when(kind == "name", F.lower(F.element_at(F.split(mention, " "), -1)))
        .when(kind == "email", F.lower(mention))
        .when(kind == "phone", F.regexp_replace(mention, r"[^0-9+]", ""))
        .when(kind.isin("ip", "ipv6"), F.lower(mention))
        .otherwise(F.lower(F.regexp_replace(mention, r"[^A-Za-z0-9]", "")))
    )


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def permuted(values: Column, radices: Column, salt: Column, key: str) -> Column:
    """An array of integers, each below its radix, as another such array: a keyed permutation for each salt and array of radices."""

    def begin(a: Column) -> Column:
        half = (F.size(a["v"]) / 2).cast("int")
        parts = [F.slice(a[c], F.lit(1) if k == 0 else half + 1, half if k == 0 else F.size(a[c]) - half).alias(f"{c}{k}") for k in (0, 1) for c in ("v", "r")]
        return F.struct(a["salt"].alias("salt"), *parts)

    def turn(acc: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("\x1f", F.lit(key), acc["salt"], i.cast("string"), F.array_join(F.transform(acc["v1"], lambda x: x.cast("string")), ",")), 512)

        def add(b: Column) -> Column:
            drawn = lambda j: F.conv(b["stream"].substr(j % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = F.transform(b["a"]["v0"], lambda v, j: F.pmod(v + drawn(j), F.element_at(b["a"]["r0"], j + 1)))
            return F.struct(b["a"]["salt"].alias("salt"), b["a"]["v1"].alias("v0"), b["a"]["r1"].alias("r0"), moved.alias("v1"), b["a"]["r0"].alias("r1"))

        return bound(F.struct(stream.alias("stream"), acc.alias("a")), add)

    def run(a: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin(a), turn, lambda acc: F.concat(acc["v0"], acc["v1"]))

    return bound(F.struct(values.alias("v"), radices.alias("r"), salt.alias("salt")), run)


ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def disguised(text: Column, salt: Column, key: str, skip: Column | int = 0, hexadecimal: bool = False, leading: bool = False) -> Column:
    """Digits and small letters of a text permuted, each within its class, after the first skip characters; leading: a first digit that isn't 0 stays so."""

    def unit(s: Column, i: Column) -> Column:
        c = s["text"].substr(i, F.lit(1))
        place = F.instr(F.lit(ALPHABET), c) - 1
        low = F.when((i == s["skip"] + 1) & (c != "0"), 1).otherwise(0) if leading else F.lit(0)
        free = (i > s["skip"]) & (c != "") & (place >= 0)
        if hexadecimal:
            lo, radix = F.lit(0), F.when(free & (place < 16), 16).otherwise(1)
        else:
            lo = F.when(place >= 10, 10).otherwise(low)
            radix = F.when(~free, 1).when(place >= 10, 26).otherwise(10 - low)
        return F.struct(c.alias("c"), lo.alias("lo"), radix.alias("r"), F.when(radix > 1, place - lo).otherwise(0).alias("v"))

    def whole(s: Column) -> Column:
        units = F.transform(F.sequence(F.lit(1), F.length(s["text"])), lambda i: unit(s, i))

        def written(u: Column) -> Column:
            new = permuted(F.transform(u, lambda x: x["v"]), F.transform(u, lambda x: x["r"]), s["salt"], key)
            return F.array_join(F.zip_with(u, new, lambda x, n: F.when(x["r"] > 1, F.lit(ALPHABET).substr(x["lo"] + n + 1, F.lit(1))).otherwise(x["c"])), "")

        return F.when(F.length(s["text"]) > 0, bound(units, written)).otherwise("")

    given = F.struct(text.alias("text"), salt.alias("salt"), (F.lit(skip) if isinstance(skip, int) else skip).alias("skip"))
    return bound(given, whole)


def luhn(digits: Column) -> Column:
    """The check digit that belongs behind a string of digits."""

    def weighed(i: Column) -> Column:
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda a, b: a + b)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def account_check(country: Column, account: Column) -> Column:
    """The two check digits, as a number, that belong between a country and an account number (small letters and digits): 98 less the remainder by 97."""
    said = F.concat(account, country, F.lit("00"))
    value = lambda i: F.instr(F.lit(ALPHABET), said.substr(i, F.lit(1))) - 1
    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(said)), value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return 98 - rest


def widened(text: Column, attempt: Column) -> Column:
    """Room for more surrogates: from attempt OWN_FORMAT on, another zero behind a text with each attempt."""
    return F.concat(text, F.repeat(F.lit("0"), F.greatest(attempt - (OWN_FORMAT - 1), F.lit(0))))


def code_length(digits: Column) -> Column:
    """How many digits the country calling code at the beginning has."""
    return F.when(F.left(digits, F.lit(1)).isin(*CODES_1.split()), 1).when(F.left(digits, F.lit(2)).isin(*CODES_2.split()), 2).otherwise(3)


def private_address(norm: Column, attempt: Column, key: str) -> Column:
    """An IPv6 address for private use, by a hash."""
    drawn = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("private"), norm, attempt.cast("string")), 256)
    groups = [F.concat(F.lit("fd") if i == 0 else F.lit(""), drawn.substr(4 * i + 1, 2 if i == 0 else 4)) for i in range(8)]
    return F.concat_ws(":", *groups)


def _address(norm: Column, salt: Column, attempt: Column, key: str) -> Column:
    """An IPv4 address: octets with as many digits as before; later attempts take any octets, and those beyond twice OWN_FORMAT an IPv6 address."""
    own, wide = attempt == 0, attempt < 2 * OWN_FORMAT
    parts = F.split(norm, r"\.")
    low = lambda p: F.when(~own | (F.length(p) == 1) | p.startswith("0"), 0).when(F.length(p) == 2, 10).otherwise(100)
    radix = lambda p: F.when(~own, 256).when((F.length(p) == 1) | p.startswith("0"), 10).when(F.length(p) == 2, 90).otherwise(156)
    values = F.transform(parts, lambda p: p.try_cast("int") - low(p))
    new = permuted(values, F.transform(parts, radix), F.concat_ws("\x1e", salt, F.array_join(F.transform(parts, lambda p: F.when(own, F.length(p).cast("string")).otherwise("")), ".")), key)
    octet = lambda p, n: F.when(own & p.startswith("0") & (F.length(p) == 2), F.concat(F.lit("0"), n.cast("string"))).otherwise((n + low(p)).cast("string"))
    return F.when(wide, F.array_join(F.zip_with(parts, new, octet), ".")).otherwise(private_address(norm, attempt, key))


def syllables(script: str, n: Column, key: str, *said: Column | str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(SYLLABLES[script], lambda m: keyed(key, m, *said, i))), "")


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normal form of an entity's surrogate."""
    salt = F.concat_ws("\x1e", kind, attempt.cast("string"))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = domain.substr(F.lit(1), F.length(domain) - F.length(tld) - 1)
    longer = F.concat(local, F.repeat(F.lit("a"), F.greatest(attempt - (OWN_FORMAT - 1), F.lit(0))))
    email = F.concat(disguised(longer, F.concat_ws("\x1e", salt, domain), key), F.lit("@"), disguised(host, F.concat_ws("\x1e", F.lit("host"), tld), key), F.lit("."), tld)
    body, last = norm.substr(F.lit(1), F.length(norm) - 1), F.right(norm, F.lit(1)).try_cast("int")
    card = bound(disguised(widened(body, attempt), salt, key, skip=1), lambda new: F.concat(new, F.pmod(luhn(new) + last - luhn(body), F.lit(10)).cast("string")))
    country, account, check = norm.substr(1, 2), norm.substr(F.lit(5), F.length(norm)), norm.substr(3, 2).try_cast("int")
    checked = lambda new: F.lpad(F.pmod(account_check(country, new) + check - account_check(country, account), F.lit(100)).cast("string"), 2, "0")
    iban = bound(disguised(widened(account, attempt), F.concat_ws("\x1e", salt, country), key), lambda new: F.concat(country, checked(new), new))
    code = code_length(norm.substr(F.lit(2), F.length(norm)))
    phone = disguised(widened(norm, attempt), salt, key, skip=F.when(norm.startswith("+"), code + 1).otherwise(0), leading=True)
    ipv6 = F.when(attempt < OWN_FORMAT, disguised(norm, salt, key, hexadecimal=True)).otherwise(private_address(norm, attempt, key))
    surname = F.lit(None).cast("string")
    for script in SYLLABLES:
        made = F.concat(syllables(script, attempt + 3, key, salt, norm), pick(ENDINGS[script], lambda n: keyed(key, n, salt, norm, "ending")))
        surname = F.when(script_of(norm) == script, made).otherwise(surname)
    return F.when(kind == "email", email).when(kind == "ip", _address(norm, salt, attempt, key)).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "name", surname).when(kind == "ipv6", ipv6).otherwise(disguised(widened(norm, attempt), salt, key))


def full_name(kind: Column, mention: Column) -> Column:
    """Gender, script, first name and surname of a name that has a first name; else null."""
    words = F.split(mention, " ")
    first = F.get(words, F.size(words) - 2)
    titled = (F.size(words) == 2) & F.regexp_replace(first, r"\.$", "").isin(_TITLE.split("|"))
    return F.when((kind == "name") & ~titled, F.concat_ws(PART, _gender(words), script_of(first), F.lower(first), F.lower(F.element_at(words, -1))))


def first_surrogate(full: Column, attempt: Column, key: str) -> Column:
    """Another first name of the gender and script, beside the surname that is to be replaced."""
    parts = F.split(full, PART)
    out = F.lit(None).cast("string")
    for name, listed in FIRST.items():
        script, gender = name.split("_")
        others = F.filter(F.array(*(F.lit(x.lower()) for x in listed.split())), lambda x: x != parts[2])
        chosen = F.element_at(others, (keyed(key, F.size(others), "first", full, attempt) + 1).cast("int"))
        made = F.concat(syllables(script, attempt + 1, key, "first", full, attempt), pick(FIRST_ENDINGS[name], lambda n: keyed(key, n, "first", full, attempt, "ending")))
        out = F.when((parts[0] == gender) & (parts[1] == script), F.when(attempt < LISTED, chosen).otherwise(made)).otherwise(out)
    return F.concat_ws(PART, out, parts[3])


def rendered(kind: Column, mention: Column, by: Column, first: Column, key: str) -> Column:
    """A surrogate written as the mention is: its case, signs and spaces, with what is longer behind it; a name's title stays, its first name changes within gender and script."""
    plain = F.regexp_replace(mention, r"[^A-Za-z0-9+]", "")

    def cased(like: Column, c: Column) -> Column:
        return F.when(like.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)

    def step(i: Column) -> Column:
        c = mention.substr(i, F.lit(1))
        k = F.length(F.regexp_replace(mention.substr(F.lit(1), i), r"[^A-Za-z0-9+]", ""))
        return F.when(c.rlike("[A-Za-z0-9+]"), cased(c, by.substr(k, F.lit(1)))).otherwise(c)

    places = F.sequence(F.lit(1), F.length(mention))
    signs = F.concat(F.array_join(F.transform(places, step), ""), by.substr(F.length(plain) + 1, F.length(by)))
    as_is = F.array_join(F.transform(places, lambda i: cased(mention.substr(i, F.lit(1)), by.substr(i, F.lit(1)))), "")
    email = F.when(F.length(by) == F.length(mention), as_is).otherwise(by)
    words = F.split(mention, " ")

    def word(w: Column, i: Column) -> Column:
        last = F.when(w == F.upper(w), F.upper(by)).otherwise(F.initcap(by))
        return F.when(i == F.size(words) - 1, last).when((i == 0) & F.regexp_replace(w, r"\.$", "").isin(_TITLE.split("|")), w).otherwise(F.initcap(F.substring_index(first, PART, 1)))

    name = F.array_join(F.transform(words, word), " ")
    return F.when(kind == "name", name).when(kind == "email", email).when(kind.isin("ip", "ipv6"), cased(mention, by)).otherwise(signs)


def _gender(words: Column) -> Column:
    """m or f by the title or the first name; else by a hash, so that it stays the same."""
    head = F.regexp_replace(words[0], r"\.$", "")
    second = F.when(F.size(words) > 2, words[1]).otherwise(head)
    men = TITLES["m"].split() + " ".join(v for k, v in FIRST.items() if k.endswith("_m")).split()
    women = TITLES["f"].split() + " ".join(v for k, v in FIRST.items() if k.endswith("_f")).split()
    return F.when(head.isin(*women) | second.isin(*women), "f").when(head.isin(*men) | second.isin(*men), "m").otherwise(F.when(F.crc32(second) % 2 == 0, "m").otherwise("f"))


def _checked(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm and attempt of the entities (one row each) whose first surrogate would not do.

    Each round looks at those that failed in the one before only; what earlier rounds have given is taken, too. Full
    names' surrogates are compared beside the surname that is to be replaced, since no two surnames have one surrogate.
    """

    def surrogates(rows: DataFrame, attempt: int) -> DataFrame:
        kind, norm, n = F.col("kind"), F.col("norm"), F.lit(attempt)
        by = F.when(kind == FULL, first_surrogate(norm, n, key)).otherwise(surrogate(kind, norm, n, key))
        return rows.select("kind", "norm", n.alias("attempt"), by.alias("by"))

    entities = stored(entities, "entities")
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = entities.select("kind", F.col("norm").alias("by"))
    rows, attempt, late = entities, 0, None
    while True:
        dealt = rows.repartition(parts, "norm")  # few bytes but many hashes: left to itself Spark would put them in one task
        tried = stored(surrogates(dealt, attempt), "tried")
        owner = tried.groupBy("kind", "by").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).filter("n > 1")
        many = tried.join(owner, ["kind", "by"]).filter("norm <> owner")
        real = tried.join(taken, ["kind", "by"], "left_semi")
        same = tried.filter((F.col("kind") == FULL) & F.col("norm").endswith(F.concat(F.lit(PART), "by")))
        again = stored(reduce(DataFrame.unionByName, (x.select("kind", "norm") for x in (many, real, same))).distinct(), "again")
        if attempt:
            kept = tried.join(again, ["kind", "norm"], "left_anti").select("kind", "norm", "attempt")
            late = kept if late is None else late.unionByName(kept)
        if again.isEmpty():
            return late if late is not None else tried.select("kind", "norm", "attempt").limit(0)
        taken = taken.unionByName(tried.select("kind", "by"))
        rows, attempt = again, attempt + 1


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, text with surrogates, n_entities and n_<type> of each type.

    The key decides all surrogates: without it none can be computed again. All other text stays as it is. Null texts
    count as empty, null ids stay null. Repeated rows give repeated rows with the same surrogates; a long text is one
    row's work; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    worth = F.col("text").rlike(SIGNS) | F.col("text").rlike(PATTERNS["name"])
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "text", F.when(worth, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(none).alias("mentions"))
    typed = F.transform("mentions", lambda m: F.struct(m.alias("mention"), type_of(m).alias("kind")))
    normed = F.transform("typed", lambda m: F.struct(m["mention"].alias("mention"), m["kind"].alias("kind"), normal(m["kind"], m["mention"]).alias("norm"), full_name(m["kind"], m["mention"]).alias("full")))
    kinds = rows.select("doc_id", "text", typed.alias("typed")).select("doc_id", "text", normed.alias("ms"))

    each = F.transform("ms", lambda m: F.array(F.struct(m["kind"].alias("kind"), m["norm"].alias("norm")), F.struct(F.lit(FULL).alias("kind"), m["full"].alias("norm"))))
    mentions = kinds.select(F.xxhash64("text").alias("h"), F.explode(F.flatten(each)).alias("m")).select("h", "m.kind", "m.norm").filter("kind is not null and norm is not null")
    found = stored(mentions.distinct(), "mentions")
    late = stored(_checked(found.select("kind", "norm").distinct(), key), "late")

    label = F.concat_ws("\x1e", "kind", "norm")
    if late.isEmpty():
        joined = kinds.withColumn("late", F.create_map().cast("map<string,int>"))
    else:  # by the text's hash: equal texts share a map, and should two texts have one hash, it holds what both need
        by_text = stored(found.join(late, ["kind", "norm"]).groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(label, "attempt"))).alias("late")), "late")
        size = F.aggregate(F.map_keys("late"), F.lit(100).cast("long"), lambda n, k: n + F.octet_length(k) + 40)
        total = by_text.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        joined = kinds.withColumn("h", F.xxhash64("text")).join(sized(by_text, 1, total), "h", "left").select("doc_id", "text", "ms", F.coalesce("late", F.create_map().cast("map<string,int>")).alias("late"))

    attempt = lambda kind, norm: F.coalesce(F.try_element_at("late", F.concat_ws("\x1e", kind, norm)), F.lit(0))
    tried = F.transform("ms", lambda m: F.struct(m["mention"].alias("mention"), m["kind"].alias("kind"), m["norm"].alias("norm"), m["full"].alias("full"), attempt(m["kind"], m["norm"]).alias("attempt"), attempt(F.lit(FULL), m["full"]).alias("full_attempt")))
    first = lambda m: F.when(m["full"].isNotNull(), first_surrogate(m["full"], m["full_attempt"], key))
    by = F.transform(tried, lambda m: F.struct(m["mention"].alias("mention"), m["kind"].alias("kind"), F.when(m["kind"].isNotNull(), surrogate(m["kind"], m["norm"], m["attempt"], key)).alias("by"), first(m).alias("first")))
    new = F.transform(by, lambda m: F.when(m["kind"].isNull(), m["mention"]).otherwise(rendered(m["kind"], m["mention"], m["by"], m["first"], key)))
    pieces = F.split("text", ENTITY, -1)
    merged = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = [F.size(F.filter("ms", lambda m: m["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in TYPES]
    n = F.size(F.filter("ms", lambda m: m["kind"].isNotNull())).cast("long").alias("n_entities")
    return joined.select("doc_id", F.when(F.size("ms") > 0, merged).otherwise(F.col("text")).alias("text"), n, *counts)
