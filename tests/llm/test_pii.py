"""Surrogates against a plain reading of the whole table, and in formats that are full."""

import re

import regex
from pyspark.sql import functions as F

from blockwright.llm import pii, queries

from . import cases

KEY = "test"

PRIVATE = [
    "Mail a.b-9@Mail9.Example.com or call +1 (555) 123-4567, card 4111 1111 1111 1111, ip 10.0.12.255.",
    "Again A.B-9@mail9.example.com and 4111111111111111; ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00",
    "Mr. John Smith met Mrs Smith, Иван Петров, Νίκος Παππάς and Dr Müller.",
    "Clean: 2024-01-15 10:30, v2.0.0, 1,234,567.89, chapter 12, Released 1999-2004, 2019 2020 2021 2022 2023 and 12 345 678 901.",
    "Call 555-123-4567 or 030/1234567 or (0171) 234 5678 or +4930123456; host 2001:0db8:85a3:0000:0000:8a2e:0370:7334, card 5500-0000-0000-0004.",
]


def test_surrogates(spark):
    rows = [(i, t, *[None] * 7) for i, t in enumerate(PRIVATE)] + [(50 + r[0] if r[0] else None, *r[1:]) for r in cases.documents(30)]
    docs = cases.frame(spark, rows)
    got = {r.doc_id: r for r in pii.replace_entities(docs, KEY).collect()}
    a, b, c, clean = (got[i].text for i in range(4))
    assert clean == PRIVATE[3] and got[3].n_entities == 0
    for original in ("a.b-9", "mail9.example", "555", "4111", "10.0.12", "123-45", "3704", "John", "Smith", "Петров", "Παππάς", "Müller"):
        assert all(original.lower() not in t.lower() for t in (a, b, c)), original
    mail, again = re.findall(r"\S+@\S+", a)[0], re.findall(r"\S+@\S+", b)[0]
    assert mail.lower() == again.lower() and mail[0].islower() and again[0].isupper() and re.fullmatch(r"[a-z]\.[a-z]-\d@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", mail)
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", a)[1].replace(" ", "")
    assert card in b and luhn_ok(card) and card[0] == "4"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4},", a) and re.search(r"ip \d\d\.\d\.\d\d\.\d{3}\.", a) and re.search(r"ssn \d{3}-\d\d-\d{4}, IBAN DE\d\d( \d{4}){4} \d\d$", b)
    first, surname, same, ivan, nikos, doctor = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+), (\w+ \w+), (\w+ \w+) and Dr (\w+)\.", c).groups()
    assert surname == same and first in pii.FIRST["latin_m"].split() and ivan.split()[0] in pii.FIRST["cyrillic_m"].split() and nikos.split()[0] in pii.FIRST["greek_m"].split()
    assert account_ok(re.search(r"IBAN (DE.*)", b)[1].replace(" ", ""))
    other = got[4].text
    assert not re.search("4567|1234567|234 5678|123456|85a3|5500", other) and got[4].n_phone == 4 and got[4].n_ipv6 == 1 and got[4].n_card == 1
    assert re.fullmatch(r"Call \d{3}-\d{3}-\d{4} or 0?\d{2,3}/\d{7} or \(\d{4}\) \d{3} \d{4} or \+49\d{8}; host ([0-9a-f]{4}:){7}[0-9a-f]{4}, card \d{4}-\d{4}-\d{4}-\d{4}\.", other), other
    for r in rows[5:]:
        if r[0] is not None:
            assert got[r[0]].text == (r[1] or "")
    assert pii.replace_entities(cases.empty(spark), KEY).count() == 0
    assert pii.replace_entities(docs, key="other").filter("doc_id = 0").first().text != a


def luhn_ok(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_surrogates_stay_distinct_where_formats_are_small(spark):
    ips = [f"{i}.{j}.9.8" for i in range(1, 10) for j in range(1, 10)]
    rows = [(i, f"at {ip} and {ip}", *[None] * 7) for i, ip in enumerate(ips)]
    got = [re.findall(r"\d+\.\d+\.\d+\.\d+", r.text) for r in pii.replace_entities(cases.frame(spark, rows), KEY).collect()]
    assert all(x == y for x, y in got) and len({x for x, _ in got}) == len(ips) and not {x for x, _ in got} & set(ips)


def test_full_names_stay_distinct(spark):
    firsts = pii.FIRST["latin_m"].split() + [f"{a}{b}" for a in ("Al", "Bo", "Cy") for b in ("bert", "ton", "rus", "man")]
    names = [f"{first} {last}" for last in ("Smith", "Jones") for first in firsts] + [f"{first} Петров" for first in pii.FIRST["cyrillic_f"].split()]
    rows = [(i, f"Mr {n} and Mr {n.split()[1]}" if i < 2 * len(firsts) else f"Mrs {n} and Mrs {n.split()[1]}", *[None] * 7) for i, n in enumerate(names)] + [(900 + i, f"{n} again", *[None] * 7) for i, n in enumerate(names) if n.split()[0] in pii.FIRST["latin_m"].split()]
    got = {r.doc_id: r.text for r in pii.replace_entities(cases.frame(spark, rows), KEY).collect()}
    by = [re.fullmatch(r"Mr?s? (\w+ (\w+)) and Mr?s? \2", got[i])[1] for i in range(len(names))]
    assert len(set(by)) == len(names) and not set(by) & set(names)
    assert all(x.split()[0] != n.split()[0] for x, n in zip(by, names)) and len({x.split()[1] for x in by}) == 3
    assert all(got[900 + i] == f"{by[i]} again" for i in range(len(names)) if 900 + i in got)


def account_ok(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_a_full_format_is_left_for_a_wider_one(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]
    rows = [(i, " and ".join(ips[i * 10 : i * 10 + 10]), *[None] * 7) for i in range(1000)]
    got = pii.replace_entities(cases.frame(spark, rows), KEY)
    found = [ip for r in got.collect() for ip in r.text.split(" and ")]
    assert len(found) == len(set(found)) == 10000 and not set(found) & set(ips)
    assert all(re.fullmatch(r"\d+(\.\d+){3}", ip) and all(int(x) < 256 for x in ip.split(".")) for ip in found)


def test_short_addresses_and_mails_stay_distinct(spark):
    mails = [f"{a}@{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "xyz"]
    hosts = [f"::{x}" for x in "123456789"] + ["fe80::1", "FE80::A1", "2001:db8::8a2e:370:7334"]
    rows = [(i, f"to {m}; or", *[None] * 7) for i, m in enumerate(mails)] + [(500 + i, f"at {h} there", *[None] * 7) for i, h in enumerate(hosts)]
    got = {r.doc_id: r.text for r in pii.replace_entities(cases.frame(spark, rows), KEY).collect()}
    sent = [re.fullmatch(r"to (.*); or", got[i])[1] for i in range(len(mails))]
    assert len(set(sent)) == len(mails) and not set(sent) & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.de", m) for m in sent)
    assert len({m.split("@")[1] for m in sent}) == 3
    at = [re.fullmatch(r"at (\S+) there", got[500 + i])[1] for i in range(len(hosts))]
    assert len({h.lower() for h in at}) == len(hosts) and not set(at) & set(hosts) and all(":" in h for h in at)


def test_codes_of_countries_stay(spark):
    numbers = ["+1 555 123 4567", "+44 20 7946 0958", "+49 30 123456", "+352 621 123 456", "+7 495 123-45-67"]
    rows = [(i, n, *[None] * 7) for i, n in enumerate(numbers)]
    got = {r.doc_id: r.text for r in pii.replace_entities(cases.frame(spark, rows), KEY).collect()}
    for i, n in enumerate(numbers):
        assert got[i] != n and got[i].split()[0] == n.split()[0] and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", n), got[i]


def test_permutations_are_injective(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    for text, letters in ((F.col("t"), r"\d{3}"), (F.concat(F.lit("q-"), F.translate("t", "0123456789", "abcdefghij")), "[a-z]-[a-z]{3}")):
        got = [r.x for r in rows.select(pii.disguised(text, F.lit("s"), KEY).alias("x")).collect()]
        assert len(set(got)) == 1000 and all(re.fullmatch(letters, x) for x in got)
    got = [r.x for r in rows.select(pii.disguised(F.concat(F.lit("7"), F.col("t")), F.lit("s"), KEY, leading=True).alias("x")).collect()]
    assert len(set(got)) == 1000 and all(re.fullmatch(r"[1-9]\d{3}", x) for x in got)
    assert pii.disguised(F.lit(""), F.lit("s"), KEY) is not None


def kind_of(mention):
    if "@" in mention:
        return "email"
    for kind in ("iban", "ip", "ipv6", "ssn", "card"):
        if regex.fullmatch(pii.PATTERNS[kind], mention):
            return kind
    if mention[0] in "+(" or mention[0].isdigit():
        least = pii.SHORT_PHONE_DIGITS if mention[0] == "+" or "/" in mention else pii.PHONE_DIGITS
        return "phone" if len(regex.findall(r"\d", mention)) >= least else None
    return "name"


def plain_form(kind, mention):
    if kind in ("email", "ip", "ipv6"):
        return mention.lower()
    return " ".join(w.lower() for w in mention.split(" ") if w.rstrip(".") not in pii._TITLE.split("|")) if kind == "name" else re.sub("[^0-9a-z+]", "", mention.lower())


def test_the_query_over_a_whole_table(spark):
    """Each text is its original with the mentions replaced, one for one: found here by a plain walk of the same patterns."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_pii(spark, sf).collect()}
    entity = regex.compile(pii.ENTITY)
    by, counts = {}, 0
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        spots = [(m.start(), m.end()) for m in entity.finditer(text)]
        pattern, last, kinds = "", 0, []
        for begin, end in spots:
            kind = kind_of(text[begin:end])
            kinds.append(kind)
            pattern += regex.escape(text[last:begin], special_only=True) + (regex.escape(text[begin:end]) if kind is None else "(.+?)")
            last = end
        m = regex.fullmatch(pattern + regex.escape(text[last:], special_only=True), got[doc_id].text, flags=regex.S)
        assert m, doc_id
        said = [(k, text[a:b]) for k, (a, b) in zip(kinds, spots) if k]
        assert got[doc_id].n_entities == len(said)
        for (kind, mention), new in zip(said, m.groups()):
            counts += 1
            assert by.setdefault((kind, plain_form(kind, mention)), plain_form(kind, new)) == plain_form(kind, new), (mention, new)
            if kind == "card":
                digits = re.sub(r"\D", "", mention)
                assert luhn_ok(digits) == luhn_ok(re.sub(r"\D", "", new)) and len(mention) == len(new)
            if kind == "iban":
                assert account_ok(mention.replace(" ", "")) == account_ok(new.replace(" ", ""))
    assert counts > 50
    for kind in pii.TYPES:
        mine = {k[1]: v for k, v in by.items() if k[0] == kind}
        assert len(set(mine.values())) == len(mine) and not set(mine) & set(mine.values()), kind
