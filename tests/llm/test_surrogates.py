"""Surrogates: no planted mention stays, one surrogate for each person."""

import re

import pytest

from tollgate.llm import pii
from tollgate.llm.common import prepare
from tollgate.llm.queries import PUBLIC_KEY

PEOPLE = [("Mrs", "Anna", "Keller"), ("Г-н", "Сергей", "Їжаченко"), ("Dr.", "Νίκος", "Ξενάκης"), ("Mr", "Արամ", "Խաչատրյան"),
          ("Prof.", "აკაკი", "წერეთელი"), ("Frau", "Łucja", "Żółćová"), ("Dr.", "דוד", "כהן"), ("Mr", "José", "González")]


@pytest.mark.parametrize("title, first, last", PEOPLE)
def test_no_mention_of_a_name_stays(spark, title, first, last):
    text = (f"{title} {first} {last} came. {last} said hi. {first} left. {first.upper()} {last.upper()} and {last}'s dog; "
            f"{last}s Haus, ({first}) \"{last}\" {last}-Platz, {title} {last}.")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    new = pii.replace(docs, PUBLIC_KEY).first()["text"]
    fold = new.casefold()
    assert first.casefold() not in fold and last.casefold() not in fold
    m = re.match(rf"{re.escape(title)} (\S+) (\S+) came\. (\S+) said hi\. (\S+) left\. (\S+) (\S+) and (\S+)'s dog; (\S+)s Haus, "
                 rf"\((\S+)\) \"(\S+)\" (\S+)-Platz, {re.escape(title)} (\S+)\.$", new)
    one, two = {m[i].casefold() for i in (1, 4, 5, 9)}, {m[i].casefold() for i in (2, 3, 6, 7, 8, 10, 11, 12)}
    assert len(one) == len(two) == 1


@pytest.mark.parametrize("word", ["արամ", "łżąść", "άέήίό", "їєґі", "აკაკი", "דוד", "مريم", "राम"])
def test_every_letter_becomes_another_of_its_script(word):
    for attempt in range(3):
        new = pii.surrogate(b"key", "name", word, attempt)
        assert len(new) == len(word) and all(a != b or not a.isalpha() for a, b in zip(word, new))


@pytest.mark.parametrize("text, kind, found", [
    ("to DE89370400440532013000.", "iban", ["DE89370400440532013000"]),
    ("IBAN DE89 3704 0044 0532 0130 00 THIS BANK", "iban", ["DE89 3704 0044 0532 0130 00"]),
    ("SSN 123-45-6789, not 123-45-67890 or 1123-45-6789", "ssn", ["123-45-6789"]),
    ("at 2001:db8::7, [fe80::1]: fd12:3456:789a:1::1; 1:2:3:4:5:6:7:8", "ipv6",
     ["2001:db8::7", "fe80::1", "fd12:3456:789a:1::1", "1:2:3:4:5:6:7:8"]),
    ("12:30:45 a::b std::map 00:1a:2b:3c:4d:5e ::", "ipv6", []),
    ("password: ........ token = --------", "secret", []),
])
def test_numbers(text, kind, found):
    assert [text[a:b] for a, b, k, _ in pii.entities(text) if k == kind] == found


def test_formats_stay():
    new = pii.surrogate(b"key", "iban", "DE89370400440532013000", 0)
    assert new[:2] == "DE" and len(new) == 22 and pii.iban_valid(new) and new[2:].isdigit()
    assert not pii.iban_valid(pii.surrogate(b"key", "iban", "DE88370400440532013000", 0))
    assert pii.surrogate(b"key", "ipv6", "2001:db8::7", 0).startswith("2001:db8::")
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", pii.dressed("ssn", "123-45-6789", pii.surrogate(b"key", "ssn", "123456789", 0)))


def test_a_format_without_a_free_value_gets_longer_ones(spark):
    prepare(spark)
    rows = [("phone", str(n)) for n in range(100, 1000)] + [("ipv6", f"fe80::{n:x}") for n in range(1, 16)] + [("secret", "--------a")]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), b"key").collect()
    got = {(r["kind"], r["entity"]): (r["kind"], r["surrogate"]) for r in out}
    assert set(got) == set(rows) and len(set(got.values())) == len(rows) and not set(got.values()) & set(rows)


def test_other_columns_nulls_and_empty_tables(spark):
    schema = "new string, text string, doc_id long, mark int, kind string, entity string, surrogate string, __new int, n_entities int"
    rows = [("a", "Mrs Anna Keller", 1, 1, "k", "e", "s", 2, 9), ("a", "Mrs Anna Keller", 1, 1, "k", "e", "s", 2, 9),
            (None, None, None, None, None, None, None, None, None), ("b", "", 2, 1, "k", "e", "s", 2, 9)]
    out = pii.replace(spark.createDataFrame(rows, schema), PUBLIC_KEY)
    got = out.collect()
    assert sorted(out.columns) == sorted(c.split()[0] for c in schema.split(", ")) and len(got) == 4
    names = [r["text"] for r in got if r["doc_id"] == 1]
    assert names[0] == names[1] and "Keller" not in names[0] and {r["n_entities"] for r in got} == {0, 2}
    assert all(r["new"] == "a" and r["__new"] == 2 for r in got if r["doc_id"] == 1)
    empty = spark.createDataFrame([], schema)
    assert pii.replace(empty, PUBLIC_KEY).count() == 0
