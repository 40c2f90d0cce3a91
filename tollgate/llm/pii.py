"""Operator 9: surrogates for personal data.

Detected: e-mail addresses, phone numbers, card numbers, IBANs, social
security numbers (three, two and four digits), IPv4 and IPv6 addresses (an
IPv6 address of three groups or more, or two with a first one of four digits),
secrets, and persons (a title or a listed given name, with the names that
follow).  A name word found once in a text goes at each of its mentions there:
bare, in capitals, before a possessive or plural s, and as a part of a
compound.  Each distinct entity gets one surrogate, drawn from a
keyed hash (HMAC-SHA256) of its type and canonical form, so it is replaced
alike in every document and form; names are replaced word by word, so 'Mrs
Anna Keller' and 'Mrs Keller' stay the same person.  Surrogates keep the type
and the format: lengths, separators, case, digits as digits, the check digits'
validity of card numbers and IBANs, an IBAN's country, private addresses as
private ones (of the same range while it has free ones), the script of names
(every letter becomes another one of its alphabet), and the gender of listed
given names (titles stay): their surrogates are other given names and, when
those are used up, double names of them.  Where a format has no free value
left, later attempts make surrogates longer, so the draw always ends.

The distinct entities of all documents form a table.  Surrogates that two
entities share, or that equal an entity of the data, are drawn again until all
are distinct; only then are documents rewritten, through a join on the text's
hash that only texts with entities enter.

Null text stays null and has no entities.  Empty tables give empty results.
Repeated rows are rewritten alike.  All columns are kept, whatever their names
(``n_entities`` is replaced); ``n_chars``, where
there is one, is the new length."""

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored

#: Given names that are searched for, by gender and script.
LISTED = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Elena Clara Sofia Alice Carmen Ingrid Claire Helen Martha Lucia Nadia Rosa Heidi Sylvie".split(),
    ("m", "latin"): "Peter Thomas Michael David Martin Robert Daniel Simon Carlos Pablo Pierre Jean Hans Klaus James William George Henri Diego Stefan".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Дмитрий Николай Михаил Алексей".split(),
}
#: Given names that stand in for them; none is searched for.
SURROGATES = {
    ("f", "latin"): "Greta Hanna Frieda Paula Nora Lena Marta Irene Judith Vera Olivia Lydia Edith Agnes Bianca Camila Daria Esther Flora Gloria Hilda Iris Johanna Katharina Lotte Miriam Nina Ottilie Petra Regina Sabine Theresa Ursula Viola Wilma Yvonne Amelie Beatrix Cecilia Dorothea".split(),
    ("m", "latin"): "Anton Bruno Conrad Edgar Felix Gustav Hugo Ivan Jakob Karl Leon Markus Niklas Otto Paul Quentin Rolf Samuel Tobias Ulrich Victor Walter Xavier Yannick Arthur Bernard Christian Dominik Erik Frank Gerald Harald Igor Jonas Konrad Lukas Matthias Norbert Oliver Philipp".split(),
    ("f", "cyrillic"): "Алина Валентина Вера Галина Дарья Екатерина Зоя Инна Ксения Лариса Людмила Надежда Нина Полина Раиса Тамара".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Виктор Глеб Григорий Денис Егор Игорь Кирилл Леонид Максим Олег Павел Роман Фёдор".split(),
}
GIVEN = {group: names + SURROGATES[group] for group, names in LISTED.items()}
TITLES = set("Mr Mr. Mrs Mrs. Ms Ms. Miss Dr Dr. Prof Prof. Herr Frau Monsieur Madame Señor Señora Sr. Sra. Г-н Г-жа".split())
LETTERS = {  # alphabets whose letters stand in for one another
    "latin": ("aeiou", "bcdfghklmnprstvw"),
    "accented": ("àáâäèéêëìíîïòóôöùúûü", "bcdfghklmnprstvw"),
    "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}
_GROUP = {name.casefold(): group for group, names in LISTED.items() for name in names}
_STARTS = TITLES | {n for names in LISTED.values() for n in names}
_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_SECRET = re.compile(
    r"(?i:\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b\s{0,3}[:=]\s{0,3}[\"']?)([A-Za-z0-9_\-+/=.]{8,})"
    r"|(?<!\w)((?=[0-9a-f]*\d)[0-9a-f]{32,64}|(?=[0-9A-F]*\d)[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?!\w)"
)
_CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w|[.-]\d)")
_PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w|[.-]\d)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)")
_IPV6 = re.compile(
    r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?!\w|:[0-9A-Fa-f:]|\.\d)"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
_SSN = re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?!\w|[.-]\d)")
_WORD = r"(?:\p{L}\p{M}*)+"
_NEXT_NAME = regex.compile(rf"\s+({_WORD}(?:[-'’]{_WORD})*)")
_MENTION = regex.compile(rf"(?<![^\W_]){_WORD}(?:[-'’]{_WORD})*(?![^\W_])")
_PART = regex.compile(_WORD)
_POSSESSIVE = re.compile(r"['’][sS]?$")
_JOINED_BEFORE = re.compile(r"(?:-[^\W\d_]*[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я](?![^\W_]))*")  # read backwards
_JOINED_AFTER = re.compile(r"(?:-(?=[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я])[^\W\d_]+(?![^\W_]))*")
_RUN = re.compile(r"[^\W_]+")
_BY_RUN: dict[str, list[str]] = {}  # starts by their first run of letters
for _start in sorted(_STARTS):
    _BY_RUN.setdefault(_RUN.match(_start)[0], []).append(_start)


def _emails(text: str):
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo and _LOCAL.match(text[lo - 1]):
            lo -= 1
        domain = _DOMAIN.match(text, at + 1)
        if lo < at and domain:
            yield lo, domain.end()
        at = text.find("@", at + 1)


def _names(text: str):
    """Spans of single name words after a title or from a listed given name on."""
    # A start stands between non-alphanumeric characters, so its first run does, too.
    for start in chain.from_iterable(map(_BY_RUN.__getitem__, _BY_RUN.keys() & _RUN.findall(text))):
        given, at = start not in TITLES, text.find(start)
        while at >= 0:
            lo, end = at, at + len(start)
            whole = (not at or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
            spans, n = [], 0
            if whole and given:  # with the other words of a double name
                lo -= len(_JOINED_BEFORE.match(text[max(0, lo - 64) : lo][::-1])[0])
                end = _JOINED_AFTER.match(text, end).end()
                spans.append((lo, end))
            while whole and n < 2:
                m = _NEXT_NAME.match(text, end)
                if not m or not starts_name(m[1]) or m[1] in TITLES:
                    break
                a, b = m.span(1)
                spans.append((a, b - len(m[1]) + len(_POSSESSIVE.sub("", m[1]))))
                end, n = b, n + 1
            if len(spans) > given:  # a given name alone may be any word
                yield from spans
            at = text.find(start, at + 1)


def starts_name(word: str) -> bool:
    """Whether a word has a capital, or a script without capitals."""
    return word[0].title()[0] == word[0]


def _mentions(text: str, known: set[str], n_found: int):
    """Spans of all mentions of name words, ``n_found`` of which are found."""
    known = known | {p for n in known for p in _PART.findall(n) if p != n and len(p) > 2}
    folded = text.casefold()
    if sum(map(folded.count, known)) == n_found:  # each is found already
        return
    for m in _MENTION.finditer(text):
        word, at = m[0], m.start()
        if not starts_name(word):
            at = None  # only capitals within it may be names
        whole = word.casefold()
        bare = _POSSESSIVE.sub("", word)
        if at is not None and len(bare) > 1:
            if whole in known:
                yield m.span()
                continue
            if bare.casefold() in known:
                yield at, at + len(bare)
                continue
            if whole[-1] == "s" and whole[:-1] in known and len(whole) > 2:
                yield at, m.end() - 1
                continue
        for p in _PART.finditer(word):
            if len(p[0]) > 1 and p[0] != word and starts_name(p[0]) and p[0].casefold() in known:
                yield m.start() + p.start(), m.start() + p.end()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        own = m[0]
        while " " in own and not iban_valid(own):  # words in capitals may follow
            own = own.rsplit(" ", 1)[0]
        if len(own) > 14 and iban_valid(own):
            yield m.start(), m.start() + len(own)
        elif all(any(c.isdigit() for c in g) for g in m[0].split()) and 2 * sum(c.isdigit() for c in m[0]) > len(m[0]):
            yield m.span()


def iban_check(country: str, rest: str) -> str:
    """The check digits of an account in a country (ISO 7064, mod 97)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def iban_valid(surface: str) -> bool:
    own = surface.replace(" ", "")
    return iban_check(own[:2], own[4:]) == own[2:4]


def _ipv6(text: str):
    for m in _IPV6.finditer(text):
        groups = [g for g in m[0].split(":") if g]
        if len(groups) > 2 or len(groups) == 2 and len(groups[0]) == 4:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:  # a time, a hardware address
                continue
            if any(c.isdigit() for c in m[0]):
                yield m.span()


def canonical(kind: str, surface: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(surface))
    return surface.casefold() if kind in ("email", "name") else surface


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, type, canonical form), in order."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    digits = any(c in text for c in "0123456789")
    if "@" in text:
        found += [(0, a, b, "email") for a, b in _emails(text)]
    if digits or "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if any(c.isalnum() for c in m[1] or m[2]):
                found.append((1, *m.span(1 if m[1] else 2), "secret"))
    if digits:
        found += [(2, a, b, "iban") for a, b in _ibans(text)]
        if "::" in text or text.count(":") > 6:
            found += [(2, a, b, "ipv6") for a, b in _ipv6(text)]
        for rank, kind, pattern in ((3, "ssn", _SSN), (4, "card", _CARD), (5, "phone", _PHONE), (6, "ipv4", _IPV4)):
            found += [(rank, *m.span(), kind) for m in pattern.finditer(text)]
    names = list(_names(text))
    found += [(7, a, b, "name") for a, b in names]
    if names:
        known = {text[a:b].casefold() for a, b in names if b - a > 1}
        found += [(8, a, b, "name") for a, b in _mentions(text, known, len(set(names)))]
    taken: list[tuple[int, int, str, str]] = []
    for _, a, b, kind in sorted(set(found)):
        at = bisect(taken, (a,))
        if (not at or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, kind, canonical(kind, text[a:b])))
    return taken


@lru_cache(maxsize=4096)
def alphabet(low: str) -> str:
    """The letters that a lower-case letter may become, itself excluded: its
    class in ``LETTERS``, else letters of its script and case that stand near
    it in Unicode."""
    base = unicodedata.normalize("NFD", low)[0]
    script = unicodedata.name(base, "?").split()[0].lower()
    own = next((s for pair in LETTERS.values() for s in pair if low in s), None)
    own = own or next((s for pair in LETTERS.values() for s in pair if base in s), None)
    if own is None and script in LETTERS:
        own = LETTERS[script][1]
    if own is None:
        page = range(ord(base) & ~0x7F, (ord(base) | 0x7F) + 1)
        own = "".join(
            c for c in map(chr, page)
            if unicodedata.category(c) == unicodedata.category(base) and unicodedata.name(c, "?").split()[0].lower() == script
        )
    return own.replace(low, "")


class Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.n, self.pool = key, "\x1f".join(map(str, of)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.of + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n

    def like(self, text: str, hexa: bool = False) -> str:
        """Digits for digits, letters for letters of their class and case."""
        out = []
        for c in text:
            if hexa and c in "0123456789abcdefABCDEF":
                h = "0123456789abcdef"[self.below(16)]
                out.append(h.upper() if text.upper() == text else h)
            elif c in "0123456789":
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                own = alphabet(c.lower())
                new = own[self.below(len(own))] if own else c
                upper = new.upper() if c.isupper() else new
                out.append(upper if len(upper) == 1 else new)
            else:
                out.append(c)
        return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def given_name(key: bytes, group: tuple[str, str], words: list[str], attempt: int, draw: Draw) -> str:
    """A given name of the group: for each listed name others in a keyed
    order, then double and longer ones."""
    listed = sorted(n.casefold() for n in LISTED[group])
    cycle = sorted((n.casefold() for n in SURROGATES[group]), key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
    turns = len(cycle) // len(listed)
    if len(words) == 1 and attempt < turns:
        return cycle[attempt * len(listed) + listed.index(words[0])]
    return "-".join(cycle[draw.below(len(cycle))] for _ in range(max(2, len(words)) + attempt // 8))


def address(own: list[int], attempt: int, draw: Draw) -> list[int]:
    """An IPv4 address of the same range.  Late attempts, made where a range
    has no free address left, widen private ones to the next larger private
    range and last to 240.0.0.0/4: never routed, and seven times as large as
    all private and loopback ranges."""
    a, b = own[:2]
    small = (a, b) == (192, 168) or a == 172 and 16 <= b < 32
    if (small or a == 172) and attempt < 4:
        head = [a, b]
    elif small and attempt < 8:
        head = [172, 16 + draw.below(16)]
    elif (small or a in (10, 127)) and attempt < 16:
        head = [10 if small else a]
    elif small or a in (10, 127):
        head = [240 + draw.below(16)]
    else:
        head = [1 + draw.below(223)]
    return head + [1 + draw.below(254) for _ in range(4 - len(head))]


def address6(entity: str, attempt: int, draw: Draw) -> str:
    """An IPv6 address with as many groups: link-local, unique local and
    documentation addresses stay such, others become global unicast ones.
    Late attempts fill all groups."""
    own = [int(g, 16) for g in ipaddress.IPv6Address(entity).exploded.split(":")]
    if own[0] == 0x2001 and own[1] == 0xDB8:
        head = own[:2]
    elif own[0] >> 6 == 0xFE80 >> 6 or own[0] >> 9 == 0xFC00 >> 9:
        head = own[:1]
    else:
        head = [0x2000 + draw.below(0x2000)]
    rest = [1] * (8 - len(head)) if attempt >= 8 else own[len(head) :]
    drawn = [1 + draw.below((0x10000 if attempt >= 4 else 16 ** len(f"{g:x}")) - 1) if g else 0 for g in rest]
    return str(ipaddress.IPv6Address(":".join(f"{g:x}" for g in head + drawn)))


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The ``attempt``-th surrogate of a canonical form, in canonical form."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "email":
        local, domain = entity.split("@", 1)
        labels = domain.split(".")
        base = f"example.{('com', 'org', 'net')[draw.below(3)]}"
        hosts = [draw.like(x) for x in labels[:-2]]
        return f"{draw.like(local)}{'' if attempt < 4 else draw.below(10 ** min(9, 5 + attempt // 4))}@{'.'.join([*hosts, base])}"
    if kind == "card":
        body = entity[0] + draw.like(entity[1:-1] + "0" * (attempt // 16))
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (last if luhn(entity) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        keep = max(0, len(entity) - 10)  # the country code
        return entity[:keep] + str(2 + draw.below(8)) + draw.like(entity[keep + 1 :] + "0" * (attempt // 8))
    if kind == "ssn":
        return draw.like(entity + "0" * (attempt // 16))
    if kind == "iban":
        rest = draw.like(entity[4:] + "0" * (attempt // 16))
        check = iban_check(entity[:2], rest)
        if not iban_valid(entity):
            check = f"{(int(check) + 1 + draw.below(96)) % 97:02d}"
        return entity[:2] + check + rest
    if kind == "ipv6":
        return address6(entity, attempt, draw)
    if kind == "ipv4" and attempt >= 64:  # no IPv4 address is free
        return address6("2001:db8::", attempt, draw)
    if kind == "ipv4":
        return ".".join(map(str, address([int(x) for x in entity.split(".")], attempt, draw)))
    if kind == "secret":
        return draw.like(entity + "a" * (attempt // 8), hexa=re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity) is not None)
    words = entity.split("-")
    group = next((_GROUP[w] for w in words if w in _GROUP), None)
    if group:
        return given_name(key, group, words, attempt, draw)
    letters = [c for c in entity if c.isalpha()]
    return draw.like(entity + "".join((letters * (1 + attempt // 4))[: attempt // 4 * 2]))


def dressed(kind: str, surface: str, new: str) -> str:
    """A surrogate in the format of the replaced text."""
    if kind in ("phone", "card", "ssn", "iban"):
        digits = iter(new)
        return "".join(next(digits) if c.isalnum() else c for c in surface) + "".join(digits)
    if kind == "ipv6" and surface.isupper():
        return new.upper()
    if kind in ("email", "name"):
        if surface.isupper() and len(surface) > 1:
            return new.upper()
        if kind == "name" and surface[:1].isupper():
            return re.sub(r"(^|[-'’])(\w)", lambda m: m[1] + m[2].title(), new)
    return new


_ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType())])


@F.pandas_udf(T.ArrayType(_ENTITY))
def _entities_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "entity": e} for k, e in sorted({x[2:] for x in entities(t)})])


@F.pandas_udf(T.BooleanType())
def _has_entity(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bool(entities(t))).astype(bool)


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate), all distinct, none an entity of the data.
    Every attempt after the first has fewer entities left, and room for more."""
    real = stored(found.select("kind", "entity").distinct())

    def drawn(pending: DataFrame, attempt: int) -> DataFrame:
        @F.pandas_udf(T.StringType())
        def draw(kind: pd.Series, entity: pd.Series) -> pd.Series:
            return pd.Series([surrogate(key, k, e, attempt) for k, e in zip(kind, entity)], dtype=object)

        return stored(pending.select("kind", "entity", draw("kind", "entity").alias("surrogate")))

    done, pending = None, real
    for attempt in count():
        new = drawn(pending, attempt)
        free = new.join(real.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate"))
        done = won if done is None else done.unionByName(won)
        pending = stored(pending.join(won, ["kind", "entity"], "left_anti"))
        if not pending.take(1):
            return done


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates, and ``n_entities``, the distinct entities of a text."""
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    own_mark, new = fresh(columns, "mark"), fresh(columns, "new")
    mark = F.md5(F.col(text_col).cast("binary"))
    dirty = docs.where(F.col(text_col).isNotNull() & _has_entity(text_col))
    listed = stored(dirty.select(mark.alias("mark"), _entities_of(text_col).alias("own")).dropDuplicates(["mark"]))
    each = listed.select("mark", F.explode("own").alias("e")).select("mark", "e.kind", "e.entity")
    table = stored(surrogates(each, key))
    # One text holds its own entities only, whatever the number of documents.
    maps = each.join(table, ["kind", "entity"]).groupBy("mark").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "entity"), "surrogate"))).alias(new)
    )

    @F.pandas_udf(T.StringType())
    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in batches:
            out = []
            for text, new in zip(texts, maps):
                new, at, parts = dict(new), 0, []
                for a, b, kind, entity in entities(text):
                    parts += [text[at:a], dressed(kind, text[a:b], new[f"{kind}\x1f{entity}"])]
                    at = b
                out.append("".join([*parts, text[at:]]))
            yield pd.Series(out, dtype=object)

    changed = dirty.withColumn(own_mark, mark).join(maps.withColumnRenamed("mark", own_mark), own_mark)
    changed = changed.withColumn(text_col, rewritten(F.col(text_col), F.col(new))).withColumn(
        "n_entities", F.size(new).cast("long")
    )
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    clean = docs.where(F.col(text_col).isNull() | ~_has_entity(text_col)).withColumn("n_entities", F.lit(0).cast("long"))
    return clean.unionByName(changed.select(*columns, "n_entities"))
