"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their own check (Luhn digit, octets, calendar, number plan) are permuted by a keyed Feistel
network over exactly the values of their format: the halves are added to modulo the sizes of the two parts, so that the
permutation needs no power of two and gives a valid value of the same format. Equal values get equal pseudonyms in every
document, other values of a format others; of slashed dates, those that are read alike (see below). Mail addresses and secrets have no number to permute; a keyed digest stands for them.

Formats: payment cards (first digit kept, check digit made anew), telephone numbers (after +1 by the North American plan,
those outside it among themselves, else all digits after the first two), IPv4 addresses, social security numbers (area, group and serial stay in their ranges),
dates of 1700 to 2099 as y-m-d, with a dot or an over-12 first number as d.m.y, otherwise as m/d/y.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The patterns of the formats.
_PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}[\"']?",
    r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    r"(?<![A-Za-z0-9-])[12][0-9]{3}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9./-])[0-9]{1,2}([./])[0-9]{1,2}\1[12][0-9]{3}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9+(])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9])",
    # Groups of digits, 13 digits at least, up to a group where mail, address, date or number of another format begins.
    r"(?<![A-Za-z0-9.])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -](?!{OTHER})[0-9]++(?![A-Za-z]))*+",
)
_OTHER = "|".join((*_PATTERNS[:1], *_PATTERNS[3:5], *(_PATTERNS[5].replace(r"([./])", mark).replace(r"\1", mark) for mark in (r"\.", "/")), *_PATTERNS[6:7], *_PATTERNS[8:9]))
PATTERN = "|".join(_PATTERNS).replace("{OTHER}", f"(?:{_OTHER})")
#: Where cards may stand in such groups: in the groupings that cards have, from any group on, and in the longest spans of any grouping.
_CARDS = (
    *(rf"(?<![0-9])(?=({body})(?![0-9]))" for body in ("[ -]".join(f"[0-9]{{{n}}}" for n in sizes) for sizes in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), ("13,19",)))),
    r"(?<![0-9])([0-9](?:[ -]?[0-9]){12,18})(?![0-9])",
)
#: What any of the patterns needs; most texts end here.
_CUE = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api[_-]?key)"


def feistel(left: Column, right: Column, size_left, size_right, key: str, tag: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs below (size_left, size_right)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (size_left, size_right))

    def draw(i: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string"), a.cast("string"), b.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + draw(i, s["r"], a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + draw(i, s["l"], b), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _part(digits: Column, first, size) -> Column:
    first, size = (x if isinstance(x, Column) else F.lit(x) for x in (first, size))
    return F.substring(digits, first, size).cast("long")


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0" if isinstance(width, int) else F.lit("0"))


def _ten_to(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def _refill(match: Column, digits: Column) -> Column:
    """The match with its digits replaced one by one; all else stays where it is."""
    filled = F.transform(
        F.sequence(F.lit(1), F.length(match)),
        lambda i: F.when(F.substring(match, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(match, F.lit(1), i))), F.lit(1))).otherwise(F.substring(match, i, F.lit(1))),
    )
    return F.array_join(filled, "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of the digits from the right, the last being doubled or not."""
    n = F.length(digits)
    odd = 0 if doubled_first else 1
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0).cast("long"),
        lambda s, i: s + _let(_part(digits, n - i + 1, 1) * F.when((i + odd) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    a = F.floor((n - 2) / 2).cast("int")
    b = n - 2 - a
    pair = feistel(_part(d, 2, a), _part(d, a + 2, b), _ten_to(a), _ten_to(b), key, "card")
    body = _let(pair, lambda s: F.concat(F.substring(d, 1, 1), _padded(s["l"], a), _padded(s["r"], b)))
    whole = _let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(x, True) % 10, F.lit(10)).cast("string")))
    return _refill(m, whole)


def _is_card(m: Column) -> Column:
    return _let(_digits(m), lambda d: d.rlike("^[2-6]") & F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0))


def _cards(m: Column, key: str) -> Column:
    """struct(new, n): the groups of digits with the pseudonyms of all cards among them, and their number; of cards that overlap the first in the order of `_CARDS` stays."""
    spans = F.array_distinct(F.concat(*(F.regexp_extract_all(m, F.lit(p), F.lit(1)) for p in _CARDS)))

    def put(s: Column, card: Column) -> Column:
        place = F.concat(F.lit("(?<![0-9#])"), card, F.lit("(?![0-9#])"))
        return F.when(F.rlike(s["rest"], place), F.struct(F.regexp_replace(s["new"], place, _card(card, key)).alias("new"), F.regexp_replace(s["rest"], place, F.regexp_replace(card, "[0-9]", "#")).alias("rest"), (s["n"] + F.regexp_count(s["rest"], place)).alias("n"))).otherwise(s)

    start = F.struct(m.alias("new"), m.alias("rest"), F.lit(0).alias("n"))
    return F.aggregate(F.filter(spans, _is_card), start, put)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    country = F.when(m.startswith("+"), F.substring(d, 1, 1)).otherwise("")
    own = F.when(m.startswith("+"), F.substring(d, F.lit(2), F.length(d))).otherwise(d)
    american = ~m.startswith("+") | ((F.length(d) == 11) & (country == "1"))
    pair = feistel((_part(own, 1, 1) - 2) * 100 + _part(own, 2, 2), (_part(own, 4, 1) - 2) * 1000000 + _part(own, 5, 6), 800, 8000000, key, "nanp")
    planned = _let(pair, lambda s: F.concat(country, (s["l"] + 200).cast("string"), (s["r"] + 2000000).cast("string")))
    # numbers after +1 that the plan does not allow are permuted among themselves, so that no two of all +1 numbers meet
    outside = feistel((_part(own, 1, 1) - 2) * 100 + _part(own, 2, 2), _part(own, 4, 7), 800, 2000000, key, "nanp-outside")
    unplanned = _let(outside, lambda s: F.concat(country, (s["l"] + 200).cast("string"), _padded(s["r"], 7)))
    n = F.length(d) - 2
    a = F.floor(n / 2).cast("int")
    other = feistel(_part(d, 3, a), _part(d, a + 3, n - a), _ten_to(a), _ten_to(n - a), key, "phone")
    plain = _let(other, lambda s: F.concat(F.substring(d, 1, 2), _padded(s["l"], a), _padded(s["r"], n - a)))
    new = F.when(american & own.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), planned).when(american & own.rlike("^[2-9][0-9]{2}[01][0-9]{6}$"), unplanned).otherwise(plain)
    return _refill(m, new)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    parts = _let(pair, lambda s: F.concat_ws(".", *((x.cast("string")) for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))))
    return F.when(F.forall(o, lambda x: x <= 255), parts)


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area, group, serial = _part(d, 1, 3), _part(d, 4, 2), _part(d, 6, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    at = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(at * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def say(s: Column) -> Column:
        new = F.floor(s["l"] / 99) + 1
        return F.concat_ws("-", _padded(new + F.when(new >= 666, 1).otherwise(0), 3), _padded(s["l"] % 99 + 1, 2), _padded(s["r"] + 1, 4))

    return F.when(valid, _let(pair, say))


def _date(m: Column, key: str) -> Column:
    """146,097 days from 1700-01-01 on are 400 years to the day: 189 times 773."""
    p = F.split(m, r"[./-]")
    iso = F.length(p[0]) == 4
    by_day = m.contains(".") | (p[0].cast("int") > 12)
    y, mo, d = F.when(iso, p[0]).otherwise(p[2]), F.when(iso, p[1]).when(by_day, p[1]).otherwise(p[0]), F.when(iso, p[2]).when(by_day, p[0]).otherwise(p[1])
    day = F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    index = F.datediff(day, F.lit("1700-01-01").cast("date")).cast("long")
    pair = feistel(F.floor(index / 773), index % 773, 189, 773, key, "date")
    new = _let(pair, lambda s: F.date_add(F.lit("1700-01-01").cast("date"), (s["l"] * 773 + s["r"]).cast("int")))

    def say(x: Column) -> Column:
        two = lambda part, like: F.when(F.length(like) == 2, F.lpad(part.cast("string"), 2, "0")).otherwise(part.cast("string"))
        year, month, dom = F.year(x).cast("string"), F.month(x), F.dayofmonth(x)
        mark = F.when(m.contains("."), ".").otherwise("/")
        return F.when(iso, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(dom.cast("string"), 2, "0"))).when(by_day, F.concat(two(dom, p[0]), mark, two(month, p[1]), mark, year)).otherwise(F.concat(two(month, p[0]), mark, two(dom, p[1]), mark, year))

    return F.when(index.between(0, 146096), _let(new, say))


def _hex(key: str, tag: str, value: Column, size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), value), 256), 1, size)


def _email(m: Column, key: str) -> Column:
    own = F.lower(m)
    return F.concat(F.lit("u"), _hex(key, "mail", own, 12), F.lit("@d"), _hex(key, "domain", F.substring_index(own, "@", -1), 8), F.lit(".invalid"))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)", 0)
    tail = F.regexp_extract(m, r"[\"']?$", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    digest = F.concat(_hex(key, "secret", value, 64), _hex(key, "secret2", value, 64))
    new = F.substring(digest, F.lit(1), F.least(F.length(value), F.lit(128)))
    return F.concat(head, F.when(head == "AKIA", F.upper(new)).otherwise(new), tail)


def _replaced(m: Column, key: str) -> Column:
    """struct(kind, new, n): new is null where the match is not valid in its format; n values of the kind stand in it."""
    kinds = (
        ("email", m.contains("@"), _email(m, key)),
        ("secret", m.rlike("^(?:AKIA|[a-zA-Z])"), _secret(m, key)),
        ("ip", m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), _ip(m, key)),
        ("date", m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})$"), _date(m, key)),
        ("ssn", m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key)),
        ("phone", m.rlike(r"^[+(]|^[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"), _phone(m, key)),
    )
    kind, new = F, F
    for name, test, value in kinds:
        kind, new = kind.when(test, F.lit(name)), new.when(test, value)
    other = functools.reduce(lambda a, b: a | b, (test for _, test, _ in kinds))
    cards = F.when(~other, _cards(m, key))
    return _let(cards, lambda c: F.struct(kind.otherwise("card").alias("kind"), new.otherwise(F.when(c["n"] > 0, c["new"])).alias("new"), F.coalesce(c["n"], F.lit(1)).alias("n")))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with pseudonyms, n_pii, kinds in text order) of each row. A null text stays null with nothing found.

    The key is a secret of the caller: who has it can turn pseudonyms back. The same key gives the same pseudonyms in every
    run. Matches that are not valid in
    their format (a card without its check digit, an octet over 255) are no personal data and stay.
    """
    text = F.col(text_col)
    none = F.array().cast("array<string>")
    cued = F.coalesce(text.rlike(_CUE), F.lit(False))
    found = docs.select(F.col(id_col), text.alias("text"), F.when(cued, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none).alias("__m"))
    said = found.select(id_col, "text", "__m", F.transform("__m", lambda m: _replaced(m, key)).alias("__r"))
    new = F.concat(F.zip_with("__m", "__r", lambda m, r: F.coalesce(r["new"], m)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split("text", PATTERN, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    kinds = F.flatten(F.transform(F.filter("__r", lambda r: r["new"].isNotNull()), lambda r: F.array_repeat(r["kind"], r["n"])))
    return said.select(id_col, F.when(F.size("__m") > 0, joined).otherwise(F.col("text")).alias("text"), F.size(kinds).cast("long").alias("n_pii"), kinds.alias("kinds"))
