"""PII: format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions alone.

Found are e-mail addresses, IBANs (remainder 1 modulo 97), IPv4 addresses, calendar dates from 1900 to 2099, phone numbers,
payment card numbers (13 to 19 digits that pass the Luhn check) and US social security numbers. A value that doesn't pass
its kind's check is left alone. Any other is replaced by a value of the same format that passes the check as well:

* digits and letters are permuted by a Feistel network over the two halves of the value's characters, each shifted within
  its class (0-9, a-z, A-Z) by SHA-256 of key, kind, round and the other half; this is a bijection for any length;
* card numbers and IBANs get their check digits anew;
* ten-digit phone numbers, social security numbers, dates (as days) and IPv4 addresses are numbered within their class, and the
  network permutes the pairs of a quotient and a remainder of that number, of moduli whose product is the class's size; so
  every result is of the class, and no walk has to look for one.

The result depends on key, kind and value alone, so equal values have equal pseudonyms in every document and run, and
different values different ones (save for dates that may be read either way: they are what they are read as). Separators
stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For tests and examples; production passes a secret of its own.
KEY = "example key"
ROUNDS = 8
KINDS = ("email", "iban", "ipv4", "date", "phone", "ssn", "card")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters of an IBAN, and the countries that have so many.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: Groups of four digits, and at most three more, but not the head of a date, a phone or social security number or an address.
_FOUR = r"[0-9]{4}(?![0-9]|[./-][0-9]{2}[./-][0-9]{2}(?![0-9]))"
_FEW = r"[0-9]{1,3}(?![0-9]|[ .-][0-9]{3}[ .-][0-9]{4}|-[0-9]{2}-[0-9]{4}|[./-][0-9]{2}[./-](?:19|20)[0-9]{2}|\.[0-9]{1,3}\.[0-9])"
_COUNTRY = r"^\+[0-9]{1,3}(?![0-9])|^1(?=[ .-])|^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Loops over groups are possessive: Java's matcher goes through the others by recursion, which long texts would carry beyond its stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([./-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|(?<![0-9+]))\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.+-])(?:1[ .-])?[0-9]{3}([ .-])[0-9]{3}\3[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{7,14}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -]{_FOUR}){{2,}}+(?:[ -]{_FEW})?+|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}})(?![0-9])",
}
CARD_DIGITS = (13, 19)
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: What every kind has.
MAY = r"[0-9]{2}|@"
FIRST_DAY = "1900-01-01"
#: Days of the years 1900 to 2099; numbers that are dialable in North America (NXX-NXX-XXXX, N from 2), other ten-digit ones;
#: social security numbers (areas without 000, 666 and those from 900 on, groups and serials without 0). Each as a product.
DAY_PAIR, DIALABLE_PAIR, OTHER_PAIR, SSN_PAIR = (17, 4297), (640_000, 10_000), (60_000, 60_000), (898 * 99, 9999)


def _material(key: str, kind: str, i: Column, other: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|")), 256))


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("bigint")


def _shift(part: Column, material: Column) -> Column:
    """Each digit and letter of part is moved on within its class."""

    def one(c: Column, j: Column) -> Column:
        code, by = F.ascii(c), _number(F.substring(material, 1 + 4 * F.pmod(j, F.lit(32)), F.lit(4)))
        out = c
        for low, high, n in ((48, 57, 10), (97, 122, 26), (65, 90, 26)):
            out = F.when(code.between(low, high), F.chr(low + F.pmod(code - low + by, F.lit(n)))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(part, ""), one), "")


def feistel(value: Column, key: str, kind: str) -> Column:
    """value with its digits and letters permuted; a bijection on the values of the same length and classes."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shift(acc["l"], _material(key, kind, i, acc["r"]))).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(_shift(acc["r"], _material(key, kind, i, acc["l"]))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def feistel_pair(u: Column, v: Column, nu: int, nv: int, key: str, kind: str, finish: Callable[[Column], Column]) -> Column:
    """A permutation of [0, nu) x [0, nv)."""
    moved = lambda x, i, other, n: F.pmod(x + _number(F.substring(_material(key, kind, i, other.cast("string")), 1, 12)), F.lit(n))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(acc["u"], i, acc["v"], nu)).otherwise(acc["u"]).alias("u"), F.when(even, acc["v"]).otherwise(moved(acc["v"], i, acc["u"], nv)).alias("v"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(u.cast("bigint").alias("u"), v.cast("bigint").alias("v")), step, finish)


def permuted(number: Column, pair: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of the numbers below the product of the pair."""
    return feistel_pair(F.floor(number / pair[1]), F.pmod(number, F.lit(pair[1])), *pair, key, kind, lambda acc: acc["u"] * pair[1] + acc["v"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def render(shape: Column, symbols: Column, pattern: str = "[0-9]") -> Column:
    """shape with its characters of the pattern replaced by those of symbols, in order."""
    at = lambda j: F.length(F.regexp_replace(F.substring(shape, F.lit(1), j + 1), f"[^{pattern[1:]}", ""))
    return _let(symbols, lambda own: F.array_join(F.transform(F.split(shape, ""), lambda c, j: F.when(c.rlike(f"^{pattern}$"), F.substring(own, at(j), F.lit(1))).otherwise(c)), ""))


def luhn_sum(digits: Column, payload: bool) -> Column:
    """The Luhn sum of a number, or of one whose check digit is still to come."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["s"] + F.when(acc["odd"], twice).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(payload).alias("odd")), step, lambda acc: acc["s"])


def _mod97(text: Column) -> Column:
    """Of a string of digits and capitals, the latter as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(acc * 100 + code - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    own = feistel(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    check = 98 - _mod97(F.concat(own, F.substring(plain, 1, 2), F.lit("00")))
    return F.when(_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, render(m, F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), own), "[A-Z0-9]"))


def _ipv4(m: Column, key: str) -> Column:
    o = [F.element_at(F.split(m, r"\."), i).cast("bigint") for i in (1, 2, 3, 4)]
    octets = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "ipv4", lambda acc: F.concat_ws(".", *octets(acc["u"]), *octets(acc["v"])))


def _date(m: Column, key: str) -> Column:
    """yyyy-mm-dd, or dd.mm.yyyy; with slashes dd/mm/yyyy if that is a date, else mm/dd/yyyy."""
    year_first, d = F.substring(m, 5, 1).rlike("[^0-9]"), _digits(m)
    year = F.when(year_first, F.substring(d, 1, 4)).otherwise(F.substring(d, 5, 4))
    a, b = F.when(year_first, F.substring(d, 5, 2)).otherwise(F.substring(d, 1, 2)), F.when(year_first, F.substring(d, 7, 2)).otherwise(F.substring(d, 3, 2))
    iso = lambda month, day: F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    normal = F.when(year_first, iso(a, b)).otherwise(iso(b, a))
    swapped = F.when(~year_first & F.substring(m, 3, 1).isin("/"), iso(a, b))
    number = F.datediff(F.coalesce(normal, swapped), F.lit(FIRST_DAY).cast("date"))
    new = permuted(number.cast("bigint"), DAY_PAIR, key, "date")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int"))
    shape = F.when(year_first, F.date_format(day, "yyyyMMdd")).when(normal.isNotNull(), F.date_format(day, "ddMMyyyy")).otherwise(F.date_format(day, "MMddyyyy"))
    return F.when(number.isNotNull(), render(m, shape))


def _part(x: Column, at: int, n: int) -> Column:
    return F.substring(x, at, n).cast("bigint")


def _padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _dialable(x: Column, key: str) -> Column:
    number = ((_part(x, 1, 3) - 200) * 800 + _part(x, 4, 3) - 200) * 10_000 + _part(x, 7, 4)
    return _let(permuted(number, DIALABLE_PAIR, key, "phone"), lambda y: F.concat((F.floor(y / 8_000_000) + 200).cast("string"), (F.pmod(F.floor(y / 10_000), F.lit(800)) + 200).cast("string"), _padded(F.pmod(y, F.lit(10_000)), 4)))


def _not_dialable(x: Column, key: str) -> Column:
    """First those that begin with 0 or 1, then those with 0 or 1 in the fourth place."""
    number = F.when(_part(x, 1, 1) < 2, x.cast("bigint")).otherwise(2_000_000_000 + (_part(x, 1, 3) - 200) * 2_000_000 + _part(x, 4, 7))
    late = lambda y: F.concat((F.floor((y - 2_000_000_000) / 2_000_000) + 200).cast("string"), _padded(F.pmod(y - 2_000_000_000, F.lit(2_000_000)), 7))
    return _let(permuted(number, OTHER_PAIR, key, "other phone"), lambda y: F.when(y < 2_000_000_000, _padded(y, 10)).otherwise(late(y)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays. Ten-digit numbers that are dialable in North America stay so, and others stay others."""
    code = F.regexp_extract(m, _COUNTRY, 0)
    shape = F.substring(m, F.length(code) + 1, F.length(m))
    number = _digits(shape)
    new = F.when(number.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), _dialable(number, key)).when(F.length(number) == 10, _not_dialable(number, key)).otherwise(feistel(number, key, "phone"))
    return F.concat(code, render(shape, new))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area = _part(d, 1, 3)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + _part(d, 4, 2) - 1) * 9999 + _part(d, 6, 4) - 1

    def shown(y: Column) -> Column:
        rank = F.floor(y / (99 * 9999))
        return F.concat(_padded(rank + F.when(rank >= 665, 2).otherwise(1), 3), _padded(F.pmod(F.floor(y / 9999), F.lit(99)) + 1, 2), _padded(F.pmod(y, F.lit(9999)) + 1, 4))

    return F.when(d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"), render(m, _let(permuted(number, SSN_PAIR, key, "ssn"), shown)))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    payload = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(payload, True) % 10, F.lit(10)).cast("string")
    return F.when(F.length(digits).between(*CARD_DIGITS), F.when(luhn_sum(digits, False) % 10 == 0, render(m, F.concat(payload, check))))


_BY_KIND = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        own = PATTERNS[kind].replace(r"\3", r"\1")  # of groups in ANY
        out = F.when(m.rlike(rf"^(?:{own})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of a match, or null if it fails its kind's check."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(kind_of(m) == kind, _BY_KIND[kind](m, key)).otherwise(out)
    return out


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _piece(value: Column, own: bool) -> Column:
    return F.struct(value.alias("value"), F.lit(own).alias("own"))


_PARTS = "array<struct<value: string, own: boolean>>"


def _cards_in(m: Column) -> Column:
    """Parts of groups of four digits (the last may be shorter): from each group on, the longest number that passes the check.

    A match may be a whole text of groups, so each is cut out once, and only the numbers that pass are gathered.
    """

    def text(groups: Column, i: Column, k: Column) -> Column:  # k groups with what stands before each
        return F.array_join(F.slice(groups, i + 1, k), "")

    def picks(groups: Column) -> Column:
        def valid(i: Column, k: Column) -> Column:
            return _let(_digits(text(groups, i, k)), lambda d: F.length(d).between(*CARD_DIGITS) & (luhn_sum(d, False) % 10 == 0))

        longest = lambda i: F.array_max(F.filter(F.array(F.lit(4), F.lit(5)), lambda k: F.when(i + k <= F.size(groups), valid(i, k)).otherwise(False)))
        starts = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.struct(i.alias("i"), longest(i).alias("k")))
        start = F.struct(F.array().cast("array<struct<i: int, k: int>>").alias("own"), F.lit(0).alias("next"))
        step = lambda acc, s: F.when(s["i"] >= acc["next"], F.struct(F.concat(acc["own"], F.array(s)).alias("own"), (s["i"] + s["k"]).alias("next"))).otherwise(acc)
        return F.aggregate(F.filter(starts, lambda s: s["k"].isNotNull()), start, step, lambda acc: acc["own"])

    def cut(groups: Column, own: Column, ends: Column) -> Column:
        lead = lambda i: F.when(i > 0, F.substring(F.get(groups, i), 1, 1)).otherwise("")
        bare = lambda p: F.regexp_replace(text(groups, p["i"], p["k"]), "^[ -]", "")
        each = F.transform(own, lambda p, j: F.array(_piece(F.concat(text(groups, F.get(ends, j), p["i"] - F.get(ends, j)), lead(p["i"])), False), _piece(bare(p), True)))
        rest = _let(F.element_at(ends, -1), lambda end: F.array(_piece(text(groups, end, F.size(groups) - end), False)))
        return F.when(F.size(own) > 0, F.concat(F.flatten(each), rest)).otherwise(F.array().cast(_PARTS))

    ends = lambda own: F.concat(F.array(F.lit(0)), F.transform(own, lambda p: p["i"] + p["k"]))
    return _let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), lambda groups: _let(picks(groups), lambda own: _let(ends(own), lambda e: cut(groups, own, e))))


def _iban_in(m: Column) -> Column:
    """Parts: the longest run of words from the first on that passes the check, and what follows it."""
    words = F.split(m, " ")
    passes = lambda x: (F.length(x) >= 12) & (_mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1)
    ends = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: passes(F.array_join(F.slice(words, F.lit(1), i), "")))
    cut = lambda i: _let(F.array_join(F.slice(words, F.lit(1), i), " "), lambda head: F.array(_piece(head, True), _piece(F.substring(m, F.length(head) + 1, F.length(m)), False)))
    return _let(F.array_max(ends), lambda i: F.when(i.isNotNull(), cut(i)).otherwise(F.array().cast(_PARTS)))


def pieces(m: Column, key: str = KEY) -> Column:
    """A match as an array of value, kind and pseudonym, whose values make up the match: the match itself, unless only a part of it passes its check."""
    parts = F.when(m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){2}[ -]"), _cards_in(m)).when(m.rlike("^[A-Z]{2}[0-9]{2}.* "), _iban_in(m)).otherwise(F.array().cast(_PARTS))
    chosen = _let(parts, lambda ps: F.when(F.exists(ps, lambda p: p["own"]), ps).otherwise(F.array(_piece(m, True))))
    return F.transform(chosen, lambda p: F.struct(p["value"].alias("value"), F.when(p["own"], kind_of(p["value"])).alias("kind"), F.when(p["own"], pseudonym(p["value"], key)).alias("pseudonym")))


def found(text: Column, key: str = KEY) -> Column:
    """For each match in the order of the text, its pieces; null if nothing can be PII."""
    return F.when(text.rlike(MAY), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pieces(m, key)))


def pseudonymize(docs: DataFrame, key: str = KEY, column: str = "pii") -> DataFrame:
    """docs with the text replaced, and a column: an array of value, kind and pseudonym (null: left alone) of what was found.

    A null text stays null. Every column is passed through, save for one with the name of the new one, which is replaced. Rows are handled on
    their own: repeated rows have equal results, and an empty table gives none. It needs no shuffle.
    """
    listed = docs.withColumn(column, found(F.col("text"), key))
    told = F.col(f"`{column}`")
    gaps = F.split("text", ANY, -1)
    values = F.concat(F.transform(told, lambda ps: F.array_join(F.transform(ps, lambda p: F.coalesce(p["pseudonym"], p["value"])), "")), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, values, lambda gap, v: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(v, F.lit("")))), "")
    kept = F.filter(F.flatten(told), lambda p: p["kind"].isNotNull())
    return listed.withColumns({"text": F.when(F.size(told) > 0, joined).otherwise(F.col("text")), column: kept})
