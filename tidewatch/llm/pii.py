"""Pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their format's validation are permuted within the format by a keyed Feistel
network, so a value has the same pseudonym in every document, and different values have different ones:

- payment cards: 13 to 19 digits, or groups of 4-4-4-4 or 4-6-5, with a right check digit; the digits before it are permuted, it is made anew
- telephone numbers: all digits but a country code in front; it and all punctuation stay
- IPv4 addresses: as two halves of 16 bits
- social security numbers: within valid areas (001 to 899 but 666), groups 01 to 99, serials 0001 to 9999
- dates from 1900 to 2099 as 2024-05-31, 31.05.2024 or 31/05/2024 (05/31/2024 where only that is a date)

Mail addresses have no such domain; they become a keyed digest in the form of an address. Digits that fail the
validation stay as they are.

Defined results: null text stays null, with 0 replacements; empty text stays empty; repeated rows get the same
result; an empty table gives an empty result; other columns pass through `pseudonymize` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 229 * 319  # the days of 1900 to 2099 as a product, for the two Feistel halves

EDGE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
IP = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.\d)"
DATE = rf"{EDGE}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}(?<ds>[./])\d{{2}}\k<ds>\d{{4}}){END}"
SSN = rf"{EDGE}\d{{3}}-\d{{2}}-\d{{4}}{END}"
PHONE = rf"(?:(?<![0-9A-Za-z+])\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|(?<![0-9A-Za-z(])\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}|{EDGE}\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}){END}"
CARD = rf"{EDGE}(?:\d{{13,19}}|\d{{4}}(?<cs>[ -])\d{{4}}\k<cs>\d{{4}}\k<cs>\d{{4}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}}){END}"
#: the first alternative that matches at a position wins
ANY = "|".join((EMAIL, IP, DATE, SSN, PHONE, CARD))


def _hash(key: str, tag: str, i: Column, v: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), v.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of [0, a) x [0, b), as struct(l, r): each round adds a hash of one half to the other."""
    long = lambda c: c.cast("long")
    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(i % 2 == 0, F.struct(F.pmod(l + _hash(key, tag, i, r) % a, a).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), F.pmod(r + _hash(key, tag, i, l) % b, b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(long(left).alias("l"), long(right).alias("r")), turn)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    s = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u), ten(u), ten(n - u), key, tag)
    # the pair is turned into text in one lambda, so that the rounds run once
    return F.transform(F.array(s), lambda p: F.concat(F.lpad(p["l"].cast("string"), u, "0"), F.lpad(p["r"].cast("string"), n - u, "0")))[0]


def check_digit(digits: Column) -> Column:
    """The digit that makes digits + it pass the checksum of payment cards."""
    chars = F.reverse(F.split(digits, ""))
    value = lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(chars, value), F.lit(0), lambda s, v: s + v)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _into(m: Column, digits: Column) -> Column:
    """The digits put into the places of the old ones."""
    start = F.struct(F.lit("").alias("out"), digits.alias("rest"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(s["rest"], 1, 1)).alias("out"), F.substring(s["rest"], F.lit(2), F.length(s["rest"])).alias("rest"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["rest"].alias("rest")))
    return F.aggregate(F.split(m, ""), start, step)["out"]


def _card(m: Column, key: str) -> Column:
    body = F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 1)
    new = permute_digits(body, key, "card")
    return F.when(check_digit(body) == F.substring(_digits(m), -1, 1), _into(m, F.concat(new, check_digit(new)))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays: the digits up to the first sign that is none; of a number without such signs, 1 digit
    after 1 or 7 (the zones of one digit), else 2. All other digits are permuted, however many there are."""
    d = _digits(m)
    code = F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))
    bare = F.when(F.substring(d, 1, 1).isin("1", "7"), 1).otherwise(2)
    kept = F.when(~m.startswith("+"), 0).when(code > 0, code).otherwise(bare)
    return _into(m, F.concat(F.substring(d, F.lit(1), kept), permute_digits(F.substring(d, kept + 1, F.length(d)), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    half = F.lit(65536).cast("long")
    s = feistel(F.element_at(o, 1) * 256 + F.element_at(o, 2), F.element_at(o, 3) * 256 + F.element_at(o, 4), half, half, key, "ip")
    part = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return F.transform(F.array(s), lambda p: F.concat_ws(".", part(p["l"]), part(p["r"])))[0]


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    n = F.when(area > 666, area - 2).otherwise(area - 1)
    s = feistel(n * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")
    def back(p: Column) -> Column:
        x = F.floor(p["l"] / 99)
        return F.concat_ws("-", F.lpad(F.when(x >= 665, x + 2).otherwise(x + 1).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))
    return F.when(valid, F.transform(F.array(s), back)[0]).otherwise(m)


def _date(m: Column, key: str) -> Column:
    out = m
    for fmt in ("MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"):  # the last that fits is asked first
        day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        s = feistel(F.floor(n / 319), n % 319, F.lit(229).cast("long"), F.lit(319).cast("long"), key, "date")
        days = F.transform(F.array(s), lambda p: (p["l"] * 319 + p["r"]).cast("int"))[0]
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), days), fmt)
        out = F.when(n.between(0, DAYS - 1), new).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@mail.invalid"))


def pseudonym(m: Column, key: str) -> Column:
    """What a match of ANY becomes."""
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key)).when(whole(rf"{OCTET}(?:\.{OCTET}){{3}}"), _ip(m, key)).when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}"), _date(m, key))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key)).when(F.length(_digits(m)) >= F.when(m.startswith("+") | m.startswith("("), F.lit(99)).otherwise(F.lit(13)), _card(m, key)).otherwise(_phone(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`docs` with personal data in text_col replaced; count_col, if given, gets the number of changed values.

    Text is cut at the matches, each match is mapped, and the parts are put together again: one pass a text,
    no shuffle.
    """
    text = F.col(text_col)
    # a text without digits or @ has no match
    worth = text.rlike("[0-9@]")
    found = F.when(worth, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = set(docs.columns) | {count_col}
    old, fresh = (next(n for n in (c + "_" * k for k in range(len(names) + 1)) if n not in names) for c in ("_found", "_new"))
    out = docs.withColumn(old, found)
    out = out.withColumn(fresh, F.transform(old, lambda m: pseudonym(m, key)))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.col(fresh), F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    changed = F.when(F.size(old) > 0, joined).otherwise(text)
    if count_col:
        n = F.size(F.filter(F.arrays_zip(F.col(old).alias("a"), F.col(fresh).alias("b")), lambda z: z["a"] != z["b"]))
        out = out.withColumn(count_col, F.coalesce(n, F.lit(0)).cast("long"))
    return out.withColumn(text_col, changed).drop(old, fresh)
