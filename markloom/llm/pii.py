"""Format-preserving pseudonyms for numbers, dates and addresses, by keyed Feistel permutations in Spark expressions.

Found and validated: card numbers (13 to 19 digits, Luhn), phone numbers, social security numbers, IPv4 addresses
(octets up to 255), calendar dates from 1900-01-01 on, and e-mail addresses. Each kind is permuted within its own
format: a card number keeps its grouping and gets a fresh check digit, a date stays a date of its notation, an address
stays an address, an e-mail address keeps its domain and its pattern of letters and digits. The permutation depends on
the key and the kind only, so equal values get equal pseudonyms in all documents, different ones different ones, and
the holder of the key can undo it (`undo=True`).

Only built-in expressions run: a text is split at its matches, the matches are mapped, and both are joined again. A
match that fails its validation stays as it is. Null text stays null and has no matches, and an empty one stays empty.
A text of any length is mapped whole. Only doc_id and text are read; rows are answered one by one, so nulls, repeats and
ties need no rule, and other columns keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and checks; production passes a secret.
KEY = "markloom-demo-key"

CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PATTERN = "|".join((DATE, ADDRESS, SSN, PHONE, CARD, EMAIL))
KINDS = ("date", "address", "ssn", "phone", "card", "email")

DAY_ZERO = "1900-01-01"
SIDE = 270  # dates are a SIDE x SIDE square of days: 1900-01-01 to 2099-08-04


def _noise(key: str, kind: str, turn: Column, value: Column, below: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string"), below.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), below)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, undo: bool) -> Column:
    """Permutes (left, right) of [0, a) x [0, b): the halves take turns in being shifted by a keyed hash of the other."""
    sign = -1 if undo else 1
    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        new_left = F.pmod(acc["l"] + sign * _noise(key, kind, i, acc["r"], a), a)
        new_right = F.pmod(acc["r"] + sign * _noise(key, kind, i, acc["l"], b), b)
        return F.struct(F.when(odd, new_left).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(new_right).alias("r"))

    return F.aggregate(turns, start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str, undo: bool) -> Column:
    """Permutes the strings of as many digits (2 to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    left = F.substr(digits, F.lit(1), half)
    right = F.substr(digits, half + 1, rest)
    done = feistel(left, right, _power(half), _power(rest), key, kind, undo)
    return F.concat(F.lpad(done["l"].cast("string"), half, F.lit("0")), F.lpad(done["r"].cast("string"), rest, F.lit("0")))


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(template, ""), start, put, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def card(x: Column, key: str, undo: bool) -> Column:
    digits = _digits(x)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    fresh = permute_digits(body, key, "card", undo)
    return F.aggregate(F.array(fresh), x, lambda _, p: _fill(x, F.concat(p, F.element_at(F.filter(F.array(*map(F.lit, "0123456789")), lambda c: F.call_function("luhn_check", F.concat(p, c))), 1))))


def plain(kind: str):
    """Every digit after a country code is permuted."""

    def run(x: Column, key: str, undo: bool) -> Column:
        code = F.regexp_extract(x, r"^\+[0-9]{1,2}(?=[ .(-])", 0)
        rest = F.substr(x, F.length(code) + 1, F.length(x))
        return F.concat(code, _fill(rest, permute_digits(_digits(rest), key, kind, undo)))

    return run


def address(x: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    at = lambda k: F.get(octets, F.lit(k))
    side = F.lit(65536).cast("long")
    done = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), side, side, key, "address", undo)
    out = F.aggregate(F.array(done), F.lit(""), lambda _, d: F.concat_ws(".", F.shiftright(d["l"], 8), d["l"].bitwiseAND(255), F.shiftright(d["r"], 8), d["r"].bitwiseAND(255)))
    # an octet has to come back as it was written
    return F.when(F.forall(F.split(x, r"\."), lambda o: (o.cast("int") <= 255) & (o == o.cast("int").cast("string"))), out).otherwise(x)


def date(x: Column, key: str, undo: bool) -> Column:
    out = x
    side = F.lit(SIDE).cast("long")
    for shape, notation in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d\d/", "MM/dd/yyyy"), (r"^\d\d\.", "dd.MM.yyyy")):
        day = F.datediff(F.try_to_timestamp(x, F.lit(notation)).cast("date"), F.lit(DAY_ZERO).cast("date"))
        done = feistel(F.floor(day / SIDE), F.pmod(day, F.lit(SIDE)), side, side, key, "date", undo)
        text = F.aggregate(F.array(done), F.lit(""), lambda _, d: F.date_format(F.date_add(F.lit(DAY_ZERO).cast("date"), (d["l"] * SIDE + d["r"]).cast("int")), notation))  # noqa: B023
        out = F.when(x.rlike(shape), F.when(day.between(0, SIDE * SIDE - 1), text).otherwise(x)).otherwise(out)
    return out


def _shift(half: Column, other: Column, turn: Column, key: str, sign: int) -> Column:
    """Letters move within their case and digits among digits, by a keyed hash of the other half; the rest stays."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), other), 512)
    chars = F.filter(F.split(half, ""), lambda c: c != "")

    def move(c: Column, i: Column) -> Column:
        by = sign * F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turned = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(n)))
        return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

    return F.array_join(F.transform(chars, move), "")


def email(x: Column, key: str, undo: bool) -> Column:
    sign = -1 if undo else 1
    name = F.substring_index(x, "@", 1)
    half = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substr(name, F.lit(1), half).alias("l"), F.substr(name, half + 1, F.length(name)).alias("r"))
    turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))

    def turn(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, _shift(acc["l"], acc["r"], i, key, sign)).otherwise(acc["l"]).alias("l"), F.when(odd, acc["r"]).otherwise(_shift(acc["r"], acc["l"], i, key, sign)).alias("r"))

    return F.aggregate(turns, start, turn, lambda acc: F.concat(acc["l"], acc["r"], F.lit("@"), F.substring_index(x, "@", -1)))


def kind_of(x: Column) -> Column:
    """The kind of a match of PATTERN; null if it fails its validation."""
    digits = _digits(x)
    whole = lambda p: x.rlike(f"^(?:{p})$")
    return (
        F.when(x.contains("@"), "email")
        .when(whole(DATE), "date")
        .when(whole(ADDRESS), "address")
        .when(whole(SSN), "ssn")
        .when(whole(PHONE), "phone")
        .when(F.length(digits).between(13, 19), F.when(F.call_function("luhn_check", digits), "card"))
    )


def pseudonym(x: Column, key: str = KEY, undo: bool = False) -> Column:
    kind = kind_of(x)
    forms = {"card": card, "phone": plain("phone"), "ssn": plain("ssn"), "address": address, "date": date, "email": email}
    out = x
    for name, form in forms.items():
        out = F.when(kind == name, form(x, key, undo)).otherwise(out)
    return F.coalesce(out, x)


def pseudonymise(docs: DataFrame, key: str = KEY, undo: bool = False) -> DataFrame:
    """docs with __found (value, kind, pseudonym of each match that passed) and __text (the text with pseudonyms)."""
    pattern = F.lit(PATTERN)
    text = F.col("text").cast("string")
    found = F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>"))
    each = F.transform("__values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"), pseudonym(v, key, undo).alias("pseudonym")))
    woven = F.array_join(F.transform(F.arrays_zip(F.split(text, PATTERN, -1).alias("part"), F.transform("__each", lambda e: e["pseudonym"]).alias("put")), lambda z: F.concat(z["part"], F.coalesce(z["put"], F.lit("")))), "")
    out = docs.withColumn("__values", found).withColumn("__each", F.when(F.size("__values") > 0, each))
    out = out.withColumn("__text", F.when(F.col("__each").isNotNull(), woven).otherwise(text))
    out = out.withColumn("__found", F.coalesce(F.filter("__each", lambda e: e["kind"].isNotNull() & (e["value"] != e["pseudonym"])), F.expr("cast(array() as array<struct<value:string,kind:string,pseudonym:string>>)")))
    return out.drop("__values", "__each")


def digest(done: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("__found", lambda e: e["kind"] == k)).cast("long")
    return done.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS),
        F.size("__found").cast("long").alias("n_replaced"),
        F.array_join(F.transform("__found", lambda e: e["pseudonym"]), ",").alias("pseudonyms"),
        F.sha2(F.coalesce(F.col("__text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
