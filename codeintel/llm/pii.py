"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL functions only.

Personal values are validated and permuted within their format: an address stays
an address, a Luhn-valid number stays Luhn-valid, a date stays a date.  Each
format is a finite domain split in two parts, which eight keyed rounds add into
each other in turn; a round can be undone, so different values of a format never
meet, and equal values get the same pseudonym in every document and run with the
same key.

email   letters and digits of the part before @ (each within digits, a-z or A-Z)
phone   North American numbers; invalid area or exchange codes keep what makes
        them invalid and permute six digits
card    13-19 digits with a right Luhn digit (spaces and hyphens stay where they
        are); all but the last are permuted, the last is the new Luhn digit
ssn     ddd-dd-dddd with valid area, group and serial
ip      four octets
date    yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy, dd.mm.yyyy of 1900-2099, by day number

Every text is rebuilt from the pieces between the values; nothing is shuffled.

Edge cases: a null text stays null, an empty one empty; impossible dates and
other numbers stay; rows that repeat get equal results; other columns are kept
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "ymd": r"(?<![0-9/-])(?:19|20)[0-9]{2}([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9/-])",
    "dmy": r"(?<![0-9/.])(?:0[1-9]|[12][0-9]|3[01])([/.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}(?![0-9/])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
}
ALL = "|".join(PATTERNS.values())
ROUNDS = 8
KINDS = ("email", "ssn", "date", "phone", "card", "ip")


def _noise(key: str, tweak: str | Column, i: Column, x: Column) -> Column:
    """60 keyed bits of a round and the half it reads."""
    t = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), t, i.cast("string"), x.cast("string")), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(x: Column, left: Column, right: Column, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of 0 .. left * right - 1."""
    start = F.struct(_div(x, right).alias("a"), (x % right).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, (s["a"] + _noise(key, tweak, i, s["b"])) % left).otherwise(s["a"])
        b = F.when(even, s["b"]).otherwise((s["b"] + _noise(key, tweak, i, s["a"])) % right)
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, lambda s: s["a"] * right + s["b"])


def _div(x: Column, y: Column | int) -> Column:
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.split(digits, ""), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _luhn(payload: Column) -> Column:
    """The Luhn digit of a string of digits."""
    n = F.length(payload)
    total = F.aggregate(
        F.transform(F.split(payload, ""), lambda d, i: F.struct(d.cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice"))),
        F.lit(0),
        lambda s, x: s + F.when(~x["twice"], x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return (10 - total % 10) % 10


def _card(s: Column, key: str) -> Column:
    d = _digits(s)
    n = F.length(d)
    payload = F.substr(d, F.lit(1), n - 1)
    power = F.array(*[_long(10**k) for k in range(11)])
    right = F.element_at(power, _div(n - 1, 2).cast("int") + 1)
    left = F.element_at(power, (n - 1 - F.floor((n - 1) / 2)).cast("int") + 1)
    new = F.lpad(feistel(payload.cast("long"), left, right, key, F.concat(F.lit("card"), n.cast("string"))).cast("string"), n - 1, F.lit("0"))
    return _refill(s, F.concat(new, _luhn(new).cast("string")))


def _phone(s: Column, key: str) -> Column:
    d = F.right(_digits(s), F.lit(10))
    head = F.substr(_digits(s), F.lit(1), F.length(_digits(s)) - 10)
    area, exchange, line = (F.substr(d, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    x = ((area - 200) * 800 + (exchange - 200)) * 10000 + line
    y = feistel(x, _long(80000), _long(80000), key, "phone")
    rest = _div(y, 10000)
    valid = F.concat(_pad(_div(rest, 800) + 200, 3), _pad(rest % 800 + 200, 3), _pad(y % 10000, 4))
    other = F.concat(F.substr(d, F.lit(1), F.lit(4)), _pad(feistel(F.substr(d, F.lit(5), F.lit(6)).cast("long"), _long(1000), _long(1000), key, F.concat(F.lit("phone"), F.substr(d, F.lit(1), F.lit(4)))), 6))
    return _refill(s, F.concat(head, F.when((area >= 200) & (exchange >= 200), valid).otherwise(other)))


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substr(s, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    area0 = F.when(area > 666, area - 2).otherwise(area - 1)
    y = feistel((area0 * 99 + group - 1) * 9999 + serial - 1, _long(898 * 99), _long(9999), key, "ssn")
    top = _div(y, 9999)
    a = _div(top, 99)
    return F.concat_ws("-", _pad(F.when(a >= 665, a + 2).otherwise(a + 1), 3), _pad(top % 99 + 1, 2), _pad(y % 9999 + 1, 4))


def _ip(s: Column, key: str) -> Column:
    o = F.split(s, r"\.")
    x = F.aggregate(o, _long(0), lambda acc, v: acc * 256 + v.cast("long"))
    y = feistel(x, _long(65536), _long(65536), key, "ip")
    return F.concat_ws(".", *[F.shiftright(y, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])


def _day(date: Column, key: str) -> Column:
    """Another day of 1900-2099: 73,049 days are 319 x 229."""
    day = F.date_diff(date, F.lit("1900-01-01").cast("date")).cast("long")
    return F.date_add(F.lit("1900-01-01").cast("date"), feistel(day, _long(319), _long(229), key, "date").cast("int"))


def _date_of(s: Column, ymd: bool) -> Column:
    parts = ((1, 4), (6, 2), (9, 2)) if ymd else ((7, 4), (4, 2), (1, 2))
    return F.try_to_date(F.concat_ws("-", *[F.substr(s, F.lit(a), F.lit(n)) for a, n in parts]), "yyyy-MM-dd")


def _ymd(s: Column, key: str) -> Column:
    return F.regexp_replace(_day(_date_of(s, True), key).cast("string"), F.lit("-"), F.substr(s, F.lit(5), F.lit(1)))


def _dmy(s: Column, key: str) -> Column:
    sep, new = F.substr(s, F.lit(3), F.lit(1)), _day(_date_of(s, False), key).cast("string")
    return F.concat(F.substr(new, F.lit(9), F.lit(2)), sep, F.substr(new, F.lit(6), F.lit(2)), sep, F.substr(new, F.lit(1), F.lit(4)))


def _shift(part: Column, noise: Column) -> Column:
    """Each digit and letter moved within its class by a byte of ``noise``."""

    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substr(noise, (j % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        a = F.ascii(c)
        out = c
        for low, n in ((48, 10), (65, 26), (97, 26)):
            out = F.when((a >= low) & (a < low + n), F.chr((a - low + by) % n + low)).otherwise(out)
        return out

    return F.when(F.length(part) > 0, F.array_join(F.transform(F.split(part, ""), move), "")).otherwise(part)


def _email(s: Column, key: str) -> Column:
    local = F.substring_index(s, "@", 1)
    rest = F.substr(s, F.length(local) + 1)
    h = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), h).alias("a"), F.substr(local, h + 1).alias("b"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0

        def noise(v: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), v), 256)

        return F.struct(F.when(even, _shift(x["a"], noise(x["b"]))).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(_shift(x["b"], noise(x["a"]))).alias("b"))

    return F.concat(F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, step, lambda x: F.concat(x["a"], x["b"])), rest)


def kind_of(value: Column) -> Column:
    """Which format a match of ``ALL`` has; ``other`` for what doesn't validate."""
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), F.lit("ip"))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(value.rlike(r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$"), F.when(_date_of(value, True).isNotNull(), F.lit("ymd")).otherwise(F.lit("other")))
        .when(value.rlike(r"^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$"), F.when(_date_of(value, False).isNotNull(), F.lit("dmy")).otherwise(F.lit("other")))
        .when(n >= 13, F.when(_luhn(F.substr(digits, F.lit(1), n - 1)) == F.substr(digits, n, F.lit(1)).cast("int"), F.lit("card")).otherwise(F.lit("other")))
        .otherwise(F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = value
    for name, f in (("email", _email), ("ip", _ip), ("ssn", _ssn), ("ymd", _ymd), ("dmy", _dmy), ("card", _card), ("phone", _phone)):
        out = F.when(kind == name, f(value, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", out: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with ``out`` the pseudonymized text and ``found`` array<struct<kind, gap, value, pseudonym>>.

    gap: the characters of the original text since the previous value.  A column of
    the name ``found`` that ``docs`` has already is kept; the values then get that
    name and an underscore.
    """
    found_col, each_col, gaps_col = fresh(docs, found, "__each", "__gaps")
    text = F.col(text_col)
    hit = text.rlike(ALL)
    values = F.regexp_extract_all(text, F.lit(ALL), F.lit(0))
    gaps = F.split(text, ALL, -1)
    each = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(kind_of(v).alias("kind"), F.length(g).alias("gap"), v.alias("value")))
    none = F.array().cast("array<struct<kind:string,gap:int,value:string,pseudonym:string>>")
    named = F.transform(F.col(each_col), lambda x: F.struct(F.when(x["kind"].isin("ymd", "dmy"), F.lit("date")).otherwise(x["kind"]).alias("kind"), x["gap"].alias("gap"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym")))
    step1 = docs.withColumn(each_col, F.when(hit, each)).withColumn(gaps_col, F.when(hit, gaps))
    step2 = step1.withColumn(found_col, F.when(F.col(each_col).isNotNull(), named).otherwise(none))
    rebuilt = F.array_join(F.zip_with(gaps_col, found_col, lambda g, x: F.concat(g, F.coalesce(x["pseudonym"], F.lit("")))), "")
    return step2.withColumn(out, F.when(F.col(gaps_col).isNotNull(), rebuilt).otherwise(text)).drop(each_col, gaps_col)


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the pseudonymized text, and the number of values of each kind."""
    done = pseudonymize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), key)

    def count(k: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    counts = [count(k) for k in KINDS]
    return done.select("doc_id", "text", *counts)
