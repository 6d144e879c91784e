"""Pseudonyms for personal data that keep its format.

Method: e-mail addresses, telephone, card, bank account and social security numbers, IPv4 addresses and dates are found,
validated (Luhn, modulo 97, number ranges, calendar) and replaced by a keyed permutation of values of the same format: a Feistel
network whose round function is a SHA-256 of key, round and other half. Letters stay letters of their case, digits
digits, separators stay; check digits are computed anew; dates stay dates. Equal values get equal
pseudonyms in every document. What fails validation stays as it is. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

EDGE, STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: kind: pattern, in order of precedence at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": EDGE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + STOP,
    "ipv4": r"(?<![\p{L}\p{N}.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[\p{L}\p{N}])",
    "date": EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + STOP,
    "ssn": EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + STOP,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}" + STOP + r"|(?<![\p{L}\p{N}+])\+[0-9]{8,15}" + STOP,
    "card": EDGE + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + STOP,
}
#: \1 of the card pattern is the only group of the whole.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Alphabets whose letters are permuted among themselves.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]


def digest_number(key: str, *parts: Column) -> Column:
    """48 bits of the round function as a long."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256), F.lit(12)), 16, 10).cast("long")


def shifted(half: Column, other: Column, key: str, turn: Column) -> Column:
    """half with each character moved in its alphabet by a keyed amount that depends on the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), turn, F.length(half), other).cast("binary"), 256)

    def move(c: Column, i: Column) -> Column:
        # Two hexadecimal digits a character; a new hash after every 32 characters.
        block = F.when(i < 32, stream).otherwise(F.sha2(F.concat_ws("|", stream, F.floor(i / 32)).cast("binary"), 256))
        amount = F.conv(F.substring(block, ((i % 32) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        out = c
        for a in ALPHABETS:
            at = F.position(c, F.lit(a))
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + amount, F.lit(len(a))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), move), "")


def feistel(a: Column, b: Column, turn: Callable[[Column, Column, Column], Column]) -> Column:
    """struct<a, b> after ROUNDS (an even number) rounds; turn(half, other, i) changes one half by the other."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.alias("a"), b.alias("b")), lambda s, i: F.struct(turn(s["b"], s["a"], i).alias("a"), s["a"].alias("b")))


def permute_text(text: Column, key: str) -> Column:
    """A permutation of the strings of one format: same length, every character in its alphabet, others in place."""
    cut = F.floor(F.length(text) / 2).cast("int")
    state = feistel(F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.length(text)), lambda half, other, i: shifted(half, other, key, i))
    return F.aggregate(F.array(state), F.lit(""), lambda _, s: F.concat(s["a"], s["b"]))


def permute_number(x: Column, size: int, key: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """A permutation of the valid numbers among 0 ... size-1: a Feistel network on a square of at least that size; values outside walk on.

    At least 8 of 10 numbers of the square must be valid: then a walk of more than 30 steps has odds below 1e-20.
    """
    side = int(size**0.5)
    side += side * side < size

    def once(v: Column) -> Column:
        state = feistel(F.floor(v / side).cast("long"), (v % side).cast("long"), lambda half, other, i: F.pmod(half + digest_number(key, i, other), F.lit(side).cast("long")))
        return F.aggregate(F.array(state), F.lit(0).cast("long"), lambda _, s: s["a"] * side + s["b"])

    ends = lambda v: v.between(0, size - 1) & (valid(v) if valid else F.lit(True))
    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(-1).cast("long"), lambda v, i: F.when(ends(v), v).otherwise(once(F.when(v < 0, x).otherwise(v))))


def luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (less 9 above 9), modulo 10."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(backwards, doubled), F.lit(0), lambda s, x: s + x) % 10


def modulo_97(text: Column) -> Column:
    """The number that the characters spell (A is 10 ... Z is 35), modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def email(x: Column, key: str) -> Column:
    domain = F.substring_index(x, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(permute_text(F.substring_index(x, "@", 1), key + "l"), F.lit("@"), permute_text(labels, key + "d"), F.lit("."), top)


def iban(x: Column, key: str) -> Column:
    plain = F.translate(x, " ", "")
    valid = modulo_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))) == 1
    rest = permute_text(F.substring(x, F.lit(5), F.length(x)), key)
    made = F.aggregate(F.array(rest), F.lit(""), lambda _, r: F.concat(F.left(x, F.lit(2)), F.lpad((98 - modulo_97(F.concat(F.translate(r, " ", ""), F.left(x, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), r))
    return F.when(valid, made).otherwise(x)


def ipv4(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    made = F.aggregate(F.array(permute_number(number, 1 << 32, key)), F.lit(""), lambda _, n: F.concat_ws(".", *((F.floor(n / (1 << k)) % 256).cast("long") for k in (24, 16, 8, 0))))
    return F.when(F.forall(octets, lambda o: o < 256), made).otherwise(x)


def date(x: Column, key: str) -> Column:
    """Dates from 1900 to 2099, each form among its own: year first; with full stops; with slashes as (month, day), (day, month) or either.

    With slashes, two numbers up to 12 may mean two days: such strings are permuted among themselves, and those that mean one day
    among those of the same order, so different strings never get one pseudonym.
    """
    iso = x.rlike("^[0-9]{4}-")
    year = F.when(iso, F.left(x, F.lit(4))).otherwise(F.right(x, F.lit(4))).cast("int")
    first = F.when(iso, F.substring(x, 6, 2)).otherwise(F.left(x, F.lit(2))).cast("int")
    second = F.when(iso, F.substring(x, 9, 2)).otherwise(F.substring(x, 4, 2)).cast("int")
    slash, era = x.contains("/"), year.between(1900, 2099)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def whole(month: Column, day: Column, name: str, show: Callable[[Column, Column, Column], Column]) -> Column:
        """Months of 31 places; places without a day are walked over."""
        fits = lambda v: F.dayofmonth(F.last_day(F.make_date((F.floor(v / 372) + 1900).cast("int"), (F.floor(v / 31) % 12 + 1).cast("int"), F.lit(1)))) > v % 31
        n = ((year - 1900) * 372 + (month - 1) * 31 + day - 1).cast("long")
        made = F.transform(F.array(permute_number(n, 200 * 372, key + name, fits)), lambda v: show((F.floor(v / 372) + 1900).cast("string"), two(F.floor(v / 31) % 12 + 1), two(v % 31 + 1)))[0]
        real = era & month.between(1, 12) & (day >= 1) & (day <= F.dayofmonth(F.last_day(F.try_to_timestamp(F.concat(year.cast("string"), two(month)), F.lit("yyyyMM")).cast("date"))))
        return F.when(real, made)

    def late(month: Column, day: Column, name: str, show: Callable[[Column, Column, Column], Column]) -> Column:
        """Days from the 13th: months of 19 places."""
        fits = lambda v: F.dayofmonth(F.last_day(F.make_date((F.floor(v / 228) + 1900).cast("int"), (F.floor(v / 19) % 12 + 1).cast("int"), F.lit(1)))) > v % 19 + 12
        n = ((year - 1900) * 228 + (month - 1) * 19 + day - 13).cast("long")
        made = F.transform(F.array(permute_number(n, 200 * 228, key + name, fits)), lambda v: show((F.floor(v / 228) + 1900).cast("string"), two(F.floor(v / 19) % 12 + 1), two(v % 19 + 13)))[0]
        real = era & month.between(1, 12) & (day >= 13) & (day <= F.dayofmonth(F.last_day(F.try_to_timestamp(F.concat(year.cast("string"), two(month)), F.lit("yyyyMM")).cast("date"))))
        return F.when(real, made)

    n = ((year - 1900) * 144 + (first - 1) * 12 + second - 1).cast("long")
    either = F.transform(F.array(permute_number(n, 200 * 144, key + "either")), lambda v: F.concat_ws("/", two(F.floor(v / 12) % 12 + 1), two(v % 12 + 1), (F.floor(v / 144) + 1900).cast("string")))[0]
    out = F.when(iso, whole(first, second, "iso", lambda y, m, d: F.concat_ws("-", y, m, d)))
    out = out.when(~slash, whole(second, first, "stops", lambda y, m, d: F.concat_ws(".", d, m, y)))
    out = out.when(first.between(1, 12) & second.between(1, 12), F.when(era, either))
    out = out.when(first <= 12, late(first, second, "month", lambda y, m, d: F.concat_ws("/", m, d, y)))
    return F.coalesce(out.otherwise(late(second, first, "day", lambda y, m, d: F.concat_ws("/", d, m, y))), x)


def ssn(x: Column, key: str) -> Column:
    valid = lambda v: v.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(""), lambda v, i: F.when((v != "") & valid(v), v).otherwise(permute_text(F.when(v == "", x).otherwise(v), key)))
    return F.when(valid(x), walked).otherwise(x)


def phone(x: Column, key: str) -> Column:
    """8 to 15 digits (E.164), a country code that doesn't begin with 0; the code stays (without a separator, its first digit)."""
    valid = F.length(F.regexp_replace(x, "[^0-9]", "")).between(8, 15) & ~x.startswith("+0")
    code = F.regexp_extract(x, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])", 0)
    return F.when(valid, F.concat(code, permute_text(F.substring(x, F.length(code) + 1, F.length(x)), key))).otherwise(x)


def card(x: Column, key: str) -> Column:
    body = permute_text(F.substring(x, F.lit(1), F.length(x) - 1), key)
    made = F.aggregate(F.array(body), F.lit(""), lambda _, b: F.concat(b, ((10 - luhn(F.concat(F.translate(b, " -", ""), F.lit("0")))) % 10).cast("string")))
    return F.when(luhn(F.translate(x, " -", "")) == 0, made).otherwise(x)


MAKERS = {"email": email, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(x: Column, key: str) -> Column:
    """What stands for one match of ANY."""
    out = x
    for kind in reversed(list(MAKERS)):
        out = F.when(x.rlike("^(?:" + PATTERNS[kind] + ")$"), MAKERS[kind](x, f"{key}/{kind}")).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with personal data in a text column replaced, and n_replaced, the number of values that changed.

    All rows and other columns are kept (a column n_replaced is replaced). Null stays null, with 0. Places don't overlap; of several patterns at
    one place the first of PATTERNS counts. A value that the key maps to itself (rare, one in the number of values of
    its format) stays as it is.
    """
    text = F.col(column).cast("string")
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    made = F.transform(hits, lambda x: pseudonym(x, key))
    # One pass: what lies between the matches, and the matches' pseudonyms.
    parts = F.struct(F.split(text, ANY, -1).alias("gaps"), hits.alias("hits"), made.alias("made"))
    whole = lambda p: F.array_join(F.zip_with(p["gaps"], p["made"], lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    count = lambda p: F.aggregate(F.zip_with(p["hits"], p["made"], lambda h, m: (h != m).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    one = F.transform(F.array(parts), lambda p: F.struct(whole(p).alias("text"), count(p).alias("n")))[0]
    rows = docs.drop("n_replaced").withColumn("_made", F.when(text.rlike("[@0-9]") & text.rlike(ANY), one))
    rest = [F.coalesce("_made.text", column).alias(c) if c == column else F.col(c) for c in docs.columns if c != "n_replaced"]
    return rows.select(*rest, F.coalesce("_made.n", F.lit(0).cast("long")).alias("n_replaced"))
