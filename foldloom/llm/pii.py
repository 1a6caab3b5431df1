"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Numbers and dates are found by patterns and validated (Luhn digit of card numbers, octets of IPv4 addresses, calendar
of dates, area of social security numbers; a telephone number needs a country code, an area code in brackets, or an area and
an exchange that begin with 2 to 9, or a form common abroad after a country code; account numbers by their
check digits, where they are written without spaces). The free characters of a value are read as digits of mixed radix, and an
eight-round Feistel network permutes them; the round function is SHA-512 of key, kind, radices, round and the other
half. Every half-round adds a keyed number digit by digit, modulo its radix, so the whole is a bijection on the values
of that format. Equal values get equal pseudonyms in every document, and a pseudonym is again valid in its format: card numbers
get a new Luhn digit, dates stay dates of the same layout between 1900 and 2099, separators stay in place. E-mail
addresses keep their domain (names may hold Latin letters up to U+024F, and an apostrophe; one that goes on into other letters before is left alone),
phone numbers their country code, account numbers their country, access keys their four letters in front; hexadecimal secrets
stay hexadecimal, each digit and letter in its own case. A single character is moved by a keyed number of steps that is never zero;
a hexadecimal run is permuted in pieces of 64, each keyed by the piece before it, so a run may have any length. A date that
is valid only as month, day, year is permuted among such dates.

Defined results: a null text stays null with no finds; values that fail validation stay as they are; equal rows stay
equal, repeated ones too; a very long text is worked on whole, in the JVM's memory, like any other; an empty table gives an
empty one; all columns but the text pass unchanged, but for one named like the number of finds, which that replaces.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm.common import free

ROUNDS = 8
#: half a value has at most so many digits: four hexadecimal digits of the hash stand behind each
MOST_DIGITS = 32
#: a name that Spark's own redaction hides in its pages and logs
KEY_SETTING = "spark.foldloom.pii.secret"
_DRAWN: dict[str, str] = {}

#: letters of the Latin blocks up to U+024F; what may stand in a name before the @; and what may not stand before it: these, and any later letters
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LOCAL = LATIN + r"0-9._%+'\-"
LATER = "\u0250-\u1fff\u2c00-\ud7ff\uf900-\ufffd"
_ABOVE = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
#: alphabets of a name's characters, each permuted within its own
NAME_CLASSES = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(c for c in _ABOVE if c.islower()), "".join(c for c in _ABOVE if c.isupper()), "".join(c for c in _ABOVE if not c.islower() and not c.isupper()),
)
ALNUM = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: telephone numbers of other countries, as they are commonly written: country code, then area and number
ABROAD = r"\+[1-9][0-9]{0,2}(?:[ .-][0-9]{2}(?:[ .-][0-9]{4}){2}|[ .-][1-9](?:[ .-][0-9]{2}){4}|[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[ .-][0-9]{3,4}(?:[ .-][0-9]{3}){2}|[ .-][0-9]{2,5}[ .-][0-9]{5,8})|\+[1-9][0-9]{8,13}"

#: kinds in order of precedence
PATTERNS = {
    "email": rf"(?<![{LOCAL}{LATER}])[{LOCAL}]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])",
    "access_key": r"(?<![0-9A-Za-z])[A-Z]{4}(?=[A-Z]{0,15}[0-9])[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])|\([0-9]{3}\)[ .-]?|[2-9][0-9]{2}[ .-](?=[2-9]))[0-9]{3}[ .-][0-9]{4}(?![0-9])" + rf"|(?<![0-9A-Za-z+])(?:{ABROAD})(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
#: one pattern for all, its one back reference renumbered away
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: 1900-01-01 to 2099-12-31 are 229 x 319 days
FIRST_DAY, DAY_RADICES = "1900-01-01", (229, 319)
#: turns in search of a day above 12; 6 in 10 dates have one
WALK = 64


def _number(text: Column, base: int = 10) -> Column:
    return F.conv(text, base, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once; a column named in a lambda is else worked out at each of its steps."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(digits: Column, radices: Column, key: Column, kind: str | Column, inverse: bool = False) -> Column:
    """Permute digits (array<bigint>) of the given radices; inverse undoes it. Fewer than two digits stay."""
    sign = -1 if inverse else 1
    names = ("left", "right", "left_radix", "right_radix", "text")

    def held(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    def begin(given: Column) -> Column:
        d, r = given["digits"], given["radices"]
        half = F.floor(F.size(d) / 2).cast("int")
        return held(F.slice(d, 1, half), F.slice(d, half + 1, F.size(d) - half), F.slice(r, 1, half), F.slice(r, half + 1, F.size(r) - half), F.array_join(r.cast("array<string>"), ","))

    def moved(own: Column, radix: Column, other: Column, text: Column, turn: Column) -> Column:
        told = F.sha2(F.concat_ws("|", key, F.lit(kind), text, turn.cast("string"), F.array_join(other.cast("array<string>"), ",")).cast("binary"), 512)
        step = lambda t: F.transform(F.arrays_zip(own.alias("d"), radix.alias("r")), lambda x, i: F.pmod(x["d"] + sign * _number(F.substring(t, 4 * i + 1, 4), 16), x["r"]))
        return _let(told, step)

    def turn(s: Column, i: Column) -> Column:
        left, right = s["left"], s["right"]
        rest = (s["left_radix"], s["right_radix"], s["text"])
        return F.when(i % 2 == 1, held(moved(left, s["left_radix"], right, s["text"], i), right, *rest)).otherwise(held(left, moved(right, s["right_radix"], left, s["text"], i), *rest))

    turns = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def permuted(given: Column) -> Column:
        mixed = F.aggregate(turns, begin(given), turn, lambda s: F.concat(s["left"], s["right"]))
        return F.when(F.size(given["digits"]).between(2, 2 * MOST_DIGITS), mixed).otherwise(given["digits"])

    return _let(F.struct(digits.alias("digits"), radices.alias("radices")), permuted)


def _shifted(digits: Column, radices: Column, key: Column, kind: str | Column) -> Column:
    """A single digit, moved on by a keyed number of 1 to its radix - 1."""
    told = _number(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), F.array_join(radices.cast("array<string>"), ",")).cast("binary"), 512), 1, 8), 16)
    return F.transform(F.arrays_zip(digits.alias("d"), radices.alias("r")), lambda x: F.pmod(x["d"] + 1 + F.pmod(told, x["r"] - 1), x["r"]))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _filled(text: Column, free: str, values: Column, alphabets: Column) -> Column:
    """text with its characters of class `free` replaced, in order, by values read in their alphabets."""
    start = lambda given: F.struct(F.lit("").alias("out"), F.lit(0).alias("i"), given.alias("given"))

    def put(state: Column, c: Column) -> Column:
        given = state["given"]
        new = F.substring(F.get(given["alphabets"], state["i"]), (F.get(given["values"], state["i"]) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike(free), F.struct(F.concat(state["out"], new).alias("out"), (state["i"] + 1).alias("i"), given.alias("given"))).otherwise(
            F.struct(F.concat(state["out"], c).alias("out"), state["i"].alias("i"), given.alias("given"))
        )

    return _let(F.struct(values.alias("values"), alphabets.alias("alphabets")), lambda given: F.aggregate(_letters(text), start(given), put, lambda s: s["out"]))


def _spelled(text: Column, free: str, key: Column, kind: str | Column, classes: tuple[str, ...]) -> Column:
    """Permute the characters of class `free`, each within its own alphabet."""

    def alphabet(c: Column) -> Column:
        return reduce(lambda rest, a: F.when(F.instr(F.lit(a), c) > 0, F.lit(a)).otherwise(rest), classes, F.lit(None).cast("string"))

    def permuted(taken: Column) -> Column:
        digits = F.transform(taken, lambda x: F.instr(x["a"], x["c"]).cast("long") - 1)
        radices = F.transform(taken, lambda x: F.length(x["a"]).cast("long"))
        new = F.when(F.size(taken) == 1, _shifted(digits, radices, key, kind)).otherwise(feistel(digits, radices, key, kind))
        return _filled(text, free, new, F.transform(taken, lambda x: x["a"]))

    free_ones = F.filter(_letters(text), lambda c: c.rlike(free))
    return _let(F.transform(free_ones, lambda c: F.struct(c.alias("c"), alphabet(c).alias("a"))), permuted)


def _luhn(digits: Column) -> Column:
    """The check digit after these digits (array<bigint>)."""
    total = F.aggregate(
        F.reverse(digits),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("double")),
        lambda s, d: F.struct((s["sum"] + F.when(s["double"], F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)).alias("sum"), (~s["double"]).alias("double")),
        lambda s: s["sum"],
    )
    return F.pmod(-total, F.lit(10))


def _digits(text: Column) -> Column:
    return F.transform(_letters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("long"))


def _ten(array: Column) -> Column:
    return F.transform(array, lambda _: F.lit(10).cast("long"))


def _written(text: Column, digits: Column) -> Column:
    return _filled(text, "[0-9]", digits, F.transform(digits, lambda _: F.lit("0123456789")))


def _card(text: Column, key: Column) -> Column:
    def made(digits: Column) -> Column:
        body = F.slice(digits, 1, F.size(digits) - 1)
        new = _let(feistel(body, _ten(body), key, "card"), lambda x: F.concat(x, F.array(_luhn(x))))
        return F.when(_luhn(body) == F.get(digits, F.size(digits) - 1), _written(text, new))

    return _let(_digits(text), made)


def _ipv4(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda c: c.cast("long"))
    new = feistel(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), key, "ipv4")
    return F.when(F.array_max(octets) <= 255, F.array_join(new.cast("array<string>"), "."))


def _date(text: Column, key: Column, layout: str) -> Column:
    day = F.datediff(F.try_to_timestamp(text, F.lit(layout)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    radices = F.array(*[F.lit(r).cast("long") for r in DAY_RADICES])
    inside = day.between(0, DAY_RADICES[0] * DAY_RADICES[1] - 1)
    written = lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(x, F.lit(0)) * DAY_RADICES[1] + F.get(x, F.lit(1))).cast("int")), layout)
    turned = lambda x: feistel(x, radices, key, "date")
    new = turned(F.array(F.floor(day / DAY_RADICES[1]), F.pmod(day, F.lit(DAY_RADICES[1]))))
    if layout.startswith("MM"):
        above = lambda x: F.dayofmonth(F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(x, F.lit(0)) * DAY_RADICES[1] + F.get(x, F.lit(1))).cast("int"))) > 12
        new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), new, lambda x, _: F.when(above(x), x).otherwise(turned(x)))
    return F.when(inside, _let(new, written))


def _ssn(text: Column, key: Column) -> Column:
    """Area 1-665 or 667-899, group 1-99, serial 1-9999, as three digits of those radices."""
    area, group, serial = (_number(F.regexp_extract(text, r"^(\d{3})-(\d{2})-(\d{4})$", k)) for k in (1, 2, 3))
    digits = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(digits, F.array(*[F.lit(n).cast("long") for n in (898, 99, 9999)]), key, "ssn")
    number = lambda x, k: F.get(x, F.lit(k))
    written = lambda x: F.format_string("%03d-%02d-%04d", F.when(number(x, 0) >= 665, number(x, 0) + 2).otherwise(number(x, 0) + 1), number(x, 1) + 1, number(x, 2) + 1)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _let(new, written))


def _phone(text: Column, key: Column) -> Column:
    """The last ten digits, where those are an area, an exchange and a number; else all digits after the country code (of two digits if nothing ends it)."""

    def made(national: Column) -> Column:
        new = _let(_digits(national), lambda d: feistel(d, _ten(d), key, "phone"))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(national)), _written(national, new))

    code = F.regexp_extract(text, r"^\+(?:[0-9]{1,3}(?=[ .(-])|[0-9]{2})", 0)
    ten = F.regexp_extract(text, r"\(?[0-9]{3}\)?[ .-]*[0-9]{3}[ .-][0-9]{4}$", 0)
    return _let(F.when(ten != "", ten).otherwise(F.substring(text, F.length(code) + 1, F.length(text))), made)


def _mod97(text: Column) -> Column:
    value = lambda c: F.instr(F.lit("".join(ALNUM)), c).cast("long") - 1
    return F.aggregate(_letters(text), F.lit(0).cast("long"), lambda rest, c: F.pmod(rest * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _iban(text: Column, key: Column) -> Column:
    """Country and layout stay, the account's characters are permuted within their kinds, and the check digits follow. What fails its check may be a secret."""
    country, account = F.substring(text, 1, 2), F.substring(text, 5, 30)
    new = _spelled(account, "[0-9A-Z]", key, "iban", ALNUM)
    checked = lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
    return F.when(_mod97(F.concat(account, F.substring(text, 1, 4))) == 1, _let(new, checked)).when(text.rlike(f"^(?:{PATTERNS['secret']})$"), _secret(text, key))


def _email(text: Column, key: Column) -> Column:
    local = F.substring_index(text, "@", 1)
    return F.concat(_spelled(local, f"[0-9{LATIN}]", key, "email", NAME_CLASSES), F.lit("@"), F.substring_index(text, "@", -1))


def _secret(text: Column, key: Column) -> Column:
    classes = ("0123456789", "abcdef", "ABCDEF")

    def made(parts: Column) -> Column:
        kind = lambda i: F.when(i == 0, F.lit("secret")).otherwise(F.concat(F.lit("secret "), F.get(parts, i - 1)))
        return F.array_join(F.transform(parts, lambda p, i: _spelled(p, "[0-9A-Fa-f]", key, kind(i), classes)), "")

    return _let(F.regexp_extract_all(text, F.lit(f"[0-9A-Fa-f]{{1,{2 * MOST_DIGITS}}}"), F.lit(0)), made)


def kind_of(text: Column) -> Column:
    """The kind whose pattern the whole value fits, the first in order."""
    return F.coalesce(*[F.when(text.rlike(f"^(?:{p})$"), F.lit(kind)) for kind, p in PATTERNS.items()])


def pseudonym(text: Column, key: Column) -> Column:
    """The pseudonym of a found value; null where it is not valid."""
    made = {
        "email": _email(text, key),
        "iban": _iban(text, key),
        "secret": _secret(text, key),
        "access_key": F.concat(F.substring(text, 1, 4), _spelled(F.substring(text, 5, 16), "[0-9A-Z]", key, "access_key", ALNUM)),
        "ipv4": _ipv4(text, key),
        "iso_date": _date(text, key, "yyyy-MM-dd"),
        "day_date": F.coalesce(*[_date(text, key, layout) for c in "./" for layout in (f"dd{c}MM{c}yyyy", f"MM{c}dd{c}yyyy")]),
        "ssn": _ssn(text, key),
        "phone": _phone(text, key),
        "card": _card(text, key),
    }
    chosen = lambda kind: reduce(lambda rest, name: F.when(kind == name, made[name]).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
    return _let(kind_of(text), chosen)


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting; there is none by default."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}, or pass one")
    return key


def session_key(spark: SparkSession) -> str:
    """The key of the setting, or else one drawn at random for this application: pseudonyms then agree within it only,
    and nobody can undo them.
    """
    if spark.conf.get(KEY_SETTING, None):
        return key_of(spark)
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymized(docs: DataFrame, key: str | None = None, text: str = "text", found: str = "n_found") -> DataFrame:
    """docs with pseudonyms in place of the valid values in its text, and their number in a new column `found`.

    The key is read from a table of one row by a scalar subquery, so plans, pages and event logs don't show it.
    """
    spark = docs.sparkSession
    held = spark.createDataFrame([(key_of(spark) if key is None else key,)], "key string").scalar()
    key_ = free(docs, "key")
    docs = docs.withColumn(key_, held)
    key = F.col(key_)
    some = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    values_, made_ = free(docs, "values"), free(docs, "made")
    values = F.when(some, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    listed = docs.withColumn(values_, values)
    made = F.transform(values_, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    named = listed.withColumn(made_, F.when(F.size(values_) > 0, made))
    around = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(around, made_, lambda a, m: F.array(a, F.coalesce(m["new"], m["old"], F.lit(""))))), "")
    renewed = F.when(F.size(made_) > 0, joined).otherwise(F.col(text))
    count = F.coalesce(F.when(F.size(made_) > 0, F.size(F.filter(made_, lambda m: m["new"].isNotNull()))), F.lit(0)).cast("long")
    return named.withColumns({found: count, text: renewed}).drop(values_, made_, key_)
