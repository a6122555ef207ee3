"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

What looks like personal data is found by one pattern, validated (check digits, calendar, ranges) and
replaced by a keyed permutation of its own format: a Feistel network over the two halves of its
characters, where digits stay digits and letters stay letters of their case. The same value becomes the
same pseudonym in every document, so links between documents stay; without the key nothing is undone.

| kind | validated by | permuted |
|---|---|---|
| email | shape | letters and digits but those of the last domain label |
| ipv4 | octets up to 255 | the address as two 16-bit halves |
| card | 13 to 19 digits, Luhn | all but the last digit, which is computed anew |
| iban | remainder modulo 97 | the account part; check digits are computed anew |
| phone | shape | the digits after the country code; ten digits whose area and exchange begin with 2 to 9 stay such |
| ssn | area, group and serial in use | all digits, so that area, group and serial are in use again |
| date | calendar, 1900-01-01 to 2099-11-13 (`yyyy-MM-dd`, `yyyy/MM/dd`, `dd.MM.yyyy`, `dd/MM/yyyy`, and `MM/dd/yyyy` of days above 12) | the day number |
| secret | follows `password`, `token`, `secret` or `key` and a sign, 8 characters with a digit | hexadecimal or letters and digits |

Numbers that fail validation are left as they are. Where only some digits are valid, a value is permuted
again until it is valid (cycle walking), which is a permutation of the valid values.

A value starts at the beginning of a run of letters and digits, whatever sign stands before it, or at a
`+` or `(` that opens a phone number. What continues a number or an address is no start: addresses
(email) take the whole run with its `._%+-`; `.` after a digit goes before no ipv4 and no `dd.MM.yyyy`,
`.` or `-` after a digit before no card, phone, ssn or `yyyy-MM-dd`. So `no.4981021525375367` and
`IP-217.75.41.129` are found, `1.217.75.41.129` and `id4981021525375367` are not. A value ends where no
letter or digit follows; a date also ends before `T` and a time and before `Z`.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import free_name, query, table

ROUNDS = 8
KEY = "replace this key"
KEY_SETTING = "spark.themeloom.pseudonymKey"
WALK = 128
FIRST_DAY = date(1900, 1, 1)
DAY_HALVES = (250, 292)  # 73,000 days

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": rf"{OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "date": (
        r"(?:(?<!\d[.-])(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d"
        r"|(?<!\d\.)\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)"
        r"(?:(?![\p{L}\p{N}])|(?=[Tt][0-2]\d|[Zz](?![\p{L}\p{N}])))"
    ),
    "ssn": r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\p{L}\p{N}])",
    "phone": (
        r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
        r"|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?![\p{L}\p{N}])"
        r"|\+(?!1)\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]\d{2,4}){1,3}(?![\p{L}\p{N}])"
        r"|\+(?!1)\d{8,15}(?![\p{L}\p{N}])"
    ),
    "card": (
        r"(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\p{N}])"
    ),
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "secret": (
        r"(?<=[=: \t\x22\x27])(?<=(?i:password|passwd|token|secret|key)[ \t]{0,2}[=:][ \t]{0,2}[\x22\x27]?)"
        r"(?=[A-Za-z_+/=-]*+\d)[A-Za-z0-9_+/=-]{8,}(?![\p{L}\p{N}])"
    ),
}
# What must not stand before a value of a kind, as it would be part of the same number or address.
JOINED = r"(?<!\d[.-])"
BEFORE = {
    "email": r"(?:(?<![._%+-])|(?<![\p{L}\p{N}][._%+-]{1,8}))",
    "ipv4": r"(?<!\d\.)",
    "ssn": JOINED,
    "phone": JOINED,
    "card": JOINED,
}
# Tried in this order at the start of a run of letters and digits, or at a sign that opens a value.
ANY = r"(?=[\p{L}\p{N}+(_/=-])(?:(?<![\p{L}\p{N}])(?:" + "|".join(
    f"{BEFORE.get(k, '')}(?:{PATTERNS[k]})" for k in ("secret", "email", "ipv4", "date", "ssn", "phone", "card", "iban")
) + rf")|(?<=\p{{L}})(?=[+(])(?:{PATTERNS['phone']}))"


def hashed(key: str, *parts) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 512)


def number(digest: Column, at: Column | int) -> Column:
    """A number below 2^16 from the place `at` (taken modulo 32) of a digest."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(digest, (F.pmod(at, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def shifted(char: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """The character moved within the alphabet that holds it; others stay."""
    out = char
    for alphabet in alphabets:
        place = F.instr(F.lit(alphabet), char)
        moved = F.substring(F.lit(alphabet), (F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        out = F.when(place > 0, moved).otherwise(out)
    return out


def permuted_chars(value: Column, key: str, kind: str, alphabets: tuple[str, ...], rounds: int = ROUNDS) -> Column:
    """A permutation of the strings with the same kind of character at each place."""
    chars = F.split(value, "")
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(
        F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b")
    )

    def turn(state: Column, r: Column) -> Column:
        digest = hashed(key, kind, r.cast("string"), F.array_join(state["b"], ""))
        left = F.transform(
            F.array(digest),
            lambda h: F.transform(state["a"], lambda c, i: shifted(c, number(h, i), alphabets)),
        )
        return F.struct(state["b"].alias("a"), left[0].alias("b"))

    turns = F.sequence(F.lit(1), F.lit(rounds))
    # An even number of rounds brings the halves back to their places.
    done = F.aggregate(turns, start, turn)
    return F.when(F.size(chars) > 0, F.array_join(F.concat(done["a"], done["b"]), "")).otherwise(value)


def permuted_number(value: Column, halves: tuple[int, int], key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A permutation of the numbers below the product of the halves."""
    first, second = halves
    start = F.struct(F.floor(value / second).cast("long").alias("a"), F.pmod(value, F.lit(second)).cast("long").alias("b"))

    def turn(state: Column, r: Column) -> Column:
        a = F.pmod(state["a"] + number(hashed(key, kind, r.cast("string"), "a", state["b"].cast("string")), 0), F.lit(first))
        b = lambda x: F.pmod(state["b"] + number(hashed(key, kind, r.cast("string"), "b", x.cast("string")), 0), F.lit(second))
        return F.transform(F.array(a), lambda x: F.struct(x.cast("long").alias("a"), b(x).cast("long").alias("b")))[0]

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds // 2)), start, turn)
    return done["a"] * second + done["b"]


def filled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by the given ones."""
    empty = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(state: Column, char: Column) -> Column:
        is_digit = char.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["next"], F.lit(1))).otherwise(char)).alias("out"),
            (state["next"] + F.when(is_digit, 1).otherwise(0)).cast("int").alias("next"),
        )

    return F.aggregate(F.split(template, ""), empty, put)["out"]


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_luhn(body: Column) -> Column:
    """The digits and their Luhn check digit."""
    reversed_digits = F.transform(F.split(F.reverse(body), ""), lambda c: c.cast("int"))
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    total = F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d)
    return F.concat(body, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def modulo_97(value: Column) -> Column:
    """The remainder of an account number, letters counting from 10."""

    def add(acc: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + c.try_cast("int")) % 97).cast("int")

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def email(v: Column, key: str) -> Column:
    body = F.regexp_extract(v, r"^(.*)(\.[A-Za-z]+)$", 1)
    return F.concat(permuted_chars(body, key, "email", (DIGITS, LOWER, LOWER.upper())), F.regexp_extract(v, r"(\.[A-Za-z]+)$", 1))


def ipv4(v: Column, key: str) -> Column:
    octet = lambda k: F.split_part(v, F.lit("."), F.lit(k)).try_cast("long")
    whole = ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4)
    new = permuted_number(whole, (65536, 65536), key, "ipv4")
    return F.transform(
        F.array(new),
        lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )[0]


def card(v: Column, key: str) -> Column:
    digits = only_digits(v)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.when(F.call_function("luhn_check", digits), filled(v, with_luhn(permuted_chars(body, key, "card", (DIGITS,))))).otherwise(v)


def iban(v: Column, key: str) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
    valid = (F.length(flat) >= 15) & (modulo_97(F.concat(account, F.substring(flat, 1, 4))) == 1)
    new = permuted_chars(account, key, "iban", (DIGITS, LOWER.upper()))

    def built(a: Column) -> Column:
        check = F.lpad((98 - modulo_97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
        flat_new = F.concat(country, check, a)
        grouped = F.trim(F.regexp_replace(flat_new, "(.{4})", "$1 "))
        return F.when(v.contains(" "), grouped).otherwise(flat_new)

    return F.when(valid, F.transform(F.array(new), built)[0]).otherwise(v)


def walked(value: Column, permuted: Callable[[Column], Column], valid: Callable[[Column], Column], steps: int = WALK) -> Column:
    """A permutation of the valid values: permuted until the result is valid again.

    `valid` must hold for the value. A step fails at most two times in three, so that 128 in a row never do; steps
    after the first valid result cost nothing.
    """

    def turn(s: Column, i: Column) -> Column:
        # The structure is there once for its three fields.
        return F.when(s["done"], s).otherwise(
            F.transform(F.array(permuted(s["v"])), lambda v: F.struct(v.alias("v"), valid(v).alias("done")))[0]
        )

    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn)["v"]


def phone(v: Column, key: str) -> Column:
    """Ten digits after no code or +1 stay a number that can be dialled, or one that cannot; other digits are free."""
    code = F.regexp_extract(v, r"^(\+1|\+\d{1,3}(?=[ .(-])|\+\d\d)?", 1)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    digits = only_digits(rest)
    permuted = lambda d: permuted_chars(d, key, "phone", (DIGITS,))
    dialled = lambda d: d.rlike(r"^[2-9]\d\d[2-9]")
    american = code.isin("", "+1") & (F.length(digits) == 10)
    new = F.when(american & dialled(digits), walked(digits, permuted, dialled)).when(
        american, walked(digits, permuted, lambda d: ~dialled(d))
    )
    return F.concat(code, filled(rest, new.otherwise(permuted(digits))))


def ssn(v: Column, key: str) -> Column:
    permuted = lambda d: permuted_chars(d, key, "ssn", (DIGITS,))
    used = lambda d: d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d\d(?!0000)\d{4}$")
    return filled(v, walked(only_digits(v), permuted, used))


def late_day(place: Column, key: str) -> Column:
    """A permutation of the days above 12 of their months."""
    late = lambda p: F.dayofmonth(F.date_add(F.lit(FIRST_DAY), p.cast("int"))) > 12
    return walked(place.cast("long"), lambda p: permuted_number(p, DAY_HALVES, key, "date").cast("long"), late)


def day(v: Column, key: str) -> Column:
    out = v
    for shape, form in (
        (r"^\d{4}-", "yyyy-MM-dd"),
        (r"^\d{4}/", "yyyy/MM/dd"),
        (r"^\d\d\.", "dd.MM.yyyy"),
        (r"^\d\d/", "dd/MM/yyyy"),
        (r"^\d\d/(?:1[3-9]|2\d|3[01])/", "MM/dd/yyyy"),  # a day, so that it is no dd/MM/yyyy
    ):
        parsed = F.try_to_timestamp(v, F.lit(form)).cast("date")
        place = F.datediff(parsed, F.lit(FIRST_DAY))
        known = place.between(0, DAY_HALVES[0] * DAY_HALVES[1] - 1)
        moved = late_day(place, key) if form == "MM/dd/yyyy" else permuted_number(place.cast("long"), DAY_HALVES, key, "date")
        new = F.date_add(F.lit(FIRST_DAY), moved.cast("int"))
        out = F.when(v.rlike(shape), F.when(known, F.date_format(new, form)).otherwise(v)).otherwise(out)
    return out


def secret(v: Column, key: str) -> Column:
    as_hex = permuted_chars(v, key, "secret", (HEX,))
    return F.when(v.rlike("^[0-9a-f]+$"), as_hex).otherwise(permuted_chars(v, key, "secret", (DIGITS, LOWER, LOWER.upper())))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself where validation fails."""
    whole = lambda kind: v.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(v.contains("@"), email(v, key))
        .when(whole("ipv4"), ipv4(v, key))
        .when(whole("date"), day(v, key))
        .when(whole("ssn"), ssn(v, key))
        .when(whole("phone"), phone(v, key))
        .when(whole("card"), card(v, key))
        .when(whole("iban"), iban(v, key))
        .otherwise(secret(v, key))
    )


def session_key(spark: SparkSession) -> str:
    """The key in the setting `spark.themeloom.pseudonymKey`, or the public placeholder with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the public key can be undone by anyone", stacklevel=3)
    return key or KEY


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", out: str = "n_replaced") -> DataFrame:
    """The documents with pseudonyms in the text and the number of replaced values; no shuffle.

    key: the secret under which values are permuted, by default that of the session (`session_key`).
    Every row stays, repeated ones too; a null text stays null and an empty one empty, with 0 replaced.
    All other columns stay; one called like `out` stays too, and the new one gets underscores before it.
    All formats but addresses keep their length. The pattern has no nested repetition, so long texts are read once.
    """
    key = session_key(docs.sparkSession) if key is None else key
    source = F.col(f"`{text}`")
    found = F.regexp_extract_all(source, F.lit(ANY), F.lit(0))
    between = F.split(source, ANY, -1)
    pairs = F.transform(found, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    out = free_name(docs.columns, out)
    work = free_name(docs.columns, "found_values")
    has = source.rlike(ANY)
    listed = docs.withColumn(work, F.when(has, pairs))
    values = F.col(f"`{work}`")
    news = F.array_append(F.transform(values, lambda p: p["new"]), F.lit(""))
    built = F.array_join(F.flatten(F.zip_with(between, news, lambda a, b: F.array(a, b))), "")
    changed = F.size(F.filter(values, lambda p: p["old"] != p["new"]))
    columns = [
        F.when(values.isNotNull(), built).otherwise(source).alias(c) if c == text else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return listed.select(*columns, F.when(values.isNotNull(), changed).otherwise(0).cast("int").alias(out))


@query("op8_pii")
def op8(spark, sf):
    return pseudonymise(table(spark, sf, "documents").select("doc_id", "text"))
