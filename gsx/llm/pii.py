"""Format-preserving pseudonyms for personal data, in built-in expressions only.

Card numbers, phone numbers, network addresses and dates are found by pattern, validated,
and permuted by a keyed Feistel network within their own format: a card number becomes
another one of its length with a valid check digit, a date another date written alike.  The
permutation depends on the key and the value only, so equal values stay linked across documents
and different ones stay different.  The local part of a mail address becomes a keyed
pseudonym of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gsx.llm.texts import unused_name

ROUNDS = 8

# fixed formats
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = (
    r"(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}"
    r"|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"
)
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = (
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})"
    r"(?![0-9A-Za-z]|[./-][0-9])"
)
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
    r"(?![0-9A-Za-z])"
)
ANY = "|".join((EMAIL, SOCIAL, DATE, ADDRESS, CARD, PHONE))

#: Days of one Gregorian cycle of 400 years, as a product, and its first day.
CYCLE = (189, 773)
FIRST_DAY = "1800-01-01"


def _noise(key: str, tweak: Column, value: Column, round_: Column, modulus: Column) -> Column:
    """Keyed pseudo-random number below ``modulus``."""
    seed = F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("bigint"), modulus)


def permuted(value: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of the numbers below ``a * b``; sizes must be positive bigints."""
    start = F.struct(F.floor(value / b).cast("bigint").alias("l"), F.pmod(value, b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, F.pmod(s.l + _noise(key, tweak, s.r, i, a), a)).otherwise(s.l)
        right = F.when(even, s.r).otherwise(F.pmod(s.r + _noise(key, tweak, s.l, i, b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s.l * b + s.r)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("bigint")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """Keyed permutation of the digit strings of one length, up to 18 digits."""
    n = F.length(digits)
    low = F.ceil(n / 2).cast("int")
    a, b = _power(n - low), _power(low)
    moved = permuted(digits.cast("bigint"), a, b, F.concat(F.lit(kind), n.cast("string")), key)
    return F.lpad(moved.cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check formula; a multiple of 10 for a valid number."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, d.cast("int")).otherwise(
            F.pmod(d.cast("int") * 2, F.lit(10)) + F.when(d.cast("int") > 4, 1).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def _respelled(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced in order, all else left."""
    done = F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, c: F.when(
            c.rlike("[0-9]"),
            F.struct(F.concat(s.out, F.substring(digits, s.at + 1, F.lit(1))).alias("out"), (s.at + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.at.alias("at"))),
        lambda s: s.out,
    )
    return done


def card_pseudonym(text: Column, key: str) -> Column:
    """Another number with a valid check digit; an invalid one is left."""
    digits = _digits(text)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(luhn_sum(digits), F.lit(10)) == 0
    return F.when(valid, _respelled(text, F.concat(body, check.cast("string")))).otherwise(text)


def phone_pseudonym(text: Column, key: str) -> Column:
    """The digits after the country code are permuted; fewer than 8 or over 15 are left."""
    digits = _digits(text)
    code = F.when(~text.startswith("+"), 0).when(digits.rlike("^[17]"), 1).otherwise(2)
    tail = F.substring(digits, code + 1, F.length(digits))
    moved = F.concat(F.substring(digits, F.lit(1), code), permuted_digits(tail, "phone", key))
    return F.when(F.length(digits).between(8, 15), _respelled(text, moved)).otherwise(text)


def social_pseudonym(text: Column, key: str) -> Column:
    """A social security number; one of an area that is never issued is left."""
    moved = _respelled(text, permuted_digits(_digits(text), "social", key))
    return F.when(text.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)"), moved).otherwise(text)


def address_pseudonym(text: Column, key: str) -> Column:
    """Another network address; numbers above 255 are left."""
    octets = F.transform(F.split(text, "[.]"), lambda o: o.cast("bigint"))
    valid = F.forall(octets, lambda o: o <= 255)
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
    half = F.lit(65536).cast("bigint")
    moved = permuted(value, half, half, F.lit("address"), key)
    parts = [F.pmod(F.floor(moved / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]
    return F.when(valid, F.concat_ws(".", *parts)).otherwise(text)


def date_pseudonym(text: Column, key: str) -> Column:
    """Another day of the 400 years from 1800 on, written alike; other dates are left."""
    iso = text.rlike("^[0-9]{4}-")
    mark = F.substring(text, 3, 1)
    # day first unless only month first makes a date
    day_first = F.try_to_date(F.translate(text, "./", "--"), "dd-MM-yyyy")
    month_first = F.try_to_date(F.translate(text, "./", "--"), "MM-dd-yyyy")
    day = F.when(iso, F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(day, first).cast("bigint")
    a, b = (F.lit(n).cast("bigint") for n in CYCLE)
    moved = F.date_add(first, permuted(number, a, b, F.lit("date"), key).cast("int"))
    spelled = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(
        day_first.isNotNull(), F.date_format(moved, "dd-MM-yyyy")
    ).otherwise(F.date_format(moved, "MM-dd-yyyy"))
    spelled = F.when(iso, spelled).otherwise(F.regexp_replace(spelled, F.lit("-"), mark))
    return F.when(number.between(0, CYCLE[0] * CYCLE[1] - 1), spelled).otherwise(text)


def email_pseudonym(text: Column, key: str) -> Column:
    """The local part becomes letters of a keyed digest; the domain is left."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(text)), 256)
    letters = F.translate(F.substring(digest, 1, 20), "0123456789", "ghijklmnop")
    return F.concat(letters, F.lit("@"), F.substring_index(text, "@", -1))


def pseudonym(text: Column, key: str) -> Column:
    """The pseudonym of one match of :data:`ANY`; what is not valid stays."""
    return (
        F.when(F.contains(text, F.lit("@")), email_pseudonym(text, key))
        .when(text.rlike(f"^(?:{SOCIAL})$"), social_pseudonym(text, key))
        .when(text.rlike(f"^(?:{DATE})$"), date_pseudonym(text, key))
        .when(text.rlike(f"^(?:{ADDRESS})$"), address_pseudonym(text, key))
        .when(text.rlike(f"^(?:{CARD})$"), card_pseudonym(text, key))
        .otherwise(phone_pseudonym(text, key))
    )


def pseudonymized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of replaced values, ``n_replaced``.

    NULL text stays NULL with 0 replaced; empty texts and texts without personal data are
    unchanged; a number that fails its check is no personal data.  A column that is called
    ``n_replaced`` already is replaced.  Rows are independent of one another; an empty
    table gives no rows.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    # most texts hold no digit and no mail address
    may = F.col(text).rlike("[0-9@]")
    old, new = unused_name("found", docs.columns), unused_name("names", docs.columns)
    with_matches = docs.withColumn(old, F.when(may, found).otherwise(F.array().cast("array<string>")))
    with_names = with_matches.withColumn(new, F.transform(old, lambda m: pseudonym(m, key)))
    pieces = F.zip_with(
        F.split(F.col(text), ANY, -1), F.col(new), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))
    )
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda differs: differs))
    return with_names.withColumns(
        {
            text: F.when(F.size(old) > 0, F.array_join(pieces, "")).otherwise(F.col(text)),
            "n_replaced": F.coalesce(changed, F.lit(0)).cast("long"),
        }
    ).drop(old, new)
