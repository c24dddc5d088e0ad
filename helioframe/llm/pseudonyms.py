"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Every value found is read as a list of digits in mixed radices (the characters of an e-mail address, the octets of an
address, the day number of a date, ...), permuted by a keyed Feistel network over exactly that domain, and written in
its own format again. The network adds to each half a keyed hash of the other half, digit by digit modulo its radix, so
it is a bijection: equal values get equal pseudonyms in all documents, different values different ones. Only what may
change takes part in the network; what stays of a value (its separators, top-level domain, country code, ...) enters the
hash, so that values of different shape are permuted independently. A character counts as two digits, which gives even
a single one two halves.

Only valid values change: cards with a right Luhn digit and account numbers (IBAN) with right check digits (the
pseudonym's are right too), octets up to 255, real dates from 1900 to 2099, social security numbers of assigned
ranges, international telephone numbers of 8 to 15 digits, North American ones and e-mail addresses by their form.

Forms: e-mail addresses of up to 64 and 255 characters; dates as 1999-12-24, 24.12.1999, 24/12/1999, and 12/24/1999 if it can
only be read with the month first; IPv4 addresses; social security numbers as 123-45-6789; telephone numbers as (212)
555-0123, 212-555-0123, +15551234567, +44 20 7946 0958, +49 (30) 123456 and alike; IBANs with or without blanks; cards
of 13 to 19 digits. National numbers without a plus, other than the North American, are not searched, and the national
check digits inside an IBAN are not recomputed.

Defined cases: a null text stays null and has no value; an empty text stays empty; texts are searched whole, in time that
grows with their length, whatever runs of labels, digits or letters they hold; repeated rows change alike; other columns
stay as they are, but one that has the name asked for as ``count`` is replaced by it.
"""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import spare_name

ROUNDS = 8

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI NL",
    19: "MK SI",
    20: "AT BA EE LT LU",
    21: "CH HR LI LV",
    22: "BG DE GB IE ME RS",
    23: "AE GI IL",
    24: "AD CZ ES MD RO SA SE SK TN",
    25: "PT",
    26: "IS TR",
    27: "FR GR IT MC SM",
    28: "AL AZ CY HU LB PL",
    29: "BR",
    31: "MT",
}
# Country calling codes of one and of two digits; all others have three.
CALLING = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

# The forms that are searched, first match wins. No group repeats without a bound: the engine recurses there.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9.-]{4,256}+(?![A-Za-z0-9.-]))"
    r"[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}"
)
DATE = r"(?<![\w-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
DAY_FIRST = r"(?<![\w.])(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d\d(?!\w)"
DAY_SLASH = r"(?<![\w/.-])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d\d(?![\w/])"
MONTH_SLASH = r"(?<![\w/.-])(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/(?:19|20)\d\d(?![\w/])"
OCTETS = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\w)"
ABROAD = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = (
    r"(?<!\w)(?=[A-Z]{2}\d\d)(?:"
    + "|".join(f"(?:{'|'.join(names.split())})\\d\\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    + r")(?!\w)"
)
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
# Only a digit, a plus, a bracket or the capitals of a country can begin what is not an e-mail address.
ANY = f"{EMAIL}|(?=[0-9+(])(?:{'|'.join((DATE, DAY_FIRST, DAY_SLASH, MONTH_SLASH, OCTETS, SSN, PHONE, ABROAD, CARD))})|{IBAN}"
# Every form but the e-mail address has such a run; texts without one and without an @ are not searched further.
DIGITS = r"\d[-\d .()/]{5,}\d"

FIRST_DAY, DAYS_LOW, DAYS_HIGH = "1900-01-01", 17, 4297  # 17 * 4297 days: 1900-01-01 to 2099-12-31


def whole(form: str) -> str:
    return f"^(?:{form})$"


def permuted(values: Column, radices: Column, key: str, kind: str, shape: Column | None = None) -> Column:
    """The values after the Feistel network over their radices; both are arrays of equal length, two or more. ``shape``
    is what of the value does not change."""
    n = F.size(values)
    cut = F.floor(n / 2).cast("int")
    ints = "array<bigint>"
    start = F.struct(
        F.slice(values, 1, cut).cast(ints).alias("v"),
        F.slice(radices, 1, cut).cast(ints).alias("m"),
        F.slice(values, cut + 1, n - cut).cast(ints).alias("w"),
        F.slice(radices, cut + 1, n - cut).cast(ints).alias("o"),
    )
    tweak = F.lit("") if shape is None else shape

    def turn(s: Column, k: Column) -> Column:
        # One digest of the other half; each digit's summand is drawn from it.
        other = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak, k.cast("string"), F.concat_ws(",", s["w"].cast("array<string>"))), 256)

        def added(half: Column) -> Column:
            def add(v: Column, i: Column) -> Column:
                digest = F.sha2(F.concat_ws("|", half, i.cast("string")), 256)
                return (v + F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")) % F.get(s["m"], i)

            return F.transform(s["v"], add)

        # The halves change places; after an even number of rounds they are back.
        return F.struct(s["w"].alias("v"), s["o"].alias("m"), let(other, added).alias("w"), s["m"].alias("o"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["v"], s["w"]))


def let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), 0)


def characters(text: Column) -> Column:
    return F.split(text, "")


def by_character(text: Column, key: str, kind: str, free) -> Column:
    """ASCII letters and digits in ``free`` places permuted within their own kind; anything else stays."""

    def base(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(~free(i), 0)
            .when(code.between(48, 57), 48)
            .when(code.between(65, 90), 65)
            .when(code.between(97, 122), 97)
            .otherwise(0)
        )

    def written(chars: Column, bases: Column) -> Column:
        kinds = F.filter(bases, lambda b: b > 0)
        # A digit is two digits of radices 2 and 5, a letter two of 2 and 13.
        half = lambda b: F.when(b == 48, 5).otherwise(13)
        found = F.filter(F.zip_with(chars, bases, lambda c, b: F.when(b > 0, F.ascii(c) - b)), lambda v: v.isNotNull())
        values = F.flatten(F.zip_with(found, kinds, lambda v, b: F.array(F.floor(v / half(b)).cast("int"), v % half(b))))
        radices = F.flatten(F.transform(kinds, lambda b: F.array(F.lit(2), half(b))))
        stays = F.array_join(F.zip_with(chars, bases, lambda c, b: F.when(b == 0, c).otherwise(F.char(b))), "")

        def put(new: Column) -> Column:
            # The number of the free place is that of the free places before it.
            def one(c: Column, i: Column) -> Column:
                b = F.get(bases, i)
                place = F.size(F.filter(F.slice(bases, 1, i), lambda x: x > 0))
                digit = F.get(new, 2 * place) * half(b) + F.get(new, 2 * place + 1)
                return F.when(b > 0, F.char(b + digit)).otherwise(c)

            return F.array_join(F.transform(chars, one), "")

        return F.when(F.size(kinds) > 0, let(permuted(values, radices, key, kind, stays), put)).otherwise(text)

    return let(characters(text), lambda chars: let(F.transform(chars, base), lambda bases: written(chars, bases)))


def digits_of(text: Column) -> Column:
    return F.transform(characters(F.regexp_replace(text, r"\D", "")), lambda c: c.cast("int"))


def with_digits(text: Column, digits: Column) -> Column:
    """``text`` with its digits, in order, taken from ``digits``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"\D", ""))

    def write(new: Column) -> Column:
        pick = lambda c, i: F.when(c.rlike(r"^\d$"), F.get(new, place(i)).cast("string")).otherwise(c)
        return F.array_join(F.transform(characters(text), pick), "")

    return let(digits, write)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is the check digit."""
    n = F.size(digits)
    weigh = lambda d, i: F.when((n - i) % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, b: a + b)


def card(m: Column, key: str) -> Column:
    """The first digit stays, the check digit is computed anew."""
    digits = digits_of(m)
    inner = F.slice(digits, 2, F.size(digits) - 2)
    new = F.concat(
        F.slice(digits, 1, 1),
        permuted(inner, F.transform(inner, lambda _: F.lit(10)), key, "card").cast("array<int>"),
        F.array(F.lit(0)),
    )
    closed = let(new, lambda d: F.concat(F.slice(d, 1, F.size(d) - 1), F.array((10 - luhn_sum(d) % 10) % 10)))
    out = with_digits(m, closed)
    return F.when(luhn_sum(digits) % 10 == 0, out).otherwise(m)


def octets(m: Column, key: str) -> Column:
    values = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    new = permuted(values, F.array(*[F.lit(256)] * 4), key, "octets")
    return F.when(F.forall(values, lambda v: v < 256), F.array_join(new.cast("array<string>"), ".")).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The last ten digits change. A leading digit of the area or exchange stays within 2 to 9, or within 0 and 1."""
    digits = digits_of(m)
    skip = F.size(digits) - 10
    own = F.slice(digits, skip + 1, 10)
    leads = lambda i: (i == 0) | (i == 3)
    low = F.transform(own, lambda d, i: F.when(leads(i) & (d >= 2), 2).otherwise(0))
    radices = F.transform(own, lambda d, i: F.when(~leads(i), 10).when(d >= 2, 8).otherwise(2))
    new = permuted(F.zip_with(own, low, lambda a, b: a - b), radices, key, "phone").cast("array<int>")
    return with_digits(m, F.concat(F.slice(digits, 1, skip), F.zip_with(new, low, lambda a, b: a + b)))


def abroad(m: Column, key: str) -> Column:
    """The country code stays, and a zero behind it; a leading digit stays within 1 to 9."""
    digits = digits_of(m)
    code = F.length(F.regexp_extract(F.array_join(digits.cast("array<string>"), ""), f"^(?:{CALLING}|\\d\\d\\d)", 0))
    zero = F.get(digits, code) == 0
    skip = code + zero.cast("int")
    own = F.slice(digits, skip + 1, F.size(digits) - skip)
    low = F.transform(own, lambda _, i: F.when((i == 0) & ~zero, 1).otherwise(0))
    radices = F.transform(low, lambda x: 10 - x)
    stays = F.array_join(F.slice(digits, 1, skip).cast("array<string>"), "")
    new = permuted(F.zip_with(own, low, lambda a, b: a - b), radices, key, "abroad", stays).cast("array<int>")
    out = with_digits(m, F.concat(F.slice(digits, 1, skip), F.zip_with(new, low, lambda a, b: a + b)))
    return F.when(F.size(digits).between(8, 15), out).otherwise(m)


def mod_97(text: Column) -> Column:
    """The remainder of digits and capitals by 97, capitals read as the numbers from 10 on."""
    read = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(
        F.transform(characters(text), read), F.lit(0), lambda n, d: (n * F.when(d > 9, 100).otherwise(10) + d) % 97
    )


def iban(m: Column, key: str) -> Column:
    """The country stays, the check digits are computed anew."""
    plain = lambda t: F.regexp_replace(t, " ", "")
    turned = lambda t: F.concat(F.substr(plain(t), F.lit(5)), F.substr(t, F.lit(1), F.lit(4)))
    new = by_character(F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), F.substr(m, F.lit(5))), key, "iban", lambda i: i >= 4)
    checked = let(
        new,
        lambda t: F.concat(
            F.substr(t, F.lit(1), F.lit(2)),
            F.lpad((98 - mod_97(turned(t))).cast("string"), 2, "0"),
            F.substr(t, F.lit(5)),
        ),
    )
    return F.when(mod_97(turned(m)) == 1, checked).otherwise(m)


# The days of a year that only a month-first reading allows, by the calendar of any year without a leap day.
LATE_DAYS = [f"{m:02d}/{d:02d}" for m in range(1, 13) for d in range(13, monthrange(2001, m)[1] + 1)]


def month_first(m: Column, key: str) -> Column:
    """Days after the 12th are permuted among themselves over all years; leap days among leap years."""
    days = F.split(F.lit(" ".join(LATE_DAYS)), " ")
    day, year = F.substr(m, F.lit(1), F.lit(5)), F.substr(m, F.lit(7)).cast("int")
    place = F.array_position(days, day).cast("int") - 1
    usual = permuted(F.array(year - 1900, place), F.array(F.lit(200), F.lit(len(LATE_DAYS))), key, "month first")
    usual = let(usual, lambda v: F.concat_ws("/", F.get(days, F.get(v, 1).cast("int")), (F.get(v, 0) + 1900).cast("string")))
    leap = F.floor((year - 1904) / 4).cast("int")
    rare = permuted(F.array(F.floor(leap / 7).cast("int"), leap % 7), F.array(F.lit(7), F.lit(7)), key, "leap day")
    rare = let(rare, lambda v: F.concat(F.lit("02/29/"), (1904 + 4 * (7 * F.get(v, 0) + F.get(v, 1))).cast("string")))
    is_leap = (day == "02/29") & (year % 4 == 0) & (year > 1900)
    return F.when(place >= 0, usual).when(is_leap, rare).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    parts = F.split(m, "-")
    area, group, serial = (F.get(parts, i).cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")
    new = permuted(F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    back = lambda v: F.get(v, 0) + 1 + (F.get(v, 0) >= 665).cast("int")
    out = let(new, lambda v: F.format_string("%03d-%02d-%04d", back(v), F.get(v, 1) + 1, F.get(v, 2) + 1))
    return F.when(valid, out).otherwise(m)


def date(m: Column, key: str, form: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    new = permuted(
        F.array(F.floor(number / DAYS_HIGH), number % DAYS_HIGH), F.array(F.lit(DAYS_LOW), F.lit(DAYS_HIGH)), key, "date"
    )
    number = let(new, lambda v: (F.get(v, 0) * DAYS_HIGH + F.get(v, 1)).cast("int"))
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), number)
    return F.when(day.isNotNull(), F.date_format(out, form)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself if it is not valid."""
    return (
        F.when(m.rlike(whole(EMAIL)), let(F.length(F.regexp_replace(m, r"\.[^.]*$", "")), lambda n: by_character(m, key, "email", lambda i: i < n)))
        .when(m.rlike(whole(DATE)), date(m, key, "yyyy-MM-dd"))
        .when(m.rlike(whole(DAY_FIRST)), date(m, key, "dd.MM.yyyy"))
        .when(m.rlike(whole(DAY_SLASH)), date(m, key, "dd/MM/yyyy"))
        .when(m.rlike(whole(MONTH_SLASH)), month_first(m, key))
        .when(m.rlike(whole(OCTETS)), octets(m, key))
        .when(m.rlike(whole(SSN)), ssn(m, key))
        .when(m.rlike(whole(PHONE)), phone(m, key))
        .when(m.rlike(whole(ABROAD)), abroad(m, key))
        .when(m.rlike(whole(IBAN)), iban(m, key))
        .otherwise(card(m, key))
    )


def pseudonymised(docs: DataFrame, text: str = "text", *, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``count`` names a column for the number of values replaced.

    Whoever knows ``key`` can undo the pseudonyms, so it is a secret of the caller and has no default."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rewritten = spare_name(docs, "_rewritten")
    said = F.col(text).cast("string")

    # Arrays of one element name a value, so that it is computed once.
    def joined(found: Column, new: Column) -> Column:
        between = F.split(said, ANY, -1)
        whole_text = F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
        changed = F.aggregate(
            F.zip_with(found, new, lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"), lambda n, x: n + x
        )
        return F.struct(whole_text.alias("text"), changed.alias("n"))

    def replaced(found: Column) -> Column:
        new = F.array(F.transform(found, lambda m: pseudonym(m, key)))
        return F.get(F.transform(new, lambda n: joined(found, n)), 0)

    found = F.array(F.regexp_extract_all(said, F.lit(ANY), F.lit(0)))
    possible = said.contains("@") | said.rlike(DIGITS)
    rows = docs.withColumn(rewritten, F.when(possible, F.get(F.transform(found, replaced), 0)))
    rows = rows.withColumn(text, F.coalesce(F.col(f"{rewritten}.text"), said))
    if count:
        rows = rows.withColumn(count, F.coalesce(F.col(f"{rewritten}.n"), F.lit(0).cast("bigint")))
    return rows.drop(rewritten)
