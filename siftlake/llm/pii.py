"""Format-preserving pseudonyms for personal data and secrets. DataFrame functions only.

Items are found by one pattern, validated by kind, and permuted within their format by a keyed Feistel network (ROUNDS
rounds of SHA-512 over key, kind, round and the other half). A permutation has no collisions, and equal items get
equal pseudonyms in every document, so records stay linked; without the key it can't be undone.

kind          valid if                                what is permuted
email         local part, @, host with a dot          letters and digits of the local part, in their class
card          13 to 19 digits that pass Luhn          the digits between the first and the last; the last is the new check digit
phone         3-3-4 digits after +1 or with brackets, all digits but the country code and the leading digits of area and exchange
              or bare with - or . and leading 2 to 9
abroad        + and 8 to 15 digits in groups, not +1  all digits but the first two (the country code or its start)
ssn           3-2-4 digits that can be issued         the number among all that can be issued
ip            four numbers up to 255                  the address as two 16-bit halves
date          a real day from 1900 to 2099, as y-m-d, the day among all 73049 days of those years, in the same form
              d.m.y, m/d/y or d/m/y                   (d/m/y: among the days over 12, as it is told by them)
key           AKIA and 16 characters                  the 16 characters
secret        after password, token, secret, api key: the value's characters, in their class (hexadecimal stays so)
              8 characters at least, up to the next
              quote or white space, of any length

Items that fail validation stay as they are. The rest of the text is untouched, byte by byte.

Defined cases: null text stays null; empty texts and texts without items come back unchanged; null ids and repeated rows
are treated alike; an empty table gives an empty result; other columns are kept by `pseudonymised`, but for one that is named like `items`.
A text is one row's work, however long; of items that overlap, the first one and at a place the first kind counts; a hot source is no key here, as nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: One pattern for each kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}[.]){1,127}[A-Za-z]{2,63}",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "secret": r"\b(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s?[=:]\s?[\"']?[^\s\"']{8,}",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "date": r"(?<![\d-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])|(?<![\d./])(?:0?[1-9]|[12]\d|3[01])(?<slash>[./])(?:0?[1-9]|[12]\d|3[01])\k<slash>(?:19|20)\d{2}(?![\d/]|[.]\d)",
    "card": r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![\dA-Za-z])",
    "phone": r"(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.+-])[2-9]\d{2}(?<dash>[.-])[2-9]\d{2}\k<dash>\d{4}(?![\d-]|[.]\d)",
    "abroad": r"(?<![\d+])\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12})){1,6}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)[.]){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|[.]\d)",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no item; the cheap test spares most texts the full pattern.
HINT = r"[@+(]|\d[./-]\d|\d{13}|\d{4} \d{4}|AKIA|(?i:password|passwd|token|secret|api)"


def _hash(key: str, kind: str, nth: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), nth.cast("string"), half.cast("string")), 512)


def _number(key: str, kind: str, nth: Column, half: Column) -> Column:
    """A keyed number below 2**52 of a half."""
    return F.conv(F.substring(_hash(key, kind, nth, half), 1, 13), 16, 10).cast("long")


def permuted_string(s: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Each character stays in its alphabet; characters outside of all are left alone and still steer the others."""
    half = F.floor(F.length(s) / 2).cast("int")

    def moved(text: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for a in alphabets:
                at = F.instr(F.lit(a), c)
                out = F.when((at > 0) & (c != ""), F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(state: Column, nth: Column) -> Column:
        held = F.array(_hash(key, kind, nth, state["b"]))  # bound once for all characters
        return F.struct(state["b"].alias("a"), F.element_at(F.transform(held, lambda d: moved(state["a"], d)), 1).alias("b"))

    begin = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda x: F.concat(x["a"], x["b"]))


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str) -> Column:
    """struct(a, b) permuted among all pairs below the sizes: the halves are moved in turns."""

    def step(x: Column, nth: Column) -> Column:
        return F.struct(
            F.when(nth % 2 == 1, F.pmod(x["a"] + _number(key, kind, nth, x["b"]), F.lit(size_a))).otherwise(x["a"]).alias("a"),
            F.when(nth % 2 == 0, F.pmod(x["b"] + _number(key, kind, nth, x["a"]), F.lit(size_b))).otherwise(x["b"]).alias("b"),
        )

    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step)


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The checksum of a digit string; doubled_last: its last digit is one that counts twice."""
    even = F.lit(0 if doubled_last else 1)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == even, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def refill(shape: Column, digits: Column) -> Column:
    """The digits put in the places of the shape's digits."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["t"], F.when(digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("t"), (s["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), step, lambda s: s["t"])


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted_string(F.substring_index(m, "@", 1), key, "email", (LOWER, UPPER, DIGITS)), F.lit("@"), F.substring_index(m, "@", -1))


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        middle = permuted_string(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", (DIGITS,))
        fresh = bound(F.concat(F.substring(d, 1, 1), middle), lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, True) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, False) % 10 == 0, bound(fresh, lambda x: refill(m, x))).otherwise(m)

    return bound(F.regexp_replace(m, "[^0-9]", ""), valid)


def _phone(m: Column, key: str) -> Column:
    def ten(d: Column) -> Column:
        p = F.substring(d, F.length(d) - 9, F.lit(10))
        free = F.concat(F.substring(p, 2, 2), F.substring(p, 5, 6))
        fresh = bound(permuted_string(free, key, "phone", (DIGITS,)), lambda x: F.concat(F.substring(d, F.lit(1), F.length(d) - 9), F.substring(x, 1, 2), F.substring(p, 4, 1), F.substring(x, 3, 6)))
        return bound(fresh, lambda x: refill(m, x))

    return bound(F.regexp_replace(m, "[^0-9]", ""), ten)


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        n = lambda i: F.element_at(o, i).cast("long")
        return bound(permuted_pair(n(1) * 256 + n(2), n(3) * 256 + n(4), 65536, 65536, key, "ip"), lambda x: F.concat_ws(".", *[v.cast("string") for h in ("a", "b") for v in (F.floor(x[h] / 256).cast("int"), F.pmod(x[h], F.lit(256)))]))

    return bound(F.split(m, "[.]"), of)


def _abroad(m: Column, key: str) -> Column:
    """Numbers with as many digits as a country's may have; equal digits are linked, however they are grouped."""

    def of(d: Column) -> Column:
        fresh = F.concat(F.substring(d, 1, 2), permuted_string(F.substring(d, F.lit(3), F.length(d) - 2), key, "abroad", (DIGITS,)))
        return F.when(F.length(d).between(8, 15), bound(fresh, lambda x: refill(m, x))).otherwise(m)

    return bound(F.regexp_replace(m, "[^0-9]", ""), of)


def _ssn(m: Column, key: str) -> Column:
    """898 areas (001 to 899 but 666) times 99 groups times 9999 serial numbers."""
    n = lambda at, size: F.substring(m, at, size).cast("long")
    area = n(1, 3) - F.when(n(1, 3) > 666, 2).otherwise(1)
    moved = permuted_pair(area, (n(5, 2) - 1) * 9999 + n(8, 4) - 1, 898, 99 * 9999, key, "ssn")
    return bound(moved, lambda x: F.format_string("%03d-%02d-%04d", x["a"] + F.when(x["a"] > 664, 2).otherwise(1), F.floor(x["b"] / 9999) + 1, F.pmod(x["b"], F.lit(9999)) + 1))


EPOCH = "1900-01-01"


def _date(m: Column, key: str) -> Column:
    """73049 days are 17 times 4297. Every form but d/m/y moves a day alike; there it moves on until its number is over 12 again."""
    day_of = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))

    def moved(n: Column) -> Column:
        return bound(permuted_pair(F.floor(n / 4297), F.pmod(n, F.lit(4297)), 17, 4297, key, "date"), lambda x: x["a"] * 4297 + x["b"])

    def late(n: Column) -> Column:
        step = lambda s, _: F.when(s["done"], s).otherwise(bound(moved(s["n"]), lambda x: F.struct(x.alias("n"), (F.dayofmonth(day_of(x)) > 12).alias("done"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(n.cast("long").alias("n"), F.lit(False).alias("done")), step, lambda s: s["n"])

    def real(y: Column, mo: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def shown(day: Column, form: str, walk) -> Column:
        return bound(F.datediff(day, F.lit(EPOCH).cast("date")), lambda n: F.date_format(day_of(walk(n)), form))

    def by(p: Column) -> Column:
        one, two, three = (F.element_at(p, i) for i in (1, 2, 3))
        padded = (F.length(one) == 2) & (F.length(two) == 2)
        form = lambda day, wide, narrow, walk=moved: F.when(padded, shown(day, wide, walk)).otherwise(shown(day, narrow, walk))
        return (
            F.when(m.contains("-"), shown(m.try_cast("date"), "yyyy-MM-dd", moved))
            .when(m.contains("."), form(real(three, two, one), "dd.MM.yyyy", "d.M.yyyy"))
            .when(real(three, one, two).isNotNull(), form(real(three, one, two), "MM/dd/yyyy", "M/d/yyyy"))
            .otherwise(form(real(three, two, one), "dd/MM/yyyy", "d/M/yyyy", late))
        )

    return F.coalesce(bound(F.split(m, "[./]"), by), m)


#: The value of a secret: what follows the name, the sign and an opening quote.
NAMED = r"^[A-Za-z_-]+[\"']?\s?[=:]\s?[\"']?"


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_replace(m, NAMED, "")
    hexadecimal = permuted_string(value, key, "hex", ("0123456789abcdef",))
    other = permuted_string(value, key, "secret", (LOWER, UPPER, DIGITS))
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.when(value.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(other))


def _kind(m: Column) -> Column:
    """By the patterns; an item matches its own as a whole (their looks around see only the item, which is enough)."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """Of one found item."""

    def by(kind: Column) -> Column:
        return (
            F.when(kind == "email", _email(m, key)).when(kind == "card", _card(m, key)).when(kind == "phone", _phone(m, key))
            .when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).when(kind == "secret", _secret(m, key))
            .when(kind == "ssn", _ssn(m, key)).when(kind == "abroad", _abroad(m, key))
            .when(kind == "key", F.concat(F.lit("AKIA"), permuted_string(F.substring(m, 5, 16), key, "key", (UPPER + "234567",)))).otherwise(m)
        )

    return bound(_kind(m), by)


def pseudonymised(docs: DataFrame, key: str, *, text: str = "text", items: str | None = None) -> DataFrame:
    """docs with the items of `text` replaced; `items` names an added column that counts the items found."""
    t = F.col(text)
    there = t.rlike(HINT)
    found = F.when(there, F.regexp_extract_all(t, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    if items:
        docs = docs.withColumn(items, F.coalesce(F.size(found), F.lit(0)).cast("long"))

    def put(m: Column) -> Column:
        fresh = F.concat(F.transform(m, lambda x: pseudonym(x, key)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, ALL, -1), fresh, lambda gap, x: F.concat(gap, x)), "")

    return docs.withColumn(text, bound(found, lambda m: F.when(F.size(m) > 0, put(m)).otherwise(t)))
