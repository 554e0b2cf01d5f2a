"""Column expressions on text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents and what they become; the sharp s becomes two letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyoa"
WORD = r"[\p{L}\p{N}]+"


#: A word's edge by ASCII letters, digits and _, whatever other letters stand there.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Letters whose one-letter upper case is not the first choice: it would be several letters (the sharp s and Greek letters with a iota below).
SMALL = "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c)
LARGE = "".join(c.title() for c in SMALL)


def upper_letter(letter: Column) -> Column:
    """A letter's upper case, as one letter; letters without such stay."""
    one = F.translate(letter, "ß" + SMALL, "ẞ" + LARGE)
    return F.when(F.length(F.upper(one)) > F.length(one), one).otherwise(F.when(one == letter, F.upper(one)).otherwise(one))


def unaccent(text: Column) -> Column:
    return F.replace(F.translate(text, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def usimple(text: Column) -> Column:
    """Lexemes of the plain analyzer: words without accents."""
    return F.regexp_extract_all(unaccent(F.lower(text)), F.lit(WORD), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    """The first n space-separated parts."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", "")


#: Marks of page ends, in this case only.
PAGE_MARKS = r"Page \d+ of \d+|HEADER_PATTERN|FOOTER_PATTERN"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def without_page_marks(text: Column) -> Column:
    """A line end in place of each mark."""
    return F.regexp_replace(text, PAGE_MARKS, "\n")


def cleaned(text: Column) -> Column:
    return without_page_marks(printable(stripped(text)))


def escaped_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[.+?:\s*(\d+.*?)\]", "")


#: Fixed value: the tag of an assistant's own turn.
OWN_TURN = r"(?i)\[AI.+?:\s*(\d+.*?)\]"


def cited_ids(text: Column) -> Column:
    """Distinct numbers in citation tags, in the order of their first place; tags of the assistant's own turns, in either case and with more behind the number, do not count."""
    tags = F.regexp_extract_all(F.regexp_replace(text, OWN_TURN, ""), F.lit(r"\[.*?:(.*?\d+)\]"), F.lit(1))
    numbers = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("long")))


def task_citations(text: Column) -> Column:
    """(task, excerpt) pairs of tags like [Task: 1, 2, Excerpt: 3]."""
    tags = F.regexp_extract_all(text, F.lit(r"\[Task:[^\]]*\]"), F.lit(0))
    number = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("long"))
    pair = lambda t: F.flatten(F.transform(number(F.regexp_extract(t, r"Task:([\d,\s]*)", 1)), lambda a: F.transform(number(F.regexp_extract(t, r"Excerpt:([\d,\s]*)", 1)), lambda b: F.struct(a.alias("task"), b.alias("excerpt")))))
    return F.array_distinct(F.flatten(F.transform(tags, pair)))


def filename_tokens(name: Column) -> Column:
    """The name, the name without its ending, and its runs of letters and digits, of letters, and of digits; sorted."""
    stem = F.regexp_replace(name, r"\.[A-Za-z]{3,5}$", "")
    runs = lambda p: F.regexp_extract_all(stem, F.lit(p), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.array(name, stem), runs("[A-Za-z0-9]+"), runs("[A-Za-z]+"), runs("[0-9]+"))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(text, r"\s+", " "), " "), lambda w: w != ""))


def truncated_query(text: Column) -> Column:
    """The first 40 and the last 30 words; short queries are doubled, which adds no lexeme."""
    w = F.split(text, " ")
    return F.array_join(F.concat(F.slice(w, F.lit(1), F.lit(40)), F.slice(w, F.greatest(F.size(w) - 29, F.lit(1)), F.lit(30))), " ")


def clean_search_query(text: Column) -> Column:
    """Without a leading number and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*\d+[.)]?\s*", ""), "[\"']", ""))


def page_label(page: Column, n_breaks: Column) -> Column:
    """`p`, or `p - (p + n)` for n page breaks; pages that are no number stay."""
    p = page.try_cast("int")
    return F.when((n_breaks > 0) & p.isNotNull(), F.concat(page, F.lit(" - "), (p + n_breaks).cast("string"))).otherwise(page)


#: So many first characters are looked for at once.
LOOK = 12


def overlap(a: Column, b: Column) -> Column:
    """The longest end of a, not the whole of it, that b starts with."""
    first = F.greatest(F.lit(2), F.length(a) - F.length(b) + 1)  # an end longer than b can't be

    def within(tail: Column) -> Column:
        n, head = F.length(tail), F.substring(b, 1, LOOK)
        # Places where b's first characters stand (a split before each of them), and the last places, where less than these is left.
        quoted = F.concat(F.lit(r"(?=\Q"), F.replace(head, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E)"))
        step = lambda s, p: F.struct(F.concat(s["at"], F.array(s["next"])).alias("at"), (s["next"] + F.length(p)).alias("next"))
        starts = F.aggregate(F.split(tail, quoted), F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next")), step)["at"]
        last = F.when(n > 0, F.sequence(F.greatest(n - LOOK + 2, F.lit(1)), n)).otherwise(F.array().cast("array<int>"))
        places = F.concat(F.when(F.length(b) >= LOOK, starts).otherwise(F.array().cast("array<int>")), last)
        found = F.filter(places, lambda i: F.startswith(b, F.substring(tail, i, n)) & (i <= n))
        return bound(F.array_min(found), lambda i: F.when(i.isNotNull(), F.substring(tail, i, n)).otherwise(F.lit("")))

    return bound(F.substring(a, first, F.length(a)), within)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hamming(a: Column, b: Column) -> Column:
    """Of texts of equal length; null otherwise."""
    n = F.length(a)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(n == F.length(b), F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))


def nearest_substring(source: Column, search: Column) -> Column:
    """struct(d, i): the window of source with the same first character and the least edit distance; the first below 3 wins."""
    n = F.length(search)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(source) - n + 1, F.lit(1))), lambda i: F.substring(source, i, F.lit(1)) == F.substring(search, F.lit(1), F.lit(1)))
    scored = F.transform(starts, lambda i: F.struct(F.levenshtein(F.substring(source, i, n), search).alias("d"), i.alias("i")))
    good = F.filter(scored, lambda x: x["d"] < 3)
    return F.when(F.size(good) > 0, F.element_at(good, 1)).otherwise(F.array_min(scored))


def verdict(text: Column) -> Column:
    """1 for Y, 0 for N at the end, the start, or on the last line; else null."""
    t = F.upper(F.trim(text))
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"\b(Y|N)[.\s]*$", r"^(Y|N)\b", r"\n\s*(Y|N)\b[^\n]*$")])
    return F.when(found == "Y", 1).when(found == "N", 0)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def stream_buffer(n: Column) -> Column:
    return F.least(F.lit(15), F.floor(1 + 5 * F.log(n.cast("double"))).cast("int"))


def encrypted(text: Column, key: Column) -> Column:
    """base64(iv + AES-CBC): the iv is drawn for each value; key: 32 bytes, derived once on the driver."""
    return F.base64(F.aes_encrypt(text, key, F.lit("CBC"), F.lit("PKCS")))


def decrypted(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("CBC"), F.lit("PKCS")).cast("string")
