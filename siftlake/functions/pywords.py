"""The words of `functions.text` in Python workers, by the letters that the JVM knows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import ACCENTED, PLAIN

_PLAIN = str.maketrans(ACCENTED, PLAIN) | {ord("ß"): "ss"}


@dataclass(frozen=True)
class Letters:
    """Where Python's letters are not the JVM's (newer or older tables): what to put in place of a character, and letters that only the JVM knows.

    One difference is left: whether a capital sigma ends its word, where a character that only one of them knows is its neighbour.
    """

    odd: dict[int, str]
    extra: str = ""

    def words(self, text: str) -> list[str]:
        """What `text.words` gives."""
        find = re.compile(rf"(?:[^\W_]|[{re.escape(self.extra)}])+" if self.extra else r"[^\W_]+").findall
        return find((text.translate(self.odd) if not text.isascii() else text).lower())

    def analyzer(self) -> Callable[[str], Callable[[str], list]]:
        """For a text: a function of its parts that gives what `text.usimple` does. Words of texts in the first 256 characters are cut and given as their bytes in latin-1 (see `spellings`)."""
        # Odd characters are looked for by one range first: a class of thousands is slow to match.
        high, chars = re.compile(f"[{re.escape(chr(min(self.odd, default=0x10FFFF)))}-\U0010ffff]").search, frozenset(map(chr, self.odd))
        table = bytes(ord(plain(c) if c.isalnum() and c != "ß" else c) if c.isalnum() else 32 for c in map(chr, range(256)))
        own = Letters({}, self.extra)

        def spelt(part: str) -> list[str]:
            return [plain(w) for w in own.words(part)]

        def short(part: str) -> list[bytes]:
            return part.lower().encode("latin-1").translate(table).replace(b"\xdf", b"ss").split()

        def of(text: str) -> Callable[[str], list]:
            if not text.isascii() and high(text) and not chars.isdisjoint(text):
                return lambda part: spelt(part.translate(self.odd))
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return spelt
            return short

        return of


def spellings(word: str) -> list:
    """A word as an analyzer may give it."""
    try:
        return [word, word.encode("latin-1")]
    except UnicodeEncodeError:
        return [word]


def plain(word: str) -> str:
    """A lower-cased word without accents, as `text.usimple` has it."""
    return word if word.isascii() else word.translate(_PLAIN)


_letters: dict[str, Letters] = {}

#: Characters in a row of those that the JVM is asked of.
BLOCK = 128


def letters(spark: SparkSession) -> Letters:
    """Asked of the JVM once an application, for each character."""
    app = spark.sparkContext.applicationId
    if app not in _letters:
        codes = F.transform(F.sequence(F.col("id") * BLOCK, F.col("id") * BLOCK + BLOCK - 1), lambda i: F.lpad(F.hex(i), 8, "0"))
        each = spark.range(0x80 // BLOCK, 0x110000 // BLOCK).where(f"id * {BLOCK} < 55296 OR id * {BLOCK} > 57343").select("id", F.decode(F.unhex(F.array_join(codes, "0000000A")), "UTF-32").alias("t"))
        rows = each.select("id", F.lower("t").alias("low"), F.regexp_replace("t", r"[^\p{L}\p{N}\n]", " ").alias("words"), "t").where((F.col("low") != F.col("t")) | F.col("t").rlike(r"[\p{L}\p{N}]")).select("id", "low", "words").collect()
        words = {ord(c) for r in rows for c in r.words} - {10, 32}
        lower = {i: low for r in rows for i, low in enumerate(r.low.split("\n"), r.id * BLOCK)}
        _letters[app] = compared(words, lower)
    return _letters[app]


def compared(words: set[int], lower: dict[int, str]) -> Letters:
    """words: the characters of which words are made, from U+0080; lower: of those that change at least, in lower case."""
    odd = {}
    for i in {*words, *lower, *(i for i in range(0x80, 0x110000) if chr(i).isalnum())}:
        there = "".join(x if ord(x) in words or "0" <= x <= "9" or "a" <= x <= "z" else " " for x in lower.get(i, chr(i)))
        if there != "".join(x if x.isalnum() else " " for x in chr(i).lower()):
            odd[i] = there
    return Letters(odd, "".join(chr(i) for i in sorted(words) if not chr(i).isalnum()))
