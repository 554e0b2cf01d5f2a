"""Quality rules as a short-circuit cascade.

Each rule has a feature (an integer read off the whole text) and a test on it. On a bounded random sample of
whole texts one task times every feature and counts how many texts each rule rejects; the rules are ordered
by rejections per second. A text meets the rules in that order and leaves at its first
failure, so costly features are only computed for texts that the cheap rules let through. The verdict is
the conjunction of all rules, so it does not depend on the order, on the sample or on the machine; which failure is
the first one (failed_rule) does depend on the order.

Defined cases: null text counts as empty; an empty text has no words and fails the length rule; a very long text is judged whole,
as one row's work; a null doc_id is carried through; repeated rows are each judged alone; an empty table gives an empty result.
Columns besides the id and the text are ignored by the rules; `judge` keeps them where no name clashes, `passing` keeps all.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


class Text:
    """A text whose features are computed when first asked for, once each."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.got: dict[str, int] = {}
        self.split: list[bytes] | None = None

    def __getitem__(self, name: str) -> int:
        if name not in self.got:
            self.got[name] = FEATURES[name](self)
        return self.got[name]

    @property
    def words(self) -> list[bytes]:
        if self.split is None:
            self.split = self.text.encode("utf-8", "surrogatepass").split()
        return self.split


def n_words(t: Text) -> int:
    return len(t.words)


def word_chars(t: Text) -> int:
    return len(t.text) - sum(map(t.text.count, BLANKS))


def n_symbols(t: Text) -> int:
    return sum(map(t.text.count, SYMBOLS))


def _lines(t: Text) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier line."""
    lines = [x for x in t.text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def n_lines(t: Text) -> int:
    return _lines(t)[0]


def n_dup_lines(t: Text) -> int:
    return _lines(t)[1]


def n_repeat_words(t: Text) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    w = t.words
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n, upto = 0, 0  # words before upto are counted already
    for i, x in enumerate(windows):
        if seen[x] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


FEATURES: dict[str, Callable[[Text], int]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """A text fails where fails(text) is true. base: the rule is part of the contract's own test."""

    name: str
    fails: Callable[[Text], bool]
    base: bool = False


def default_rules(min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 30, dup_line_pct: int = 50, word_len: tuple[int, int] = (2, 12)) -> tuple[Rule, ...]:
    """All tests are on integers, so that SQL gives the same answers."""
    return (
        Rule("few_words", lambda t: t["n_words"] < min_words, True),
        Rule("repeated_windows", lambda t: 100 * t["n_repeat_words"] > repeat_pct * t["n_words"], True),
        Rule("symbols", lambda t: 100 * t["n_symbols"] > symbol_pct * t["n_words"]),
        Rule("repeated_lines", lambda t: 100 * t["n_dup_lines"] > dup_line_pct * t["n_lines"]),
        Rule("word_length", lambda t: not word_len[0] * t["n_words"] <= t["word_chars"] <= word_len[1] * t["n_words"]),
    )


@dataclass
class Cascade:
    rules: tuple[Rule, ...] = field(default_factory=default_rules)

    def tried(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Name, seconds and rejections of every rule. Each rule is timed on texts that nothing was computed for."""
        out = []
        for rule in self.rules:
            began, n = time.perf_counter(), 0
            for x in texts:
                n += rule.fails(Text(x))
            out.append((rule.name, max(time.perf_counter() - began, 1e-9), n))
        return out

    def ordered(self, tried: list[tuple[str, float, int]]) -> Cascade:
        """The rules by rejections per second."""
        gain = {}
        for name, _, _ in tried:
            gain[name] = sum(n for k, _, n in tried if k == name) / sum(s for k, s, _ in tried if k == name)
        return Cascade(tuple(sorted(self.rules, key=lambda r: -gain.get(r.name, 0.0))))

    def ordered_on(self, docs: DataFrame, text: str, sample_rows: int, sample_chars: int = 4_000_000) -> Cascade:
        """By a sample whose rows and characters are bounded (a text that goes beyond is the last one); one task tries it, and only the figures reach the driver."""
        n = docs.count()
        some = docs.select(F.col(f"`{text}`").alias("text")).sample(min(1.0, 2 * sample_rows / max(n, 1)), 8).limit(sample_rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, chars = [], 0
            for b in batches:
                for x in b.column(0).to_pylist():
                    if chars < sample_chars:
                        held.append(x)
                        chars += len(x or "")
            got = self.tried(held)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["rule", "seconds", "rejected"])

        return self.ordered([tuple(r) for r in some.coalesce(1).mapInArrow(run, "rule string, seconds double, rejected long").collect()])

    def fails(self, t: Text) -> bool:
        return any(r.fails(t) for r in self.rules)

    def first_failure(self, t: Text) -> str | None:
        return next((r.name for r in self.rules if r.fails(t)), None)


def judge(docs: DataFrame, cascade: Cascade | None = None, *, text: str = "text", sample_rows: int = 256, features: bool = False) -> DataFrame:
    """docs with kept and failed_rule (the first failure in the cascade's order), and with features=True all features.

    sample_rows bounds the texts that order the rules. One pass, no shuffle.
    Columns of docs named like an added one are replaced.
    """
    cascade = (cascade or Cascade()).ordered_on(docs, text, sample_rows)
    added = ["base_failed", "kept", "failed_rule", *(FEATURES if features else ())]
    rest = [c for c in docs.columns if c not in added]
    base = [r for r in cascade.rules if r.base]
    kinds = {"base_failed": "boolean", "kept": "boolean", "failed_rule": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in added}
            for x in b.column(text).to_pylist():
                t = Text(x)
                failed = cascade.first_failure(t)
                out["failed_rule"].append(failed)
                out["kept"].append(failed is None)
                out["base_failed"].append(failed is not None and any(r.fails(t) for r in base))
                if features:
                    for k in FEATURES:
                        out[k].append(t[k])
            new = [pa.array(out[k], {"boolean": pa.bool_(), "string": pa.string()}.get(kinds.get(k), pa.int64())) for k in added]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + new, names=rest + added)

    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in rest])
    for k in added:
        schema = schema.add(k, kinds.get(k, "long"))
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def passing(docs: DataFrame, cascade: Cascade | None = None, *, text: str = "text", sample_rows: int = 256) -> DataFrame:
    """The rows that pass every rule, with their own columns and no other."""
    cascade = (cascade or Cascade()).ordered_on(docs, text, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not cascade.fails(Text(x)) for x in b.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
