"""Token counting and truncation by a tokenizer file, as Arrow functions; expressions in functions.text estimate without one."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a message, a name, a reply and a small image add.
PER_MESSAGE, PER_NAME, PER_REPLY, PER_IMAGE = 3, 1, 3, 85


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def counter(ranks: str, pattern: str):
    """A function of a text Column; the file is read once in each worker."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(ranks, pattern)
        for s in texts:
            yield s.map(lambda x: 0 if x is None else len(enc.encode_ordinary(x)))

    return count


def truncator(ranks: str, pattern: str, most: int):
    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(ranks, pattern)
        for s in texts:
            yield s.map(lambda x: None if x is None else enc.decode(enc.encode_ordinary(x)[:most]))

    return cut


def message_tokens(n_tokens: Column, has_name: Column, n_images: Column) -> Column:
    return n_tokens + PER_MESSAGE + F.when(has_name, PER_NAME).otherwise(0) + n_images * PER_IMAGE


def summary_budget(context: int) -> int:
    return min(3000, context - 2700)
