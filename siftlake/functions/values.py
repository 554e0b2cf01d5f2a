"""Column expressions over model answers, error records, states and JSON metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages of answers, and the tools whose results are cited.
LANGUAGES = {"en": "English", "de": "German", "it": "Italian"}
CITING_TOOLS = ("web_search", "enterprise", "attached_documents")


def unquoted(answer: Column) -> Column:
    """Quotes of both kinds go from both ends."""
    return F.btrim(answer, F.lit("\"'"))


def looked_up(key: Column, names: dict[str, str]) -> Column:
    """The name of a key; unknown keys and null have none."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def turned(names: dict[str, str]) -> dict[str, str]:
    """Names to keys, for the way back. Names must differ."""
    back = {v: k for k, v in names.items()}
    if len(back) != len(names):
        raise ValueError("two keys have one name")
    return back


def error_record(code: Column, description: Column) -> Column:
    """code and description in upper case; an error without a code has a null one."""
    return F.struct(F.upper(code).alias("code"), F.upper(description).alias("description"))


def chunk_metadata(json: Column) -> Column:
    """page, chunk_num and chunk_len_in_chars of a chunk's JSON metadata. Absent fields, and numbers that are none, are null."""
    field = lambda name: F.get_json_object(json, f"$.{name}")
    return F.struct(field("page").alias("page"), field("chunk_num").try_cast("int").alias("chunk_num"), field("chunk_len_in_chars").try_cast("int").alias("chunk_len_in_chars"))


def cites(tools: Column) -> Column:
    """Whether an answer made from these tools' results needs citations."""
    return F.coalesce(F.arrays_overlap(tools, F.array(*map(F.lit, CITING_TOOLS))), F.lit(False))


def merged_maps(old: Column, new: Column) -> Column:
    """The entries of both; new ones win. Null is empty, and both null give null."""
    both = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)


def merged_lists(old: Column, new: Column) -> Column:
    """The old list, then the new one. Null is empty, and both null give null."""
    return F.coalesce(F.concat(old, new), old, new)


def pieces(text: Column, size: int) -> Column:
    """The text cut every `size` characters, in one walk: a substring from a later place counts its way from the start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def page_pieces(text: Column, first: Column, offset: Column, last: Column, lengths: Column) -> Column:
    """A section's text cut at page ends: structs of page and piece. The section begins `offset` characters into page `first` (from 1) and ends in page `last`; `lengths` are those of
    all pages. A section within one page is one piece. Work is quadratic in the pages of one section only."""
    before = lambda p: F.aggregate(F.slice(lengths, first, p - first), F.lit(0), lambda a, n: a + n) - offset
    one = lambda p: F.when(p == first, F.substring(text, 1, F.get(lengths, p - 1) - offset)).otherwise(F.substring(text, before(p) + 1, F.get(lengths, p - 1)))
    pieces = F.transform(F.sequence(first, last), lambda p: F.struct(p.alias("page"), one(p).alias("piece")))
    return F.when(first == last, F.array(F.struct(first.alias("page"), text.alias("piece")))).otherwise(pieces)


def typed(value: Column, kind: Column) -> list[Column]:
    """int_value, float_value and text_value: the one of its declared type is set if the value fits it; an unknown type is an error."""
    known = F.when(kind.isin("int", "float", "text"), value).otherwise(F.raise_error(F.concat(F.lit("unknown type "), kind)).cast("string"))
    return [F.when(kind == "int", known.try_cast("long")).alias("int_value"), F.when(kind == "float", known.try_cast("double")).alias("float_value"), F.when(~F.coalesce(kind.isin("int", "float"), F.lit(False)), known).alias("text_value")]
